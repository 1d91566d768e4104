"""Tokenising whole texts: an exact piece memo, and overlap resynchronisation.

Both vocabularies used here pre-split a text so that no pre-token holds a blank
after a non-blank character: `cut_points` names the places where a text may be
cut without changing its tokens. Two consequences are used.

* `PieceEncoder` encodes each different piece once with the tokenizers library
  and remembers its ids; a text is the concatenation of its pieces, and a text
  with blanks that cannot be cut exactly goes to the library whole.
* `spliced` encodes a huge document in overlapping chunks, with offsets. Two
  neighbouring chunks are spliced at a boundary inside their overlap that both
  have and that is proven stable (a cut point, with the same tokens up to the
  next cut point in both). Where there is none the overlap doubles, down to
  encoding the rest of the document in one go.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

BLANKS = " \n"
#: Texts longer than this many characters are encoded in overlapping chunks.
CHUNK = 16384
OVERLAP = 256
#: Different pieces remembered by one Python worker before it starts anew.
MEMO = 400_000


#: Letters, in the range where lower-casing and letter classes are beyond doubt.
_LATIN = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"
_BEYOND = re.compile("[^\\x00-įĲ-ſ]|<\\|").search
_LETTERS = re.compile(f" ?[{_LATIN}]+\\Z").match
#: The byte-level alphabet: a printable byte stands for itself, the others for the characters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_STOPPED = re.compile(f"[{_LATIN}][.,]\\Z").search


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceEncoder(dict):
    """Ids of a text under a vocabulary file of the tokenizers library, as
    little-endian unsigned 32-bit integers.

    The dictionary itself maps pieces to their ids. It holds `most` / 2 pieces at
    most; then they become the older generation, from which pieces in use come back.
    """

    def __init__(self, path: str, blanks_drop: bool, most: int = MEMO):
        """blanks_drop: the vocabulary drops white space altogether; else a
        single blank belongs to the piece that it precedes."""
        super().__init__()
        self.most, self.older = most, {}
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.tokenize = self.model.tokenize
        self.blanks_drop = blanks_drop
        self.single = {c: self.plain(c) for c in ".,\n"}

    def _stem(self, raw: str) -> bytes:
        if _LETTERS(raw):  # one pre-token: straight to the library's merge model
            found = self.tokenize(raw if raw.isascii() and raw[0] != " " else raw.encode().decode("latin-1").translate(_BYTE_LEVEL))
            return array("I", [t.id for t in found]).tobytes()
        if raw[0] == "\n" and raw[1:2] != " " and _LETTERS(raw[1:]):  # a line break before a letter is a pre-token
            return self.single["\n"] + self._stem(raw[1:])
        return self.plain(raw)

    def __missing__(self, piece: str) -> bytes | None:
        out = self.older.get(piece, self)
        if out is self:
            out = self._made(piece)
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def _made(self, piece: str) -> bytes | None:
        """Ids of a piece, or None where its cuts are not proven.

        A full stop or comma after a Latin letter begins a pre-token. The
        blank-dropping vocabulary also lower-cases.
        """
        if piece.isascii() and piece.isalpha() and (not self.blanks_drop or piece.islower()):  # most pieces
            return array("I", [t.id for t in self.tokenize(piece if self.blanks_drop else "Ġ" + piece)]).tobytes()
        raw = piece
        if self.blanks_drop:
            if piece and not _BEYOND(piece):
                low = piece.lower()
                if low != piece:
                    return self[low]
        elif not piece or piece[-1].isspace() or (piece[0].isspace() and (piece[0] != "\n" or piece[1].isspace())):
            return None
        else:
            raw = piece if piece[0] == "\n" else " " + piece
        if not raw:
            return b""
        if len(piece) > 1 and _STOPPED(raw):
            return (self[piece[:-1]] or b"") + self.single[raw[-1]]
        return self._stem(raw)

    def raw(self, text: str) -> bytes:
        """The ids of `text`, 4 bytes each."""
        if self.blanks_drop:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        first, *pieces = text.replace("\n", " \n").split(" ")
        if not first or first[-1].isspace():
            return self.plain(text)
        try:
            return self.plain(first) + b"".join(map(self.__getitem__, pieces))
        except TypeError:  # blanks that cannot be cut exactly
            return self.plain(text)

    def plain(self, text: str) -> bytes:
        """The same, by one call of the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")

    def count(self, text: str) -> int:
        return len(self.raw(text)) // 4


_encoders: dict[tuple[str, bool, int], PieceEncoder] = {}


def encoder(path: str, blanks_drop: bool, most: int = MEMO) -> PieceEncoder:
    """One encoder for each Python worker, so that its memo serves many tasks."""
    key = (path, blanks_drop, most)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, blanks_drop, most)
    return _encoders[key]


def _stable(text: str, at: int) -> bool:
    """No pre-token of either vocabulary, and no special string, spans `at`."""
    return 0 < at < len(text) and text[at] in BLANKS and not text[at - 1].isspace() and (at + 1 >= len(text) or not text[at + 1].isspace())


class Chunked:
    """Encode huge texts by overlapping chunks; `repairs` counts widened overlaps."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap, self.repairs = tokenizer, chunk, overlap, 0

    def _encode(self, text: str, start: int, end: int):
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2) + start
        return np.array(e.ids, np.int64), spans

    def _meeting(self, text: str, left, right, low: int, high: int):
        """(index in left, index in right) of the last proven common boundary in [low, high)."""
        (lid, lspan), (rid, rspan) = left, right
        points = [p for p in range(low + 1, high) if _stable(text, p)]
        # A boundary needs whole tokens on both sides in both chunks, and the
        # tokens from one cut point to the next must agree.
        for a, b in zip(reversed(points[:-1]), reversed(points[1:]), strict=True):
            if (lspan[:, 0] < a).sum() != (lspan[:, 1] <= a).sum() or (rspan[:, 0] < a).sum() != (rspan[:, 1] <= a).sum():
                continue
            la, ra = int((lspan[:, 0] < a).sum()), int((rspan[:, 0] < a).sum())
            lb, rb = int((lspan[:, 0] < b).sum()), int((rspan[:, 0] < b).sum())
            if lb > la and np.array_equal(lid[la:lb], rid[ra:rb]):
                return la, ra
        return None

    def ids(self, text: str) -> np.ndarray:
        n = len(text)
        if n <= self.chunk:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        done: list[np.ndarray] = []
        start, end = 0, self.chunk
        left = self._encode(text, 0, end)
        keep_from = 0  # tokens of `left` before this one are spliced already
        while end < n:
            overlap, reach = self.overlap, self.chunk
            while True:
                low = max(start, end - overlap)
                high = min(n, max(end, low + reach))
                right = self._encode(text, low, high)
                if met := self._meeting(text, left, right, low, end):
                    if met[0] >= keep_from:
                        break
                if low == start:  # nothing left to widen into: take both chunks as one
                    self.repairs += 1
                    reach = min(2 * (high - start), n - start)
                    high = start + reach
                    left = self._encode(text, start, high)
                    end, right, met = high, None, None
                    break
                self.repairs += 1
                overlap *= 2
                reach += overlap
            if right is None:
                continue
            done.append(left[0][keep_from : met[0]])
            left, keep_from, start, end = right, met[1], low, high
        done.append(left[0][keep_from:])
        return np.concatenate(done)
