"""Exact substring de-duplication by suffix sorting.

A byte goes if it is covered by a string of LENGTH bytes that also starts
earlier: in a document with a smaller doc_id, or earlier in the same one.

Suffix sorting a whole corpus in one piece is not needed. Every window of LENGTH
bytes has an anchor, the k-gram with the smallest hash (leftmost if tied), which
its content alone decides. Windows can be equal only if their anchors are, so

1. exact copies of a text are settled by the text's hash;
2. anchors are counted over the corpus, and only windows whose anchor occurs
   twice or more live on, as fragments (the windows that share one anchor);
3. equal fragments are settled by their first occurrence;
4. anchors with different fragments form the shards that are suffix-sorted:
   LMS suffixes are ranked, L and S suffixes induced from them through queues,
   one for each first byte, which are on disk once they are large. Common
   prefixes of neighbours, counted up to LENGTH, show which windows are equal,
   and of each run all but the earliest are covered;
5. an anchor whose different fragments take more bytes than a shard is not
   sorted, but split by content: every window holds half of its bytes beside the
   anchor on the left or on the right of it, and only where these bytes occur
   twice do its windows live on, settled by the hash of the whole window in an
   aggregate. So nothing sorted exceeds two shards, whatever an anchor's share.

The reduced string of LMS names is ordered by doubling its ranks up to LENGTH
bytes, instead of by a further level of induction: its alphabet is nearly as
large as itself, and queues by first symbol would hold one entry each.

Defined results: a null text counts as an empty one; null doc_ids come last;
rows with equal doc_id and text are one document, and get equal results; other
rows with equal doc_ids are ordered by the hash of their texts; an empty table
gives an empty result; extra columns do not take part.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase
from .common import written as written_in_batches

LENGTH = 100
GRAM = 32
LAST = (1 << 63) - 1
#: Bytes that one array of the sorter may take in memory; larger ones are files.
IN_MEMORY = 64 << 20
#: Fragment bytes sorted at once, in whole anchor groups; larger groups are split by content.
SHARD = 4 << 20
_BLOCK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _anchors(block: np.ndarray, doc_end: np.ndarray, length: int, gram: int):
    """Anchor runs of the windows of a block of texts.

    doc_end: for every byte, where its text ends in the block. Returns lo, hi (first
    and last window), p (anchor) and h (its hash), one of each for a run."""
    n = len(block) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h, size, mult = block.astype(np.uint64) + np.uint64(1), 1, _ODD
    while size < gram:  # hashes of 1, 2, 4 ... bytes
        h = h[:-size] * mult + h[size:]
        mult, size = mult * mult, 2 * size
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    key = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, m, size = length - gram + 1, key, 1
    while 2 * size <= span:
        m, size = np.minimum(m[:-size], m[size:]), 2 * size
    if size < span:
        m = np.minimum(m[: n], m[span - size : span - size + n])
    p = (m[:n] & np.uint64(0xFFFFF)).astype(np.int64)
    i = np.flatnonzero(np.arange(n) + length <= doc_end[:n])
    if not len(i):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.ones(len(i), bool)
    new[1:] = (p[i[1:]] != p[i[:-1]]) | (i[1:] != i[:-1] + 1)
    at = np.flatnonzero(new)
    return i[at], i[np.append(at[1:], len(i)) - 1], p[i[at]], h[p[i[at]]]


def _blocks(texts: list[bytes], length: int):
    """Texts joined into blocks: block, doc_end, and (text number, place in block, place in text) of each part."""
    parts, total = [], 0
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at >= length:
            take = min(len(t) - at, _BLOCK)
            if total and total + take > _BLOCK:
                yield _joined(texts, parts, total)
                parts, total = [], 0
            parts.append((k, total, at, take))
            total += take
            if at + take == len(t):
                break
            at += take - length + 1
    if parts:
        yield _joined(texts, parts, total)


def _joined(texts, parts, total):
    ends = np.repeat(np.array([p[1] + p[3] for p in parts]), np.array([p[3] for p in parts]))
    return np.frombuffer(b"".join(texts[k][at : at + take] for k, _, at, take in parts), np.uint8), ends, parts


def anchor_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """text number, lo, hi, h of all anchor runs, as arrays, block by block."""
    for block, ends, parts in _blocks(texts, length):
        lo, hi, p, h = _anchors(block, ends, length, gram)
        which = np.searchsorted(np.array([x[1] for x in parts]), lo, "right") - 1
        move = np.array([x[2] - x[1] for x in parts])[which]
        yield np.array([x[0] for x in parts])[which], lo + move, hi + move, h.view(np.int64)


# --- suffix sorting by induction -------------------------------------------------------------


class Queues:
    """One first-in-first-out queue of suffixes for each first byte; once they
    hold more than `limit` bytes together, the queues continue in files."""

    def __init__(self, limit: int = IN_MEMORY):
        self.parts: list[list] = [[] for _ in range(256)]
        self.limit, self.held, self.folder = limit, 0, None

    def push(self, chars: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(chars, kind="stable")
        sorted_chars, sorted_suffixes = chars[order], suffixes[order]
        cut = np.flatnonzero(np.diff(sorted_chars)) + 1
        for part, c in zip(np.split(sorted_suffixes, cut), sorted_chars[np.append(0, cut)].tolist(), strict=True):
            if self.held + part.nbytes > self.limit:
                part = self._spill(part)
            else:
                self.held += part.nbytes
            self.parts[c].append(part)

    def _spill(self, part: np.ndarray):
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory()
        fd, path = tempfile.mkstemp(dir=self.folder.name)
        with os.fdopen(fd, "wb") as f:
            f.write(part.tobytes())
        return path, part.dtype

    def pop(self, c: int) -> np.ndarray | None:
        """All that waits at byte c."""
        if not self.parts[c]:
            return None
        parts, self.parts[c] = self.parts[c], []
        out = []
        for x in parts:
            if isinstance(x, tuple):
                out.append(np.fromfile(x[0], x[1]))
                os.unlink(x[0])
            else:
                self.held -= x.nbytes
                out.append(x)
        return np.concatenate(out)

    def close(self) -> None:
        if self.folder is not None:
            self.folder.cleanup()


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the suffix that starts one later. The last is L."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    changes = t[:-1] != t[1:]
    differs = np.flatnonzero(changes)
    if not len(differs):
        return s
    # Each place takes its type from the next place where the text changes.
    nxt = np.cumsum(changes) - changes
    inside = nxt < len(differs)
    d = differs[np.minimum(nxt, len(differs) - 1)]
    s[:-1] = inside & (t[d] < t[np.minimum(d + 1, n - 1)])
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, limit: int) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order."""
    n = len(t)
    dtype = lms.dtype
    starts = np.searchsorted(t[lms], np.arange(257)) if len(lms) else np.zeros(257, np.int64)
    queues, large = Queues(limit), [None] * 256
    queues.push(t[n - 1 :], np.array([n - 1], dtype))  # the last suffix is L, and induced by the end
    for c in range(256):
        got = []
        while (batch := queues.pop(c)) is not None:
            got.append(batch)
            pred = batch[batch > 0] - 1
            pred = pred[t[pred] >= c]
            queues.push(t[pred], pred.astype(dtype))
        large[c] = np.concatenate(got) if got else np.zeros(0, dtype)
        pred = lms[starts[c] : starts[c + 1]]
        pred = pred[pred > 0] - 1
        queues.push(t[pred], pred.astype(dtype))
    queues.close()
    queues, small = Queues(limit), [None] * 256
    for c in range(255, -1, -1):  # from the end backwards: every batch is in descending order
        got = []
        while (batch := queues.pop(c)) is not None:
            got.append(batch)
            pred = batch[batch > 0] - 1
            pred = pred[(t[pred] <= c) & s[pred]]
            queues.push(t[pred], pred.astype(dtype))
        small[c] = np.concatenate(got)[::-1] if got else np.zeros(0, dtype)
        pred = large[c][::-1]
        pred = pred[pred > 0] - 1
        pred = pred[s[pred] & (t[pred] < c)]
        queues.push(t[pred], pred.astype(dtype))
    queues.close()
    return np.concatenate([x for c in range(256) for x in (large[c], small[c])])


def suffix_order(t: np.ndarray, depth: int, limit: int = IN_MEMORY) -> np.ndarray:
    """Suffixes of t in the order of their first `depth` bytes."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if not len(lms):
        return _induce(t, s, lms, limit)
    # Name the LMS substrings: a rough induction orders them, then neighbours are compared.
    rough = _induce(t, s, lms[np.argsort(t[lms], kind="stable")], limit)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], n - 1) + 1  # an LMS substring includes the next LMS byte
    size = (ends - lms)[number[ordered]]
    equal = size[1:] == size[:-1]
    equal[(ends[number[ordered[1:]]] == n) | (ends[number[ordered[:-1]]] == n)] = False
    live, k = np.flatnonzero(equal), 0
    while len(live):
        a, b = ordered[live] + k, ordered[live + 1] + k
        over = k >= size[live]
        ok = over | ((t[np.minimum(a, n - 1)] == t[np.minimum(b, n - 1)]) & (s[np.minimum(a, n - 1)] == s[np.minimum(b, n - 1)]))
        equal[live[~ok]] = False
        live = live[ok & ~over]
        k += 1
    names = np.zeros(len(lms), np.int64)
    names[number[ordered]] = np.cumsum(np.append(0, ~equal))
    return _induce(t, s, lms[np.argsort(_ranks(names, depth), kind="stable")], limit)


def _ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of the reduced string by doubling, until they differ or reach `depth` bytes.

    A name stands for two bytes of its own or more. A rank is the number of smaller suffixes, so a suffix that has one
    of its own keeps it, and only the others are sorted again."""
    m = len(names)
    counts = np.bincount(names)
    ranks, live, step = (np.cumsum(counts) - counts)[names], np.flatnonzero(counts[names] > 1), 1
    while len(live) and 2 * step < depth:
        ahead = live + step
        nxt = np.where(ahead < m, ranks[np.minimum(ahead, m - 1)] + 1, 0)
        key = ranks[live] * (m + 1) + nxt
        order = np.argsort(key)
        live, key = live[order], key[order]
        old, at = key // (m + 1), np.arange(len(live))
        starts = np.append(True, key[1:] != key[:-1])
        groups = np.append(True, old[1:] != old[:-1])
        ranks[live] = old + np.maximum.accumulate(np.where(starts, at, 0)) - np.maximum.accumulate(np.where(groups, at, 0))
        live = live[~(starts & np.append(starts[1:], True))]
        step *= 2
    return ranks


def prefixes_reach(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For neighbours in order: do they share `depth` bytes or more?"""
    padded = np.append(t, np.zeros(depth + 8, np.uint8))
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    live = np.flatnonzero((order[1:] + depth <= len(t)) & (order[:-1] + depth <= len(t)))
    # From the end: neighbours share their first bytes, so their last ones tell most of them apart at once.
    for k in [*([depth - 8] if depth % 8 and depth > 8 else []), *reversed(range(0, depth - 7, 8))]:
        a = np.ascontiguousarray(words[order[live] + k]).view(np.uint64).ravel()
        b = np.ascontiguousarray(words[order[live + 1] + k]).view(np.uint64).ravel()
        live = live[a == b]
    if depth < 8:
        live = live[(words[order[live]][:, :depth] == words[order[live + 1]][:, :depth]).all(1)]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[live] = True
    return out


def repeated_windows(fragments: list[bytes], length: int = LENGTH, limit: int = IN_MEMORY) -> list[tuple[int, int, int]]:
    """Covered byte ranges (fragment number, from, to), where fragments are in
    document order and a window is covered if an equal one stands earlier."""
    t = np.frombuffer(b"".join(fragments), np.uint8)
    sizes = np.array([len(f) for f in fragments])
    base = np.cumsum(sizes) - sizes
    order = suffix_order(t, length, limit)
    edge = np.zeros(len(t) + 1, np.int64)
    np.add.at(edge, base, 1)
    np.add.at(edge, base + np.maximum(sizes - length + 1, 0), -1)
    inside = np.cumsum(edge)[:-1] > 0
    order = order[inside[order]]  # only windows inside a fragment are compared
    if not len(order):
        return []
    run = np.cumsum(np.append(0, ~prefixes_reach(t, order, length)))
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    lowest = np.minimum.reduceat(order, first)
    covered = np.sort(order[order != np.repeat(lowest, np.diff(np.append(first, len(order))))])
    if not len(covered):
        return []
    f = np.searchsorted(base, covered, "right") - 1
    cut = np.flatnonzero(np.append(True, (np.diff(covered) > 1) | (np.diff(f) > 0)))
    last = np.append(cut[1:], len(covered)) - 1
    return list(zip(f[cut].tolist(), (covered[cut] - base[f[cut]]).tolist(), (covered[last] - base[f[cut]] + length).tolist(), strict=True))


# --- anchors with too many surroundings to be sorted --------------------------------------------


def halves(frag: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[bytes, int, int]]:
    """Key, first and last window of the two parts of a fragment: windows that reach
    half of their free bytes or more to the left of the anchor, and the others.
    Equal windows of any two fragments are in parts of equal keys."""
    lo, hi, p, _ = _anchors(np.frombuffer(frag, np.uint8), np.full(len(frag), len(frag)), length, gram)
    half, out = (length - gram) // 2, []
    for a, b, at in zip(lo.tolist(), hi.tolist(), p.tolist(), strict=True):
        cut = min(b, at - half)  # the last window of the left part
        for side, x, y, i, j in ((b"l", a, cut, at - half, at + gram), (b"r", max(a, cut + 1), b, at, at + length - half)):
            if x <= y:
                out.append((hashlib.blake2b(side + frag[i:j], digest_size=16).digest(), x, y))
    return out


def written(df: DataFrame, label: str) -> DataFrame:
    """Tables here have small rows: larger batches."""
    return written_in_batches(df, label, rows=10_000)


def _settle_by_content(heads: DataFrame, length: int, gram: int) -> DataFrame:
    """d, s, lo, hi: covered ranges of the fragments in heads (h, d, s, lo, frag), without a group in memory."""

    def parts(batches):
        for b in batches:
            out = [(k, d, s, lo + x, f[x : y + length]) for d, s, lo, f in zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True) for k, x, y in halves(f, length, gram)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["k", "d", "s", "lo", "frag"])

    def windows(batches):
        for b in batches:
            out = [(hashlib.blake2b(f[i : i + length], digest_size=16).digest(), d, s, lo, lo + i) for d, s, lo, f in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True) for i in range(len(f) - length + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), *[pa.int64()] * 4))], ["w", "d", "s", "part", "lo"])

    def ranges(batches):
        for b in batches:
            out = [(d, s, x, y) for d, s, los in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True) for x, y in merge([(lo, lo + length) for lo in los])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["d", "s", "lo", "hi"])

    pieces = written(heads.mapInArrow(parts, "k binary, d bigint, s bigint, lo bigint, frag binary"), "hot-parts")
    twice = pieces.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    live = pieces.join(twice, "k", "left_semi").select("d", "s", "lo", "frag")
    each = written(live.mapInArrow(windows, "w binary, d bigint, s bigint, part bigint, lo bigint"), "hot-windows")
    erase(pieces)
    first = each.groupBy("w").agg(F.min(F.struct("d", "s", "lo")).alias("at"), F.count("*").alias("n")).where("n > 1").select("w", "at")
    later = each.join(first, "w").where(F.struct("d", "s", "lo") > F.col("at"))
    found = written(later.groupBy("d", "s", "part").agg(F.collect_list("lo").alias("los")).select("d", "s", "los").mapInArrow(ranges, "d bigint, s bigint, lo bigint, hi bigint"), "by-content")
    erase(each)
    return found


# --- the operator --------------------------------------------------------------------------


def covered_ranges(firsts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """d, s, lo, hi: covered byte ranges of the texts in `firsts` (d, s, text)."""
    spark = firsts.sparkSession

    def found(batches):
        for b in batches:
            texts = [t.encode() for t in b.column(2).to_pylist()]
            for k, lo, _, h in anchor_runs(texts, length, gram):
                k = pa.array(k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k), pa.array(lo), pa.array(h)], ["d", "s", "lo", "h"])

    long = firsts.where(F.octet_length("text") >= length).select("d", "s", "text")
    anchors = written(long.mapInArrow(found, "d bigint, s bigint, lo bigint, h bigint"), "anchors")
    counts = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    mine = written(anchors.join(counts, "h", "left_semi").groupBy("d", "s").agg(F.collect_set("h").alias("hs")), "repeated")
    erase(anchors)

    def fragments(batches):
        for b in batches:
            texts = [t.encode() for t in b.column(2).to_pylist()]
            wanted = [np.sort(x.values.to_numpy(zero_copy_only=False)) for x in b.column(3)]
            for k, lo, hi, h in anchor_runs(texts, length, gram):
                keep = np.zeros(len(k), bool)
                for doc in np.unique(k).tolist():
                    m = k == doc
                    keep[m] = np.isin(h[m], wanted[doc])
                k, lo, hi, h = k[keep], lo[keep], hi[keep], h[keep]
                name = [hashlib.blake2b(texts[x][i : j + length], digest_size=16).digest() for x, i, j in zip(k.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                k = pa.array(k)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(name, pa.binary()), b.column(0).take(k), b.column(1).take(k), pa.array(lo), pa.array(hi + length)], ["h", "name", "d", "s", "lo", "hi"])

    spec = "h bigint, name binary, d bigint, s bigint, lo bigint, hi bigint"
    every = written(long.join(mine, ["d", "s"]).select("d", "s", "text", "hs").mapInArrow(fragments, spec), "fragments")
    erase(mine)
    distinct = written(every.groupBy("h", "name").agg(F.min(F.struct("d", "s", "lo", "hi")).alias("at"), F.count("*").alias("n")), "distinct")
    # Equal fragments: all but the first occurrence are covered whole.
    later = every.join(distinct.where("n > 1").select("h", "name", "at"), ["h", "name"]).where(F.struct("d", "s", "lo", "hi") > F.col("at"))
    later = written(later.select("d", "s", "lo", "hi"), "later")
    erase(every)
    # Different fragments of one anchor: suffix sorting. Their bytes come from the texts again.
    several = distinct.groupBy("h").agg(F.count("*").alias("forms"), (F.sum(F.col("at.hi") - F.col("at.lo")) > shard).alias("hot")).where("forms > 1").select("h", "hot")
    sliced = distinct.join(several, "h").select("h", "at.*", "hot")
    sliced = written(sliced.groupBy("d", "s").agg(F.collect_list(F.struct("h", "lo", "hi", "hot")).alias("slices")), "slices")
    erase(distinct)

    def bytes_of(batches):
        for b in batches:
            for d, s, t, slices in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                raw = t.encode()
                yield pa.RecordBatch.from_pydict(
                    {"h": [x["h"] for x in slices], "d": [d] * len(slices), "s": [s] * len(slices), "lo": [x["lo"] for x in slices], "frag": [raw[x["lo"] : x["hi"]] for x in slices]},
                    pa.schema([*((c, pa.int64()) for c in ("h", "d", "s", "lo")), ("frag", pa.binary())]),
                )

    def heads(hot: bool) -> DataFrame:
        some = sliced.withColumn("slices", F.filter("slices", lambda x: x["hot"] == hot)).where(F.size("slices") > 0)
        return long.join(some, ["d", "s"]).select("d", "s", "text", "slices").mapInArrow(bytes_of, "h bigint, d bigint, s bigint, lo bigint, frag binary")

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def sort_shard(rows):
        rows.sort(key=lambda r: r[1:4])
        hit = repeated_windows([r[4] for r in rows], length)
        return pa.RecordBatch.from_pydict(
            {"d": [rows[f][1] for f, _, _ in hit], "s": [rows[f][2] for f, _, _ in hit], "lo": [rows[f][3] + a for f, a, _ in hit], "hi": [rows[f][3] + b for f, _, b in hit]},
            pa.schema([(c, pa.int64()) for c in ("d", "s", "lo", "hi")]),
        )

    def sort_shards(batches):
        rows, total = [], 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if total >= shard and r[0] != rows[-1][0]:
                    yield sort_shard(rows)
                    rows, total = [], 0
                rows.append(r)
                total += len(r[4])
        if rows:
            yield sort_shard(rows)

    sorted_heads = heads(False).repartition(parts, "h").sortWithinPartitions("h")
    by_suffix = written(sorted_heads.mapInArrow(sort_shards, "d bigint, s bigint, lo bigint, hi bigint"), "by-suffix")
    if sliced.where(F.exists("slices", lambda x: x["hot"])).limit(1).count():
        by_suffix = by_suffix.unionByName(_settle_by_content(heads(True), length, gram))
    erase(sliced)
    return later.unionByName(by_suffix)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    d = F.coalesce("doc_id", F.lit(LAST))
    s = F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint")
    meta = rows.select("doc_id", sha.alias("sha"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    meta = written(meta.groupBy("doc_id", "sha", "n_bytes").agg(F.count("*").alias("times")).withColumn("d", d).withColumn("s", s), "meta")
    least = meta.groupBy("sha").agg(F.min("d").alias("d"))
    first = meta.join(least, ["sha", "d"]).select("sha", "d", "s")
    keyed = rows.withColumn("sha", sha).withColumn("d", d)
    firsts = keyed.join(first, ["sha", "d"]).select("d", "s", "sha", "text")
    if meta.where("times > 1").limit(1).count():
        firsts = firsts.dropDuplicates(["d", "sha"])
    firsts = written(firsts, "firsts")
    ranges = covered_ranges(firsts, length, gram, shard)
    per_doc = ranges.groupBy("d", "s").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))

    def cut(batches):
        for b in batches:
            n, spans, kept = [], [], []
            for t, r in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                raw, at, left = t.encode(), 0, hashlib.sha256()
                merged = merge([(x["lo"], x["hi"]) for x in r])
                for lo, hi in merged:
                    left.update(raw[at:lo])
                    at = hi
                left.update(raw[at:])
                n.append(sum(y - x for x, y in merged))
                spans.append(len(merged))
                kept.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)], ["d", "sha", "n_removed", "n_spans", "kept_sha256"])

    touched = firsts.join(per_doc, ["d", "s"]).select("d", "s", "sha", "text", "ranges")
    touched = written(touched.mapInArrow(cut, "d bigint, sha string, n_removed bigint, n_spans bigint, kept_sha256 string"), "touched")
    erase(firsts)
    lead = first.select("sha", "d", F.lit(1).alias("leads"))
    out = meta.join(lead, ["sha", "d"], "left").join(touched, ["sha", "d"], "left")
    gone = F.col("leads").isNull() & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"),
    ).drop("copy")


#: DuckDB SQL of the same over whole texts, by windows as they are: documents have ids of their own.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substring(h, 2 * i + 1, {2 * LENGTH}) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS turn FROM w) WHERE turn > 1),
s AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM c)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS b FROM s GROUP BY doc_id, run),
p AS (SELECT r.doc_id, a, b, substring(h, CAST(2 * coalesce(lag(b) OVER o, 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(lag(b) OVER o, 0)) AS BIGINT)) AS piece FROM r JOIN d USING (doc_id) WINDOW o AS (PARTITION BY r.doc_id ORDER BY a)),
g AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS b, string_agg(piece, '' ORDER BY a) AS pieces FROM p GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(pieces, '') || substring(h, CAST(2 * coalesce(b, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
