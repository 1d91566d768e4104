"""Quality rules by weak supervision.

Every rule looks at one document and votes good (+1), bad (-1) or abstains (0).
No rule decides by itself: expectation-maximisation over the counts of vote
patterns estimates how accurate each rule is on good and on bad documents, and
the posterior probability of "good" replaces all-must-pass filtering.

The statistics cover all documents: votes become one pattern number, patterns
are counted by Spark (at most 3 ** rules rows, so the table that reaches the
driver has a fixed bound), and EM runs on the counts.

Defined results: a null text counts as an empty one; an empty text has zero
words, fails the base rule and is not kept; repeated rows get the same verdict;
an empty table gives an empty result; columns other than doc_id and text are
not read by `score`, and pass unchanged through `keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

SYMBOLS = "#*$%&|<>"
#: Rule names, in the order of the digits of a pattern number.
RULES = ("enough_words", "few_repeats", "few_symbols", "few_duplicate_lines", "word_length", "letters", "not_shouting", "ends_in_prose", "no_markup")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of `width` that occur twice or more, the first included.

    Exact: words are numbered by equality, and windows by pairing the numbers of
    their halves, so no hash can confuse two windows.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    names, covered, size = ids, 1, len(number)
    while covered < width:
        step = min(covered, width - covered)
        pair = names[: n - covered - step + 1] * size + names[step : n - covered + 1]
        _, names = np.unique(pair, return_inverse=True)
        covered, size = covered + step, int(names.max()) + 1
    counts = np.bincount(names)
    starts = np.flatnonzero(counts[names] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # on \x20 and \x09-\x0D only
    blank = sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    return len(words), len(text) - blank, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(words)


def votes_of(text: str | None, c: tuple[int, int, int, int, int]) -> list[int]:
    """One vote for each of RULES."""
    text = text or ""
    n, chars, symbols, dup, repeat = c
    if not n:
        return [-1] + [0] * (len(RULES) - 1)
    lines = text.count("\n") + 1
    mean = chars / n
    upper = sum(map(str.isupper, sample)) if (sample := text.split()) else 0
    alpha = sum(ch.isalpha() for ch in text) / max(1, chars)
    tail = text.rstrip()[-1:]
    return [
        -1 if n < 10 else 1 if n >= 30 else 0,
        -1 if 100 * repeat > 20 * n else 1 if 100 * repeat <= 5 * n else 0,
        -1 if 10 * symbols > n else 1 if 100 * symbols <= n else 0,
        -1 if dup > 1 and 10 * dup > 3 * lines else 1 if dup == 0 else 0,
        -1 if mean < 2 or mean > 12 else 1 if 2.5 <= mean <= 9 else 0,
        -1 if alpha < 0.7 else 1 if alpha >= 0.75 else 0,
        -1 if 2 * upper > n else 1 if 20 * upper <= n else 0,
        1 if tail in ".!?\"'" else 0,
        -1 if 4 * symbols > n else 0,
    ]


def pattern_of(votes: list[int]) -> int:
    """The votes as digits to base 3."""
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def votes_from(pattern: int) -> list[int]:
    out = []
    for _ in RULES:
        out.append(pattern % 3 - 1)
        pattern //= 3
    return out[::-1]


def fit(patterns: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior probability of "good" for every vote pattern, by EM.

    The model: a document is good with probability p; given that, rules vote
    independently, each with its own chances of good, bad and abstain. The start
    is the vote majority, and pseudo-counts tie a rule's chances to a prior that
    it is right more often than wrong, which fixes which class is "good".
    """
    if not patterns:
        return {}
    keys = list(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    v = np.array([votes_from(k) for k in keys])
    one_hot = np.stack([v == -1, v == 0, v == 1], 2).astype(float)  # pattern, rule, vote
    total = weight.sum()
    prior = {True: np.array([0.05, 0.15, 0.8]), False: np.array([0.4, 0.2, 0.4])}
    strength = max(1.0, 0.02 * total)
    good = 1 / (1 + np.exp(-(v == 1).sum(1) + 4.0 * (v == -1).sum(1)))
    for _ in range(rounds):
        p = float(np.clip((weight * good).sum() / total, 0.05, 0.95))
        log = []
        for side, r in ((True, good), (False, 1 - good)):
            c = np.einsum("p,prv->rv", weight * r, one_hot) + strength * prior[side]
            c /= c.sum(1, keepdims=True)
            log.append(np.einsum("prv,rv->p", one_hot, np.log(c)) + np.log(p if side else 1 - p))
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return {k: float(g) for k, g in zip(keys, good, strict=True)}


def _features(batches):
    for b in batches:
        rows = [(c := counts_of(t), pattern_of(votes_of(t, c))) for t in b.column(1).to_pylist()]
        cols = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([r[1] for r in rows], pa.int32())], ["doc_id", *COUNTS, "pattern"])


def base_failed():
    """The base rule, over the count columns."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the five counts, base_failed, quality (posterior), kept."""
    spec = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", pattern int"
    rows = written(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lean(_features), spec), "quality")
    found = {r.pattern: r.n for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # 3 ** rules rows at most
    posterior = docs.sparkSession.createDataFrame(sorted(fit(found).items()), "pattern int, quality double")
    return (
        rows.join(F.broadcast(posterior), "pattern", "left")
        .withColumn("base_failed", base_failed())
        .select("doc_id", *COUNTS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose verdict is "kept", all columns unchanged.

    The verdict depends on the text alone, so it is taken again from the row
    itself: no join by doc_id, and null or repeated ids stay what they are.
    """
    at = docs.columns.index("text")

    def pattern_only(batches):
        for b in _features(pa.RecordBatch.from_arrays([b.column(0)] * 2, ["doc_id", "text"]) for b in batches):
            yield b.select(["pattern"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(lean(pattern_only), "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    posterior = fit({r.pattern: r.n for r in found})

    def keep(batches):
        for b in batches:
            mask = []
            for t in b.column(at).to_pylist():
                c = counts_of(t)
                failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
                mask.append(not failed and posterior.get(pattern_of(votes_of(t, c)), 0.0) >= threshold)
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
