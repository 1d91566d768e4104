"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (of 3 to 5 characters,
with word edges) and of itself; the words of a window are averaged and go
through a linear softmax. A document scores like its most toxic window, so a few
words count the same in a short and in a very long text. Vectors and softmax are
trained jointly in numpy by full-batch descent with momentum, on the window that scores highest
in each document. Misspelt and unseen words share the n-grams of known ones.

The classifier is fitted on a bounded sample of labelled rows: per class the
`per_class` rows with the smallest seeded hash of doc_id, and of these the first
TRAINING_BYTES bytes of whole texts (one text a doc_id). Everything is scored.

Defined results: a null or empty text has no words and gets the score of the
bias alone; a null doc_id is held out; repeated labels of a document count as
toxic if one of them is; documents without labels are only scored; with no
training rows, or of one class alone, every score is 0; repeated rows get equal
scores; extra columns do not take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Training rows of each class at most.
PER_CLASS = 1500
#: Bytes of their texts at most: what the driver holds.
TRAINING_BYTES = 64 << 20
WINDOW, STRIDE, SHORTEST = 8, 4, 4
SIZES = (3, 4, 5)
DIM = 8
_EDGES = ".,;:!?\"'()[]{}<>*&%$#|-_=+/\\"


def grams(word: str) -> list[str]:
    """The subwords of a raw word."""
    w = word.lower().strip(_EDGES)
    if not w:
        return []
    edged = f"<{w}>"
    return list({edged, *(edged[i : i + n] for n in SIZES for i in range(len(edged) - n + 1))})


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words; one empty window for none."""
    if n <= WINDOW:
        return np.array([0]), np.array([n])
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    starts = np.minimum(starts, n - WINDOW)
    return starts, starts + WINDOW


class Model:
    """The trained weights, folded into one number for each n-gram."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def word(self, w: str) -> float:
        bare = w.lower().strip(_EDGES)
        if bare != w:
            v = self.words.get(bare)
            if v is not None:
                return v
        got = [x for g in grams(bare) if (x := self.weights.get(g)) is not None]
        v = self.words[bare] = sum(got) / len(got) if got else 0.0
        return v

    def score(self, text: str | None) -> float:
        memo = self.words
        if len(memo) > 400_000:
            memo.clear()
        words = (text or "").split()
        values = []
        for w in words:
            v = memo.get(w)
            if v is None:
                v = memo[w] = self.word(w)
            values.append(v)
        at = np.concatenate([[0.0], np.cumsum(values)]) if values else np.zeros(1)
        s, e = windows(len(words))
        best = float(((at[e] - at[s]) / np.maximum(e - s, SHORTEST)).max()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(best, -40, 40))))


def train(texts: list[str], toxic: list[int], rounds: int = 80, rate: float = 2.0, decay: float = 1e-3, seed: int = 5, least: int = 8) -> Model | None:
    """Fit on whole texts; None without both classes."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return None
    number: dict[str, int] = {}
    docs = [[number.setdefault(w, len(number)) for w in (t or "").split()] for t in texts]
    seen: dict[str, int] = {}
    lists = [np.array([seen.setdefault(g, len(seen)) for g in grams(w)], np.int32) for w in number]
    df = np.zeros(len(seen), np.int64)
    for d in docs:
        if d:
            df[np.unique(np.concatenate([lists[w] for w in set(d)]))] += 1
    names = sorted(g for g, i in seen.items() if df[i] >= least)
    if not names:
        return None
    known = {g: i for i, g in enumerate(names)}
    place = np.full(len(seen), -1, np.int64)
    place[[seen[g] for g in names]] = np.arange(len(names))
    del seen
    w_of = np.repeat(np.arange(len(number)), [len(x) for x in lists])
    g_of = place[np.concatenate(lists)]
    w_of, g_of = w_of[g_of >= 0], g_of[g_of >= 0]
    del lists
    per_word = 1 / np.maximum(np.bincount(w_of, minlength=len(number)), 1)
    tokens = np.array([w for d in docs for w in d], np.int64)
    base = np.cumsum([0, *map(len, docs)])
    parts = [windows(len(d)) for d in docs]
    start = np.concatenate([s + b for (s, _), b in zip(parts, base, strict=False)])
    end = np.concatenate([e + b for (_, e), b in zip(parts, base, strict=False)])
    first = np.cumsum([0, *(len(s) for s, _ in parts)])
    size = np.maximum(end - start, SHORTEST)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(known), DIM))
    soft = rng.normal(0, 0.3, (2, DIM))
    bias = np.array([0.0, np.log(y.mean() / (1 - y.mean()))])
    state = [np.zeros_like(p) for p in (emb, soft, bias)]
    for t in range(1, rounds + 1):
        u = soft[1] - soft[0]
        by_word = np.bincount(w_of, (emb @ u)[g_of], len(number)) * per_word
        at = np.concatenate([[0.0], np.cumsum(by_word[tokens])])
        each = (at[end] - at[start]) / size
        # Each document's best window; early on its windows' mean guides the search.
        top = np.array([first[k] + int(each[first[k] : first[k + 1]].argmax()) for k in range(len(docs))])
        p = 1 / (1 + np.exp(-np.clip(each[top] + bias[1] - bias[0], -40, 40)))
        d = (p - y) / len(y)
        slope = np.zeros(len(tokens) + 1)
        np.add.at(slope, start[top], d / size[top])
        np.add.at(slope, end[top], -d / size[top])
        d_word = np.bincount(tokens, np.cumsum(slope)[:-1], len(number)) * per_word
        d_gram = np.bincount(g_of, d_word[w_of], len(known))
        d_u = emb.T @ d_gram
        grads = (np.outer(d_gram, u) + decay / len(known) * emb, np.stack([-d_u, d_u]), np.array([-d.sum(), d.sum()]))
        # Momentum with one step length for all vectors: the n-grams that many
        # documents agree on move most, and those of single documents hardly.
        for param, m, g in zip((emb, soft, bias), state, grads, strict=True):
            m *= 0.8
            m += g
        emb -= rate * state[0] / (np.abs(state[0]).max() + 1e-12)
        soft -= 0.02 * rate * state[1] / (np.abs(state[1]).max() + 1e-12)
        bias -= 0.1 * rate * state[2] / (np.abs(state[2]).max() + 0.02)
    folded = emb @ (soft[1] - soft[0])
    return Model({g: float(folded[i]) for g, i in known.items()}, float(bias[1] - bias[0]))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 11) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded training sample."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    open_rows = known.where(fold() != 0).withColumn("turn", F.xxhash64(F.lit(seed), "doc_id"))
    picked = open_rows.where("toxic = 1").orderBy("turn", "doc_id").limit(per_class).unionByName(open_rows.where("toxic = 0").orderBy("turn", "doc_id").limit(per_class))
    ids = picked.select("doc_id", "toxic", "turn")  # at most 2 * per_class rows: safe to broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("turn").alias("turn"))
    so_far = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy("turn", "doc_id"))  # 2 * per_class rows
    got = one.withColumn("so_far", so_far).where(F.col("so_far") <= TRAINING_BYTES).select("doc_id", "text", "toxic").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
    return [r[1] for r in rows], [r[2] for r in rows]


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(*training_rows(docs, labels, per_class))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias) if model else None)

    def run(batches):
        own = Model(*shared.value) if shared.value else None
        for b in batches:
            s = [own.score(t) if own else 0.0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint"), (fold() == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
