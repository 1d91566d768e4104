"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy's exclusive-or
and bit counts. A tile holds fingerprints with the same population counts in
each of `parts` equal slices of the word; two tiles can hold a link only if
these counts differ by the radius at most in sum, so all other pairs of tiles
are skipped. Large tiles are split evenly. A pair of tiles emits a spanning
forest of the links it finds, never all pairs of a group, and connected
components join the forests.

Stages that ask for a similarity of word shingles instead: see `near_duplicates`.

Cost: comparing is quadratic in the documents of a band or of neighbouring
tiles; see the README for figures.

Defined results: a null text counts as an empty one; texts without words have
fingerprint zero; fewer words than a shingle make one shingle; null doc_ids are last when the smallest is
chosen; repeated rows share a component; an empty table gives an empty result;
extra columns do not take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

TILE = 2048


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(line[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of `h`, as an unsigned number."""
    if not len(h):
        return 0
    n = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        n += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * n > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number)."""

    def run(batches):
        for b in batches:
            fp = np.array([majority(shingle_hashes(t, width)) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def _part_counts(col, parts: int) -> list:
    size = 64 // parts
    mask = (1 << size) - 1 if size < 64 else -1
    return [F.bit_count(F.shiftrightunsigned(col, i * size).bitwiseAND(F.lit(mask).cast("bigint"))) for i in range(parts)]


def _offsets(parts: int, radius: int) -> list[list[int]]:
    """Differences of count vectors whose absolute sum is the radius at most, one of each pair of opposites."""
    out = []

    def extend(prefix: list[int], left: int) -> None:
        if len(prefix) == parts:
            if prefix >= [0] * parts:
                out.append(prefix)
            return
        for d in range(-left, left + 1):
            extend([*prefix, d], left - abs(d))

    extend([], radius)
    return out


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _close(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius; of a tile with itself, each pair once."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, radius: int, parts: int = 4, tile: int = TILE) -> DataFrame:
    """A spanning forest of all links between different fingerprints.

    fps: column fp, distinct. Returns (a, b)."""
    keyed = fps.select("fp", F.array(*_part_counts(F.col("fp"), parts)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("slots"))  # at most (64 / parts + 1) ** parts rows
    split = keyed.join(sizes, "key").withColumn("slot", F.pmod(F.xxhash64("fp"), F.col("slots")))
    tiles = written(split.groupBy("key", "slot").agg(F.collect_list("fp").alias("fps"), F.first("slots").alias("slots")), "tiles")
    # Which tiles meet is settled without their contents: a key within the radius, and each slot of it.
    shifts = F.array(*[F.array(*[F.lit(d) for d in o]) for o in _offsets(parts, radius)])
    plan = tiles.select(F.col("key").alias("own"), F.col("slot").alias("own_slot"), F.explode(shifts).alias("shift"))
    plan = plan.select("own", "own_slot", F.zip_with("own", "shift", lambda x, y: x + y).alias("key")).join(tiles.groupBy("key").agg(F.first("slots").alias("slots")), "key")
    same_key = F.col("own") == F.col("key")
    plan = plan.withColumn("slot", F.explode(F.sequence(F.when(same_key, F.col("own_slot")).otherwise(0), F.col("slots") - 1)))
    left = tiles.select(F.col("key").alias("own"), F.col("slot").alias("own_slot"), F.col("fps").alias("left"))
    met = plan.drop("slots").join(left, ["own", "own_slot"]).join(tiles.drop("slots"), ["key", "slot"])
    met = met.select("left", F.col("fps").alias("right"), (same_key & (F.col("own_slot") == F.col("slot"))).alias("same"))

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (0, 1))
                same = batch.column(2)[k].as_py()
                i, j = _close(a.view(np.uint64), b.view(np.uint64), radius, same)
                f = Forest(len(a) + len(b))
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if f.join(x, y if same else len(a) + y):
                        out_a.append(a[x])
                        out_b.append(b[y])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


def cluster(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    rows = written(fingerprints(docs, width), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(fps.select("fp"), radius), "simhash-cc")
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-named")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = named.join(lows, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
