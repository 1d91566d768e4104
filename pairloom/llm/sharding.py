"""Two-pass external shuffle into shards.

Pass 1 scatters records uniformly into memory-sized buckets: a seeded hash of
doc_id picks the shard, a second one of doc_id and text the bucket inside it, so
rows of one id spread over the buckets of their shard. Pass 2 takes one bucket at
a time, puts it into a fixed order, shuffles it by Fisher-Yates with a seed drawn
from the bucket's number, and writes it. Slots are gapless: prefix sums over
bucket counts, taken beforehand from ids and hashes alone, give each bucket its
base. Texts are shuffled once; equal rows of a bucket are held once, with a count.

The law is `key`: jump consistent hashing, so doc_id, seed and shard count alone
decide, and growing by one shard moves rows only into the new one.

Defined results: a null doc_id hashes like a fixed value of its own; a null text
has size 8 and the checksum of no bytes, and stays null in the shard; repeated
rows keep their own slots; equal doc_ids share a shard; an empty table gives an
empty result; extra columns do not take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, writing, written

#: Bytes of text in a bucket of pass 2.
BUCKET_BYTES = 24 << 20
#: Tasks of pass 2 at most; a task takes several buckets, one after the other, where there are more.
TASKS = 50_000
#: Rows of the table of buckets (20 bytes each) that may be broadcast; beyond that it is shuffled to them.
BUCKET_ROWS = 200_000


def _seeded(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])


def jump(ids: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys (Lamping and Veach, 2014)."""
    key = ids.astype(np.uint64)
    b = np.full(len(key), -1, np.int64)
    j = np.zeros(len(key), np.int64)
    live = j < shards
    while live.any():
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = j < shards
    return b


def place(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """docs plus shard and grown_shard, by the key law. Needs column `key64`."""

    def run(batches):
        for b in batches:
            keys = b.column(b.schema.get_field_index("key64")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(jump(keys, shards), pa.int32()), pa.array(jump(keys, shards + 1), pa.int32())],
                [*b.schema.names, "shard", "grown_shard"],
            )

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", shard int, grown_shard int"
    return docs.mapInArrow(run, spec)


def _runs(batches):
    """Buckets one at a time, from rows sorted by bucket, id and text: shard, bucket,
    base, the different rows, and how often each occurs."""
    held: list[pa.Table] = []

    def bucket(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
        starts = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1] or texts[k] != texts[k - 1]]
        times = np.diff([*starts, len(ids)])
        return t.take(pa.array(starts)), times

    def finished(parts):
        distinct, times = zip(*(bucket([b]) for b in parts), strict=True)
        return pa.concat_tables(distinct).combine_chunks(), np.concatenate(times)

    for b in batches:
        key = b.column("shard").to_numpy().astype(np.int64) << 32 | b.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(b)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(x, y - x)
            if held and (held[0].column("shard")[0] != part.column("shard")[0] or held[0].column("bucket")[0] != part.column("bucket")[0]):
                yield finished(held)
                held = []
            held.append(part)
    if held:
        yield finished(held)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards as Parquet under path/shard=N and return the table read
    back: doc_id, text, grown_shard, slot, shard."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    keyed = rows.withColumn("key64", _seeded(seed, "doc_id")).withColumn("bucket", F.pmod(_seeded(seed + 1, "doc_id", "text"), F.lit(per_shard)).cast("int"))
    sizes = written(place(keyed.select("key64", "bucket"), shards, seed).groupBy("shard", "bucket").agg(F.count("*").alias("n")), "buckets")
    order = Window.partitionBy("shard").orderBy("bucket")
    bases = sizes.select("shard", "bucket", (F.sum("n").over(order) - F.col("n")).alias("base"))  # one row a bucket
    n = max(1, min(shards * per_shard, TASKS))
    placed = place(keyed, shards, seed).drop("key64")
    if shards * per_shard <= BUCKET_ROWS:  # one bucket a task, while there are tasks enough
        based = placed.join(F.broadcast(bases), ["shard", "bucket"]).repartitionById(n, ((F.col("shard") * per_shard + F.col("bucket")) % n).cast("int"))
    else:  # the join keeps the partitioning by bucket
        based = placed.repartition(n, "shard", "bucket").join(bases.repartition(n, "shard", "bucket").hint("merge"), ["shard", "bucket"])

    def shuffled(batches):
        for distinct, times in _runs(batches):
            shard, bucket, base = (distinct.column(c)[0].as_py() for c in ("shard", "bucket", "base"))
            # The order of equal rows is of no account: they stand in for each other. numpy's permutation is Fisher-Yates.
            turn = np.repeat(np.arange(len(times)), times)[np.random.default_rng([seed, shard, bucket]).permutation(int(times.sum()))]
            for at in range(0, len(turn), 2000):
                some = distinct.select(["doc_id", "text", "grown_shard"]).take(pa.array(turn[at : at + 2000])).combine_chunks().to_batches()[0]
                slots = pa.array(np.arange(base + at, base + at + len(some)), pa.int64())
                yield pa.RecordBatch.from_arrays([*some.columns, slots, pa.array(np.full(len(some), shard), pa.int32())], ["doc_id", "text", "grown_shard", "slot", "shard"])

    spec = "doc_id bigint, text string, grown_shard int, slot bigint, shard int"
    fixed = based.sortWithinPartitions("shard", "bucket", "doc_id", "text").select("doc_id", "text", "shard", "grown_shard", "bucket", "base")
    with writing(spark):
        fixed.mapInArrow(shuffled, spec).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(spec).parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    """The contract's columns, from the shards as read back."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def shard(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    return digest(write_shards(docs, fresh_path(docs.sparkSession, "shards"), shards, seed))
