"""Shared pieces of the training-data operators.

Tables that are cut out of a lineage go to the folder that the cluster shares
between driver and executors (``spark.checkpoint.dir``); a folder of our own is
made only where that setting is absent and the session runs in one process.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        made = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, made, True)
        spark.conf.set("spark.checkpoint.dir", made)
        return made
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nobody has used."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the intermediate tables made inside once it ends without an error; what is to last is written outside."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
        for path in made:
            _delete(spark, path)
    finally:
        _scopes.pop()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: While an intermediate table is written: rows and bytes of the batches that Python workers get, which is what a task
#: holds at once; and shuffle files go with the execution that made them, as the table takes their place.
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextlib.contextmanager
def writing(spark: SparkSession, rows: int | None = None):
    """The settings of WRITING for a while; `rows` a batch for tables of small rows."""
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in (WRITING | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})).items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lean(run):
    """A function over batches that gives freed memory back to the system when it ends: workers serve many stages."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def written(df: DataFrame, label: str, path: str | None = None, rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut in the lineage
    that outlives lost executors, and that two readers can use."""
    path = path or fresh_path(df.sparkSession, label)
    with writing(df.sparkSession, rows):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erase(df: DataFrame) -> None:
    """Delete the files behind a table of `written`, once nothing reads it."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of `df` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed_order(*cols: str):
    """Ascending order with nulls last, as a comparable struct of columns."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull().alias(f"{c}_absent"), F.col(c).alias(c)]
    return F.struct(*parts)


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of an undirected graph.

    `edges`: columns a, b (any orderable type, not null). Returns (node, root)
    for every node that has an edge; root is the smallest node reachable.

    Alternates large-star and small-star contraction. Each half round is an
    aggregate of the smallest neighbour (combined map-side, so a hub costs one
    row per task) and an equi-join; no neighbour list is gathered. Rounds end
    when the edge set, compared by count and an order-free hash, stands still;
    the number of rounds grows with the logarithm of the longest path.
    """
    current = written(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, both.a == low.u)
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        low2 = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (
            large.join(low2, large.a == low2.u)
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = written(small, label)
        erase(current)
        current, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame):
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s")).first()
    return row.n, row.s
