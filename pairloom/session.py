"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for a context."""
    sc = spark.sparkContext
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in known or getattr(sc, "_pairloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "pairloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in (ROOT / "pairloom").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._pairloom_shipped = True


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`); in one process a temporary
    folder will do."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, shared, True)
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: what several readers need is computed once, and outlives executors.

    Its shuffle files go with the execution that made them, as the table takes their place."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
