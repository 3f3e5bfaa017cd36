"""Tables in the shared checkpoint folder: cut lineage, survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE = threading.local()
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session makes a folder and sets it; on a cluster it is an error,
    as every executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="harrow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def files_of(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    files, at = files_of(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def removed(spark: SparkSession, path: str) -> None:
    files, at = files_of(spark, path)
    files.delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. What is written there goes when the session ends, or the block of temporary() around it."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = files_of(spark, path)
    files.deleteOnExit(at)
    if getattr(_MADE, "blocks", None):
        _MADE.blocks[-1].append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """What this thread stores in the block goes at its end; tables that are read later must be elsewhere by then."""
    _MADE.blocks = [*getattr(_MADE, "blocks", []), []]
    try:
        yield
    finally:
        *_MADE.blocks, made = _MADE.blocks
        for path in made:
            removed(spark, path)


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """The shuffle files of a query that is run in the block go at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with tidied(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
