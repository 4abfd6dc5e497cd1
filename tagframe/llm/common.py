"""What the operators of this subpackage share: reading, staging, defined inputs.

Staging: an operator that needs a result twice, or that must not be recomputed
when an executor is lost, writes it as Parquet under ``spark.checkpoint.dir``
(shared by driver and executors) and reads it back. That cuts the lineage with
files instead of blocks in executor memory. So an operator may run jobs when it is
called, before its result is asked for; what its result reads stays until drop_staged().
The shuffle files behind a staged table go as soon as it is written.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        # Set by setCheckpointDir() instead of the configuration.
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tagframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tagframe-{app}/{name}-{uuid.uuid4().hex}"


#: Paths of the staged tables that are still there, in the order of their writing.
STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, at once, and return the reread table."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    with small_batches(spark), no_shuffles_left(spark):
        df.write.parquet(path)
    STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the staged tables from number ``since`` on, apart from the last ``but``; call it when the results made of them are written."""
    gone = STAGED[since : len(STAGED) - but]
    for path in gone:
        drop_path(spark, path)
    del STAGED[since : since + len(gone)]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> Iterator[None]:
    """Meanwhile texts go to Python in batches of that many rows and bytes: Spark's 10,000 long texts need much memory on both sides."""
    with changed(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}):
        yield


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a query's shuffle files go when it ends: else they stay on the executors' disks until the driver collects its garbage."""
    with changed(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextmanager
def changed(spark: SparkSession, keys: dict[str, str]) -> Iterator[None]:
    """Meanwhile the session has these settings."""
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give free memory of this Python worker back: it may stay idle beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
