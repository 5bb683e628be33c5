"""Intermediate tables in the folder that driver and executors share.

A table written and read again cuts the lineage: an executor lost later costs
its running tasks only, and the optimiser sees the table's true size.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="logweir-")
    return _OWN[app]


class Scratch:
    """Tables of one operator call. ``drop`` removes one before the call ends; the rest stays for the lazy result."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, *partition_by: str) -> str:
        self.count += 1
        path = f"{self.base}/{self.count}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return path

    def keep(self, df: DataFrame, *partition_by: str, texts: bool = False, small: bool = False) -> DataFrame:
        """df, computed now, and read from its table from here on. texts: its rows go through Python as whole documents, in small batches.

        small: its rows are small, so they are dealt anew to a file a core, however many tasks make them. On a local file
        system Hadoop starts three processes a file, and each, until it has begun, counts with all memory of its executor.
        """
        if small:
            df = df.repartition(self.spark.sparkContext.defaultParallelism)
        with small_batches(self.spark) if texts else nullcontext():
            path = self.write(df, *partition_by)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._scratch_path)

    def release(self) -> None:
        """Has Spark delete the shuffle files of finished jobs now, not at some later garbage collection."""
        for _ in range(2):  # the first frees Python's hold on the plans, the second the plans
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def quoted(name: str) -> str:
    """A column's name as an expression: names may hold dots and other marks."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A name for an inner column that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Sealed:
    """A table under numbered column names, so that no name of the input's can clash with an inner one or break an expression.

    ``sealed[name]`` is a column's number name; ``kept`` are the number names of all but the operator's own columns; ``restored`` gives them their names back.
    """

    def __init__(self, df: DataFrame, *own: str):
        taken = {c.lower() for c in own}
        self.names = df.columns
        self.rows = df.toDF(*(f"in{i}" for i in range(len(self.names))))
        self.kept = [f"in{i}" for i, c in enumerate(self.names) if c.lower() not in taken]

    def __getitem__(self, name: str) -> str:
        return f"in{[c.lower() for c in self.names].index(name.lower())}"

    def restored(self, **changed: Column) -> list[Column]:
        return [changed.get(c, F.col(c)).alias(self.names[int(c[2:])]) for c in self.kept]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Holds Arrow batches to so many rows for the jobs run inside: a row is a whole document, and a batch of them lies in the JVM and in Python at once."""
    before = spark.conf.get(BATCH)
    hold_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def hold_batches(spark: SparkSession, rows: int = 512) -> None:
    """The same for a result that is computed later: the session's setting is lowered, if it is above, and stays so."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


def trim() -> None:
    """Gives back what this Python worker holds free: workers are used again, and the next stage's memory comes on top."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
