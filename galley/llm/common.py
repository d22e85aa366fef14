"""What the corpus operators share: the shared folder for intermediate tables, text defaults, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest side, in bytes as counted from its rows, that is sent whole to every executor.
BROADCAST_BYTES = 32 << 20
#: Largest batch that Spark hands to a worker at once: it lies in the executor's memory twice, on either side. Rows are the same.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one in local mode (tests), and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "galley-shared")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/galley"


def short_batches(spark: SparkSession) -> None:
    """From now on batches have BATCH_BYTES at most: Spark's own 64 MB let 10,000 texts, tens of MB, through at once. A size that the session has been given stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Tables written in the shared folder to cut lineage, so that a lost executor costs one stage and not the whole job.

    They live until drop() or the end of the driver process, as lazy results read them.
    """

    #: All that have not been dropped.
    live: set[Scratch] = set()

    def __init__(self, spark: SparkSession, what: str):
        short_batches(spark)
        self.spark, self.top = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.tables: list[str] = []
        self.live.add(self)
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.top}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        if not name:
            self.live.discard(self)
            self.drop_tables()
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception as gone:  # the session has ended before the process
            if self.spark._jsc.sc().isStopped():
                return
            raise gone


    def bucketed(self, df: DataFrame, name: str, buckets: int, *keys: str, by: str = "") -> DataFrame:
        """df as a table of the catalog whose files, in the folder `name`, are bucketed by the keys: joins and groups of equally bucketed tables need no shuffle. by: a column with a folder for each value. Rows are appended to a table that is there."""
        title = f"{self.top.rpartition('/')[2]}_{name}".replace("-", "_")
        writer = df.write.mode("append").bucketBy(buckets, *keys).option("path", f"{self.top}/{name}").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).saveAsTable(title)
        self.tables += [title] * (title not in self.tables)
        return self.spark.table(title)

    def drop_tables(self, name: str = "") -> None:
        """Takes bucketed tables (all, or the one of that name) out of the catalog."""
        for title in [t for t in self.tables if not name or t.endswith(f"_{name}".replace("-", "_"))]:
            self.tables.remove(title)
            if not self.spark._jsc.sc().isStopped():
                self.spark.sql(f"DROP TABLE IF EXISTS {title}")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")


def ascii_lower(c):
    """A-Z only, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is small enough to be sent whole; counts it."""
    return df.count() * row_bytes <= limit


def give_back() -> None:
    """The worker's free memory goes back to the system: it is used again by the tasks of later stages, next to their own needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives its free memory back."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return tidy


def freed(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function of one or two whole groups."""

    def tidy(*groups: pa.Table) -> pa.Table:
        try:
            return run(*groups)
        finally:
            give_back()

    # Spark tells a function with a key from one without by the number of its arguments
    return (lambda a: tidy(a)) if run.__code__.co_argcount == 1 else (lambda a, b: tidy(a, b))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes of text each, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


#: A key with over a HOT-th of the rows, and this many at least, is hot: there are fewer than HOT of them.
HOT, LEAST_HOT = 1000, 500


def join_named(rows: DataFrame, named: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with named (one row a key, with how many rows have it: size), inner or left.

    What is named for hot keys, fewer than HOT whatever the table's size, is sent to their rows, so no task gets them all.
    """
    least = max(LEAST_HOT, total // HOT)
    hot = F.broadcast(named.where(F.col(size) > least))
    met = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti").join(named.where(F.col(size) <= least), key, how)
    return met.union(rest.select(met.columns))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with a number after it if a column has it already."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n not in taken)
