"""Shared plumbing of the training-data operators: reading tables, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch are handled in slices of at most this many bytes of text (one longer text is a slice alone).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one input table; reading goes through Spark alone, so any store works."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset (tests, local mode)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark.sparkContext, "_brindle_dir", None)
        if where is None:
            where = spark.sparkContext._brindle_dir = tempfile.mkdtemp(prefix="brindle-")
    return where.rstrip("/")


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


class Tables:
    """The tables that one run of an operator writes into the shared folder.

    Writing a table and reading it back cuts the lineage, and survives lost executors. Tables lie in a folder named by the application.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/brindle-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and delete all tables that were written before; no frame over those may be used any more."""
        before, self.paths = self.paths, []
        out = self.write(df, name)
        _delete(df.sparkSession, before)
        return out

    def drop(self, spark: SparkSession) -> None:
        """Delete all of them."""
        before, self.paths = self.paths, []
        _delete(spark, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write one table that stays until the application's folder is deleted."""
    return Tables().write(df, name)


_worker: dict[str, str] = {}
_freed_between: list[Callable[[], None]] = []


def keeps(free: Callable[[], None]) -> None:
    """Register how to drop what a module keeps in a Python worker from task to task."""
    _freed_between.append(free)


def begin(operator: str) -> None:
    """At the start of a task's Python code: a reused worker first drops what another operator has left in it."""
    if _worker.get("operator", operator) != operator:
        for free in _freed_between:
            free()
        finish()
    _worker["operator"] = operator


def finish() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, longer if it is among ``taken`` (case-blind, as Spark resolves names)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> pa.Array:
    """A string column as binary values without copying; nulls stay."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        return column.view(pa.binary())
    if pa.types.is_large_string(column.type):
        return column.view(pa.large_binary())
    return column


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row slices of about ``limit`` bytes in ``column``, so that what a task derives from them stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(sizes) // limit
        at = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (uint64) so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
