"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_folder: ContextVar[str] = ContextVar("folder", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one is made only for a local session, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below that of the job that runs."""
    return f"{_folder.get() or shared_dir(spark).rstrip('/') + '/panelforge'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end; what must outlive them is written by ``materialize(..., keep=True)``."""
    path = scratch(spark, "job")
    before = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(before)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of the Arrow batches between Spark and Python while tables are written; both sides hold several of them at once.
BATCH_BYTES = "8m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder, so that a lost executor costs a re-read and not a re-run.

    ``keep`` puts it beside the folder of the job that runs, so that it stays when that is deleted.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if keep and _folder.get():
        path = "/".join([*_folder.get().split("/")[:-1], path.rsplit("/", 1)[1]])
    with small_batches(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column as one array, and where each row begins (n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def sliced(batches: Iterable[pa.RecordBatch], column: str, most: int = 900_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes (one row at least), so that memory stays bounded whatever the text lengths."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
