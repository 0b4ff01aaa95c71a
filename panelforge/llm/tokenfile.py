"""Operator 10: token ids in Parquet list columns.

Documents are put in ascending id order by a range shuffle, encoded where they lie, and written with dictionary pages for
ids (``encoding="dictionary"``) or delta pages (``"delta"``), row groups and pages of a stated size, and the page indexes
that Parquet's writer adds. Counts and offsets are columns of their own, so metadata reads never touch an id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, sliced, small_batches, table
from .tokens import encoder

#: ``part``, ``row``: the file's place in the order and the row's place in it; ``part_start``: ids before it in the part.
SCHEMA = "doc_id long, part int, row long, part_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000) -> None:
    """Encode every whole text and write one row per document in ascending id order.

    Null or empty text: the end id alone. Null ids come first; rows with one id are ordered by text; repeated rows are all
    kept. An empty table gives files without rows. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, row, total = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        for batch in sliced(batches, "text", 1_500_000):
            ids, at = coder.encode(batch.column(1).to_pylist())
            n = batch.num_rows
            sizes = np.diff(at) + 1
            ends = np.cumsum(sizes)
            out = np.full(int(ends[-1]), end_id, np.int32)
            out[np.arange(len(ids)) + np.repeat(np.arange(n), sizes - 1)] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(row + np.arange(n)), pa.array(total + ends - sizes), pa.array(sizes), lists], ["doc_id", "part", "row", "part_start", "n_tokens", "ids"])
            row, total = row + n, total + int(ends[-1])

    dictionary = encoding == "dictionary"
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(dictionary).lower(), "parquet.writer.version": "v1" if dictionary else "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows}
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(encode, SCHEMA).write.options(**options).parquet(path, compression="zstd")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, from the metadata columns alone."""
    meta = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "part_start", "n_tokens")
    return _placed(spark, path, meta).select("doc_id", "start", "n_tokens")


def read_ids(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id and ids of the documents with ``low <= doc_id < high``; row groups and pages outside are skipped by their statistics."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "ids")
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") < high)


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds ``start``: what all earlier parts hold, plus what the part holds before the row. One row a file is broadcast."""
    totals = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("held")).collect()
    before, sums = 0, []
    for part, held in sorted(map(tuple, totals)):
        sums.append((part, before))
        before += held
    starts = spark.createDataFrame(sums, "part int, before long")
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("part_start"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens and the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            # ids are below 2^31, so signed and unsigned ones are the same bytes
            flat = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "part_start", "ids").mapInArrow(crc, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    # written through small Arrow batches: what comes back is a few numbers a document
    return _placed(spark, path, materialize(rows, "checksums")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by the 50k byte-level file, end id 0, written and read back."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(spark, path)
