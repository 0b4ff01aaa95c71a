"""Operator 1: exact histogram of encoded lengths.

Documents are encoded where they are read; each task sends only (length, documents) pairs. Suffix sums over the
histogram then answer totals, quantiles and truncated totals for every context limit without another look at the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, sliced, table
from .tokens import encoder

#: Lengths a range holds in the two-level sums.
RANGE = 1024


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """n_tokens, docs: how many documents have that encoded length. Null and empty texts have length 0; repeated rows count each time; an empty table gives no rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = encoder(tokenizer), Counter()
        for batch in sliced(batches, "text", 1_500_000):
            _, at = coder.encode(batch.column(0).to_pylist())
            seen.update(dict(zip(*(x.tolist() for x in np.unique(np.diff(at), return_counts=True)))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "docs"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "n_tokens long, docs long").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length: documents and tokens of at least that length, documents up to it, and the total after truncation to it.

    Sums run in two levels, over ranges of lengths and inside each range, so no task sorts the whole histogram. It is
    written first, as it is read twice: the documents are encoded once.
    """
    h = materialize(histogram, "length-histogram").select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / RANGE).alias("_range"))
    ranges = h.groupBy("_range").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("_range", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t"), F.sum("_d").over(every).alias("_all_d"), F.sum("_t").over(every).alias("_all_t"))
    inside = Window.partitionBy("_range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = h.withColumn("docs_ge", F.sum("docs").over(inside)).withColumn("tokens_ge", F.sum("tokens").over(inside)).join(ranges, "_range")
    x = x.withColumn("docs_ge", F.col("docs_ge") + F.col("_d")).withColumn("tokens_ge", F.col("tokens_ge") + F.col("_t"))
    return x.select("n_tokens", "docs", "tokens", "docs_ge", "tokens_ge", (F.col("_all_d") - F.col("docs_ge") + F.col("docs")).alias("docs_le"), (F.col("_all_t") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"))


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, total: tokens left when every document is cut to the limit, for limits that need not be lengths.

    With no length at or above the limit nothing is cut. The limits are a stated list.
    """
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # below the limit all tokens count; from it on, the limit counts for each document: both follow from the suffix sums
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all"))
    above = sums.select("n_tokens", "docs", "tokens").join(F.broadcast(asked), F.col("n_tokens") > F.col("context_limit")).groupBy("context_limit").agg(F.sum(F.col("tokens") - F.col("context_limit") * F.col("docs")).alias("_cut"))
    return asked.join(above, "context_limit", "left").join(F.broadcast(total)).select("context_limit", (F.col("_all") - F.coalesce("_cut", F.lit(0))).alias("total"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least that share of the documents does not exceed. No rows for an empty histogram."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    n = sums.agg(F.sum("docs").alias("_n"))
    return sums.join(F.broadcast(n)).join(F.broadcast(asked), F.col("docs_le") >= F.ceil(F.col("share") * F.col("_n"))).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram and suffix sums of all ``documents`` by the 50k byte-level file."""
    import public_tokenizers

    return suffix_sums(length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
