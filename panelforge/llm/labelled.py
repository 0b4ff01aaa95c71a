"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of text that a sample holds at most, and those of one of its texts.
MOST_BYTES, LONGEST = 32 << 20, 512 << 10


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, most: int, keep: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, text of at most ``most`` labelled rows and ``MOST_BYTES`` bytes, chosen by a hash of their ids.

    Labels other than 0 and 1, ids with contradicting labels, labels or documents without an id, and texts of over
    ``LONGEST`` bytes are left out; of a repeated id one text is taken. The chosen ids number at most ``most``, which
    bounds what is broadcast; their texts' bytes bound what the driver gets.
    """
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if keep is not None:
        named = named.where(keep)
    sure = named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    chosen = sure.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    # a window over at most ``most`` numbers
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.where(F.col("n") <= LONGEST).withColumn("total", F.sum("n").over(before)).where(F.col("total") <= MOST_BYTES)
    fits = materialize(fits.select("doc_id", "label"), "labelled-ids")
    return texts.join(F.broadcast(fits), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.max("text").alias("text"))
