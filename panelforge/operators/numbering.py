"""Row numbers over a whole table without a task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def numbered(df: DataFrame, order: Sequence[str], name: str = "number", first: int = 1) -> DataFrame:
    """``df`` with a gapless row number by ``order`` (NULLs first), from ``first`` on; rows that are equal there are in any order.

    In two levels: rows are dealt out by ranges of ``order`` and counted within each range, then each range gets the
    number of rows before it. What one task sees of all rows is one count a range.
    """
    # of such an id the low 33 bits count the rows of a partition
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    placed = ranges.join(F.broadcast(before), "_range")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") + first).alias(name))


def numbered_ids(ids: DataFrame, id_col: str) -> DataFrame:
    """id, no: each distinct id with its number in the order of ids, from 0 on."""
    return cut(numbered(ids.select(F.col(id_col).alias("id")).where("id is not null").distinct(), ["id"], "no", 0))
