"""Joins and per-key selections: as-of, validity intervals, latest row, alignment by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidValue, RowMismatch


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise InvalidValue(f"missing columns: {', '.join(missing)}")
    return df


def check_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises if a key of ``left`` isn't in ``right``."""
    if n := left.join(right, key, "left_anti").count():
        raise RowMismatch(f"{n} rows have no counterpart by {key}")


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, columns: Sequence[str], tolerance_days: int | None = None, tie: str | None = None, slices: Callable[[F.Column], F.Column] | None = None) -> DataFrame:
    """For each left row the right row of its key with the latest ``right_at`` not after ``at``; NULLs where there is none.

    Both sides are stacked and the last right row is carried forward in one window: linear in the rows, whatever the
    number of matches. Right rows come first on equal dates; of equal right dates the greatest ``tie`` wins. A match
    older than the tolerance counts as none. Dates are compared as they are; the tolerance needs dates or timestamps.

    For keys that hold a large share of the rows, ``slices`` cuts time into slices, such as ``F.year`` (it must not fall as
    dates rise): a key's slices are tasks of their own, and the last right row of each is carried to the slices after it,
    by a window over one row a slice. The rows that come out are the same.
    """
    names = [*dict.fromkeys([right_at, *columns])]
    a = left.select(F.col(by).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    b = right.where(F.col(right_at).isNotNull()).select(F.col(by).alias("_k"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in names]).alias("_r"), (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    x = a.unionByName(b, allowMissingColumns=True)
    part = ["_k"]
    if slices is not None:
        x, part = x.withColumn("_slice", slices(F.col("_at"))), ["_k", "_slice"]
    w = Window.partitionBy(*part).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = x.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if slices is not None:
        ends = x.groupBy(*part).agg(F.max_by(F.when(F.col("_side") == 0, F.col("_r")), F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"))
        before = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*part, F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
        matched = matched.join(carried, part, "left").withColumn("_m", F.coalesce("_m", "_carried"))
    match = F.when(F.col("_k").isNotNull() & F.col("_at").isNotNull(), F.col("_m"))
    if tolerance_days is not None:
        match = F.when(F.datediff(F.col("_at"), F.col("_m")[right_at]) <= tolerance_days, match)
    return matched.withColumn("_m", match).select("_l.*", *[F.col("_m")[c].alias(c) for c in names])


def latest_per_key(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: partial aggregation over structs, no sort."""
    rest = [c for c in df.columns if c != by]
    best = df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return best.select(by, *[F.col("_r")[c].alias(c) for c in rest])


def _open_end(df: DataFrame, end: str) -> F.Column:
    """An end that is missing, or 0 where ends are numbers."""
    c = df[end]
    return c.isNull() | (c == 0) if dict(df.dtypes)[end] in ("int", "bigint", "smallint") else c.isNull()


def valid_at(df: DataFrame, day: F.Column, start: str = "in_date", end: str = "out_date") -> DataFrame:
    """Rows whose interval holds ``day``: started, and not ended (an end that is NULL or 0 is open; the end itself is outside)."""
    return df.where((F.col(start) <= day) & (_open_end(df, end) | (F.col(end) > day)))


def membership_join(facts: DataFrame, members: DataFrame, by: str, at: str, columns: Sequence[str], start: str = "in_date", end: str = "out_date") -> DataFrame:
    """Facts with the columns of the membership valid at their date; of several valid ones the latest start wins as a whole row.

    A key has few memberships: they are one array a key, so that facts are read and joined once and each row looks its own up.
    """
    until = F.when(~_open_end(members, end), F.col(end))
    m = members.where(F.col(start).isNotNull()).groupBy(F.col(by).alias("_k")).agg(F.collect_list(F.struct(F.col(start).alias("_from"), until.alias("_to"), F.struct(*columns).alias("_m"))).alias("_ms"))
    x = facts.join(m, facts[by] == m["_k"], "left")
    day = facts[at]
    valid = F.filter("_ms", lambda s: (s["_from"] <= day) & (s["_to"].isNull() | (s["_to"] > day)))
    best = F.array_max(F.transform(valid, lambda s: F.struct(s["_from"].alias("_from"), s["_m"].alias("_m"))))
    return x.withColumn("_best", best).select(*[facts[c] for c in facts.columns], *[F.col("_best._m")[c].alias(c) for c in columns])


def align_vectors(keys: DataFrame, vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """All keys with their vector, zeros where there is none."""
    zero = F.array_repeat(F.lit(0.0), size)
    return keys.join(vectors.select(key, vector), key, "left").withColumn(vector, F.coalesce(F.transform(vector, lambda x: x.cast("double")), zero))


def match_share(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """matched, total and their ratio."""
    hit = left.join(right.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(F.count("_hit").alias("matched"), F.count("*").alias("total")).withColumn("share", F.col("matched") / F.nullif(F.col("total"), F.lit(0)))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[F.Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def fold_rare(df: DataFrame, column: str, k: int, other: str = "other") -> DataFrame:
    """Values of ``column`` beyond the k most frequent become ``other`` (ties by value)."""
    top = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(k).select(F.col(column).alias("_top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn(column, F.when(F.col("_top").isNull(), other).otherwise(F.col(column))).drop("_top")
