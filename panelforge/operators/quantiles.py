"""Exact quantiles of many columns and groups at once, by counting in ranges that narrow around each wanted rank.

A quantile lies between two values of known rank. A pass counts a range's values in equal steps (added up in the tasks
first) and keeps the step that holds the rank, from its least to its greatest value; a range of one value is done. No
task sees a group's values together, whatever their number, and a pass has a few thousand counts for each open range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip
from ..sources.shared import cut, iteration

#: Steps of a range in a pass.
STEPS = 4096


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    """The columns of ``by``, column, n (values that aren't NULL), q (an array: the quantile at each of ``points``).

    Interpolated between neighbours as SQL's continuous percentile is. NULLs are left out, and groups or columns without
    any value have no row; a NULL group is a group. Values are finite. ``df`` is read once a pass: some two passes for each
    factor of ``steps`` in the rows; a table that is dear to make should be cut before.
    """
    with iteration(df.sparkSession) as kept:
        group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("g0"))
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
        values = df.select(group.alias("g"), each.alias("e")).select("g", "e.column", "e.x").where("x is not null")
        key = ["g", "column"]
        sizes = cut(values.groupBy(*key).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos")) for i, p in enumerate(points)]))
        wanted = cut(sizes.select(*key, "n", at.alias("at")).select(*key, "n", "at.*", F.floor("at.pos").alias("low"), F.ceil("at.pos").alias("high")))
        ranks = wanted.select(*key, F.explode(F.array("low", "high")).alias("rank")).distinct()
        state = cut(ranks.join(sizes, key).select(*key, "rank", "lo", "hi", F.lit(0).cast("long").alias("before")))
        while state.where("lo < hi").limit(1).count():
            live = state.where("lo < hi")
            ranges = live.groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
            inside = F.filter("ranges", lambda r: (F.col("x") >= r["lo"]) & (F.col("x") <= r["hi"]))
            hit = values.join(ranges, key).select(*key, "x", F.explode(inside).alias("r")).select(*key, "x", "r.lo", "r.hi")
            # halves, as the difference of two doubles may be beyond them
            step = F.least(F.lit(steps - 1), F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * steps))
            counts = hit.groupBy(*key, "lo", "hi", step.alias("step")).agg(F.count("*").alias("n"), F.min("x").alias("new_lo"), F.max("x").alias("new_hi"))
            upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*key, "lo", "hi").orderBy("step")) - F.col("n"))
            held = live.join(upto, [*key, "lo", "hi"]).where("rank >= before + upto and rank < before + upto + n")
            state = cut(state.where("lo = hi").unionByName(held.select(*key, "rank", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), (F.col("before") + F.col("upto")).alias("before"))))
        low, high = (state.select(*key, F.col("rank").alias(r), F.col("lo").alias(v)) for r, v in (("low", "a"), ("high", "b")))
        between = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.col("high") - F.col("pos")) * F.col("a") + (F.col("pos") - F.col("low")) * F.col("b"))
        found = wanted.join(low, [*key, "low"]).join(high, [*key, "high"]).select(*key, "n", F.struct("i", between.alias("v")).alias("p"))
        # as many as there are points
        done = found.groupBy(*key, "n").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("q"))
        return kept(done.select(*[F.col(f"g.g{i}").alias(c) for i, c in enumerate(by)], "column", "n", "q"))


def one_row(quantiles: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """The quantiles of a whole table as one row: an array for each column, NULL for one without values."""
    return quantiles.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"{prefix}{c}") for c in columns])


def winsorize_groups(df: DataFrame, columns: Sequence[str], by: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``df`` with the columns clipped to their exact quantiles over each group, without a task that holds a group's values."""
    q = exact_quantiles(df, columns, [low, high], by)
    bounds = q.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(f"_q_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    out = df.join(bounds, condition, "left")
    return out.withColumns({c: clip(F.col(c), F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]) for c in columns}).select(*df.columns)
