"""Report tables: missing values, lags, group and cluster profiles, histograms, cross tables, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import fold_rare


def column_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, data_type, missing, missing_share, infinite, level (HIGH over half, MEDIUM over a fifth): one aggregation over all columns."""
    kinds = dict(df.dtypes)
    names = list(columns or df.columns)
    aggs = [F.count("*").alias("_n")]
    for c in names:
        real = kinds[c] in ("double", "float")
        aggs.append(F.count_if(F.col(c).isNull() | (F.isnan(c) if real else F.lit(False))).alias(f"m_{c}"))
        aggs.append((F.count_if(F.abs(F.col(c)) == float("inf")) if real else F.lit(0).cast("long")).alias(f"i_{c}"))
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.col(f"m_{c}").alias("missing"), F.col(f"i_{c}").alias("infinite")) for c in names])
    x = df.agg(*aggs).select("_n", F.explode(rows).alias("r")).select("_n", "r.*")
    share = F.col("missing") / F.nullif(F.col("_n"), F.lit(0))
    return x.select("column_name", "data_type", "missing", "infinite", share.alias("missing_share"), F.when(share > 0.5, "HIGH").when(share > 0.2, "MEDIUM").otherwise("OK").alias("level"))


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """line: ``column: missing/rows (share%)`` for each column with missing values."""
    x = column_quality(df, columns).where("missing > 0")
    n = F.round(F.col("missing") / F.col("missing_share")).cast("long")
    return x.select(F.format_string("%s: %d/%d (%.1f%%)", "column_name", "missing", n, 100 * F.col("missing_share")).alias("line"))


def summary_lines(df: DataFrame, cluster: str, k: int = 5) -> DataFrame:
    """position, line: rows, clusters, and the k largest clusters (ties by id), as a console shows them."""
    n = df.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("n"))
    head = df.agg(F.format_string("rows: %d, clusters: %d", F.count("*"), F.countDistinct(F.when(F.col(cluster) >= 0, F.col(cluster)))).alias("line")).select(F.lit(0).alias("position"), "line")
    best = n.orderBy(F.desc("n"), cluster).limit(k)
    best = best.select(F.row_number().over(Window.orderBy(F.desc("n"), cluster)).alias("position"), F.format_string("cluster %d: %d", F.col(cluster), "n").alias("line"))
    return head.unionByName(best)


def lag_statistics(df: DataFrame, at: str, announced: str) -> DataFrame:
    """mean, median, p90 and greatest number of days from ``announced`` to ``at``."""
    d = F.datediff(F.col(at), F.col(announced))
    return df.agg(F.avg(d).alias("mean_days"), F.median(d).alias("median_days"), F.percentile(d, F.lit(0.9)).alias("p90_days"), F.max(d).alias("max_days"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def group_profile(df: DataFrame, group: str, means: Sequence[str]) -> DataFrame:
    """group, n and the means; the NULL group is left out."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in means])


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, mode (most frequent non-NULL value, ties by value) and its share of the key's rows."""
    c = df.groupBy(key, value).agg(F.count("*").alias("c"))
    c = c.withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    best = c.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), value))).where("r = 1")
    return best.select(key, F.col(value).alias(f"mode_{value}"), (F.col("c") / F.col("n")).alias(f"mode_{value}_share"))


def entropy_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, entropy of the value's shares; NULL values stay in the denominator but aren't a value."""
    c = df.groupBy(key, value).agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    p = F.col("c") / F.col("n")
    return c.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col(value).isNotNull(), -p * F.ln(p + 1e-10))), F.lit(0.0)).alias(f"entropy_{value}"))


def cluster_profile(df: DataFrame, cluster: str, group: str, fields: Sequence[str], code: str, top: str, k: int = 3) -> DataFrame:
    """Per cluster: n, modal group and share, entropy, mean and deviation of the fields, and the k codes with the greatest ``top``."""
    base = df.groupBy(cluster).agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in fields for p, f in (("avg", F.avg), ("std", F.stddev_samp))])
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc_nulls_last(top), code))).where(F.col("_r") <= k)
    names = best.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(code).cast("string").alias("_c")))), lambda s: s["_c"]), ",").alias("top_codes"))
    return base.join(mode_by(df, cluster, group), cluster, "left").join(entropy_by(df, cluster, group), cluster, "left").join(names, cluster, "left")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, low, n: equal-width bins from the least to the greatest value; the greatest falls into the last."""
    b = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    i = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    x = df.where(F.col(column).isNotNull()).join(F.broadcast(b)).select(i.cast("int").alias("bin"), "_lo", width.alias("_w"))
    return x.groupBy("bin").agg(F.min(F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), F.count("*").alias("n"))


def crosstab(df: DataFrame, cluster: str, group: str, clusters: int = 30, groups: int = 10) -> DataFrame:
    """cluster, group, n for the largest clusters, with groups beyond the most frequent as "other"."""
    big = df.groupBy(cluster).count().orderBy(F.desc("count"), cluster).limit(clusters).select(cluster)
    return fold_rare(df, group, groups).join(F.broadcast(big), cluster).groupBy(cluster, group).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, corr of every pair of columns (a < b in the given order), in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])
    return row.select(F.explode(parts).alias("x")).select("x.*")


def as_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON column: each table as a list of objects (report tables are small by construction)."""
    parts = [df.agg(F.to_json(F.collect_list(F.struct("*"))).alias(name)) for name, df in tables.items()]
    one = reduce(lambda a, b: a.join(F.broadcast(b)), parts)
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in tables])
    return one.select(F.concat(F.lit("{"), body, F.lit("}")).alias("report"))
