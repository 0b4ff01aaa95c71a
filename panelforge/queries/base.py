"""Domain tables over the driver's tables, in DataFrames and as the same SQL.

Suppliers stand for stocks, their shipments of a day for a bar, orders of a customer for announced figures, nations and
regions for industry levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "string"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the sum turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating columns rounded, all dates as text, all integers long."""
    cols = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            x = r(x.cast("double"), digits)
        elif kind == "date":
            x = x.cast("string")
        elif kind in ("int", "smallint"):
            x = x.cast("long")
        cols.append(x.alias(c))
    return df.select(*cols)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars: ent, day, open, high, low, close, vol, amount. The divisor keeps prices off round decimals, where engines round halves apart."""
    li = load(spark, sf_dir, "lineitem")
    price, order = F.col("l_extendedprice") / (F.col("l_quantity") + F.lit(0.3)), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    x = li.select(F.col("l_suppkey").alias("ent"), F.to_date("l_shipdate").alias("day"), price.alias("p"), order.alias("o"), "l_quantity", "l_extendedprice")
    return x.groupBy("ent", "day").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("amount"))


PANEL = """panel as (
  select l_suppkey as ent, cast(l_shipdate as date) as day,
         arg_min(l_extendedprice / (l_quantity + 0.3), l_orderkey * 10 + l_linenumber) as open,
         max(l_extendedprice / (l_quantity + 0.3)) as high, min(l_extendedprice / (l_quantity + 0.3)) as low,
         arg_max(l_extendedprice / (l_quantity + 0.3), l_orderkey * 10 + l_linenumber) as close,
         sum(l_quantity) as vol, sum(l_extendedprice) as amount
  from lineitem group by 1, 2)"""


def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second fact by ent and day, for the days with a discount: discount, tax, turnover."""
    li = load(spark, sf_dir, "lineitem").where("l_discount > 0.02")
    return li.groupBy(F.col("l_suppkey").alias("ent"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.count("*").alias("turnover"))


VALUATION = """valuation as (
  select l_suppkey as ent, cast(l_shipdate as date) as day, avg(l_discount) as discount, avg(l_tax) as tax, count(*) as turnover
  from lineitem where l_discount > 0.02 group by 1, 2)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ent, name, l1 (region), l2 (nation), value."""
    s, n, g = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    x = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(g), n["n_regionkey"] == g["r_regionkey"])
    return x.select(F.col("s_suppkey").alias("ent"), F.col("s_name").alias("name"), F.col("r_name").alias("l1"), F.col("n_name").alias("l2"), F.col("s_acctbal").alias("value"))


ENTITIES = """entities as (
  select s_suppkey as ent, s_name as name, r_name as l1, n_name as l2, s_acctbal as value
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-section with gaps: parts with brand as group; size is missing for every seventh part."""
    p = load(spark, sf_dir, "part")
    gap = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double"))
    group = F.when(F.col("p_partkey") % 41 != 0, F.col("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), group.alias("grp"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("price"), gap.alias("size"))


SECTION = """section as (
  select p_partkey as id, case when p_partkey % 41 <> 0 then p_brand end as grp, p_type as kind, p_retailprice as price,
         case when p_partkey % 7 <> 0 then cast(p_size as double) end as size
  from part)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"
