"""Aggregates and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog_queries import query
from ..operators import reports
from ..operators.quantiles import exact_quantiles, one_row
from .base import ENTITIES, PANEL, SECTION, entities, load, panel, r, rounded, section, with_

CLUSTERED = "clustered as (select *, id % 8 as cluster from section)"


def _clustered(spark, d):
    return section(spark, d).withColumn("cluster", F.col("id") % 8)


@query("a2_whole_statistics", with_(SECTION) + "select round(quantile_cont(price, 0.01), 6) + 0.0 as q01, round(quantile_cont(size, 0.9), 6) + 0.0 as q90, round(avg(size), 6) + 0.0 as mean, round(stddev_samp(size), 6) + 0.0 as sd, round(median(price), 6) + 0.0 as med from section")
def a2_whole_statistics(spark, d):
    x = section(spark, d)
    q = one_row(exact_quantiles(x, ["price", "size"], [0.01, 0.5, 0.9]), ["price", "size"], "")
    means = x.agg(F.avg("size").alias("mean"), F.stddev_samp("size").alias("sd"))
    return rounded(q.join(F.broadcast(means)).select(F.col("price")[0].alias("q01"), F.col("size")[2].alias("q90"), "mean", "sd", F.col("price")[1].alias("med")))


@query("a3_group_profile", with_(SECTION) + "select grp, count(*) as n, round(avg(price), 6) + 0.0 as avg_price, round(avg(size), 6) + 0.0 as avg_size from section where grp is not null group by 1")
def a3_group_profile(spark, d):
    return rounded(reports.group_profile(section(spark, d), "grp", ["price", "size"]))


@query("a4_cluster_mode", with_(SECTION, CLUSTERED) + ", c as (select cluster, grp, count(*) as c from clustered group by 1, 2), n as (select *, sum(c) over (partition by cluster) as n from c) select cluster, grp as mode_grp, round(c / n, 6) + 0.0 as mode_grp_share from n where grp is not null qualify row_number() over (partition by cluster order by c desc, grp) = 1")
def a4_cluster_mode(spark, d):
    return rounded(reports.mode_by(_clustered(spark, d), "cluster", "grp"))


@query(
    "a6_cluster_profile",
    with_(SECTION, CLUSTERED)
    + """, b as (select cluster, count(*) as n, avg(price) as avg_price, stddev_samp(price) as std_price from clustered group by 1),
  c as (select cluster, grp, count(*) as c, sum(count(*)) over (partition by cluster) as n from clustered group by 1, 2),
  m as (select cluster, grp as mode_grp, c / n as share from c where grp is not null qualify row_number() over (partition by cluster order by c desc, grp) = 1),
  e as (select cluster, coalesce(sum(case when grp is not null then -(c / n) * ln(c / n + 1e-10) end), 0) as entropy from c group by 1),
  t as (select cluster, string_agg(cast(id as varchar), ',' order by i) as top_codes from (select cluster, id, row_number() over (partition by cluster order by price desc, id) as i from clustered) where i <= 3 group by 1)
select b.cluster, b.n, round(avg_price, 6) + 0.0 as avg_price, round(std_price, 6) + 0.0 as std_price, mode_grp, round(share, 6) + 0.0 as mode_grp_share, round(entropy, 6) + 0.0 as entropy_grp, top_codes from b left join m using (cluster) left join e using (cluster) left join t using (cluster)""",
)
def a6_cluster_profile(spark, d):
    return rounded(reports.cluster_profile(_clustered(spark, d), "cluster", "grp", ["price"], "id", "price"))


@query("a10_column_quality", with_(SECTION) + ", n as (select count(*) as n from section) select 'grp' as column_name, count(*) - count(grp) as missing, round((count(*) - count(grp)) / count(*), 6) + 0.0 as missing_share, 'OK' as level from section union all select 'size', count(*) - count(size), round((count(*) - count(size)) / count(*), 6) + 0.0, 'OK' from section union all select 'price', 0, 0.0, 'OK'")
def a10_column_quality(spark, d):
    return rounded(reports.column_quality(section(spark, d), ["grp", "size", "price"]).select("column_name", "missing", "missing_share", "level"))


@query("a12_lag_statistics", "with x as (select datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as d from lineitem join orders on l_orderkey = o_orderkey) select round(avg(d), 6) + 0.0 as mean_days, round(median(d), 6) + 0.0 as median_days, round(quantile_cont(d, 0.9), 6) + 0.0 as p90_days, max(d) as max_days from x")
def a12_lag_statistics(spark, d):
    x = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(reports.lag_statistics(x, "l_shipdate", "o_orderdate"))


@query("a15_value_counts", "select source, count(*) as n, count(distinct lang) as langs from documents group by 1")
def a15_value_counts(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"))


@query("a17_market_summary", with_(PANEL, ENTITIES) + "select l1, count(*) as n, round(avg(close / open - 1), 6) + 0.0 as avg_move, round(avg(vol), 6) + 0.0 as avg_vol from panel p join entities e on p.ent = e.ent where day = date '1997-06-16' group by 1 order by avg_move desc")
def a17_market_summary(spark, d):
    x = panel(spark, d).where("day = date '1997-06-16'").join(F.broadcast(entities(spark, d)), "ent")
    return rounded(x.groupBy("l1").agg(F.count("*").alias("n"), F.avg(F.col("close") / F.col("open") - 1).alias("avg_move"), F.avg("vol").alias("avg_vol")).orderBy(F.desc("avg_move")))


@query("a19_duplicate_keys", "select l_orderkey, l_suppkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def a19_duplicate_keys(spark, d):
    return reports.duplicate_keys(load(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("a20_date_range", "select cast(cast(min(l_shipdate) as date) as varchar) as first_day, cast(cast(max(l_shipdate) as date) as varchar) as last_day from lineitem where l_suppkey = 7")
def a20_date_range(spark, d):
    return load(spark, d, "lineitem").where("l_suppkey = 7").agg(F.to_date(F.min("l_shipdate")).cast("string").alias("first_day"), F.to_date(F.max("l_shipdate")).cast("string").alias("last_day"))


@query("q_pricing_summary", "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice), 2) as sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) + 0.0 as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def q_pricing_summary(spark, d):
    e = F.col("l_extendedprice")
    return load(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(e), 2).alias("sum_price"), F.round(F.sum(e * (1 - F.col("l_discount"))), 2).alias("sum_disc"), r(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


@query("v1_histogram", with_(SECTION) + ", b as (select min(price) as lo, max(price) as hi from section) select cast(least(floor((price - lo) / ((hi - lo) / 20)), 19) as bigint) as bin, round(min(lo + least(floor((price - lo) / ((hi - lo) / 20)), 19) * ((hi - lo) / 20)), 6) + 0.0 as low, count(*) as n from section, b group by 1")
def v1_histogram(spark, d):
    return rounded(reports.histogram(section(spark, d), "price", 20))


@query(
    "v2_crosstab",
    with_(SECTION, CLUSTERED)
    + ", g as (select grp from clustered group by 1 order by count(*) desc, grp nulls first limit 10), x as (select cluster, case when grp in (select grp from g where grp is not null) then grp else 'other' end as grp from clustered) select cluster, grp, count(*) as n from x group by 1, 2",
)
def v2_crosstab(spark, d):
    return reports.crosstab(_clustered(spark, d), "cluster", "grp")


@query("v3_correlations", with_(PANEL) + "select 'close' as a, 'vol' as b, round(corr(close, vol), 6) + 0.0 as corr from panel union all select 'close', 'high', round(corr(close, high), 6) + 0.0 from panel union all select 'vol', 'high', round(corr(vol, high), 6) + 0.0 from panel")
def v3_correlations(spark, d):
    return rounded(reports.correlations(panel(spark, d), ["close", "vol", "high"]))


@query("v5_style_averages", with_(SECTION, CLUSTERED) + "select cluster, round(avg(price), 6) + 0.0 as price, round(avg(size), 6) + 0.0 as size from clustered group by 1")
def v5_style_averages(spark, d):
    return rounded(_clustered(spark, d).groupBy("cluster").agg(F.avg("price").alias("price"), F.avg("size").alias("size")))


@query("r3_quality_report", with_(SECTION) + "select 'column ' || name as line, missing as n, round(missing / n, 5) + 0.0 as value from (select 'id' as name, count(*) - count(id) as missing, count(*) as n from section union all select 'grp', count(*) - count(grp), count(*) from section union all select 'kind', count(*) - count(kind), count(*) from section union all select 'price', count(*) - count(price), count(*) from section union all select 'size', count(*) - count(size), count(*) from section) union all select 'group ' || grp, count(*), round(avg(price), 5) + 0.0 from section where grp is not null group by grp")
def r3_quality_report(spark, d):
    """A report as one JSON row, its tables read from the JSON."""
    x = section(spark, d)
    report = reports.as_report({"columns": reports.column_quality(x), "groups": reports.group_profile(x, "grp", ["price"])})
    columns = F.from_json(F.get_json_object("report", "$.columns"), "array<struct<column_name string, missing bigint, missing_share double>>")
    groups = F.from_json(F.get_json_object("report", "$.groups"), "array<struct<grp string, n bigint, avg_price double>>")
    a = report.select(F.explode(columns).alias("c")).select(F.concat(F.lit("column "), "c.column_name").alias("line"), F.col("c.missing").alias("n"), r("c.missing_share", 5).alias("value"))
    return a.unionByName(report.select(F.explode(groups).alias("g")).select(F.concat(F.lit("group "), "g.grp").alias("line"), F.col("g.n").alias("n"), r("g.avg_price", 5).alias("value")))
