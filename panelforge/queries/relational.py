"""Scans, filters, joins, as-of and validity joins, snapshots, ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog_queries import query
from ..operators import crosssection as cs
from ..operators import relational as rel
from ..operators import timeseries as ts
from ..plans.snapshot import stock_snapshot
from ..sources.catalog import CATALOG, TableSpec, Warehouse
from .base import ENTITIES, PANEL, VALUATION, entities, load, panel, rounded, valuation, with_

LINEITEM = TableSpec("lineitem", ("l_orderkey", "l_linenumber"), (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")))
ORDERS = TableSpec("orders", ("o_orderkey",), (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")))
SUPPLIER = TableSpec("supplier", ("s_suppkey",), (("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")))


def warehouse(spark, d):
    return Warehouse(spark, d, {t.name: t for t in (LINEITEM, ORDERS, SUPPLIER)})


@query(
    "flagship_top_momentum",
    with_(PANEL, ENTITIES)
    + """, x as (select p.ent, p.day, e.l1, close / lag(close, 20) over w - 1 as ret_20, avg(close) over (partition by p.ent order by day rows between 19 preceding and current row) as ma_20
       from panel p join entities e on p.ent = e.ent window w as (partition by p.ent order by day)),
  z as (select *, (ret_20 - avg(ret_20) over g) / case when stddev_samp(ret_20) over g = 0 then 1 else stddev_samp(ret_20) over g end as z
        from x window g as (partition by day, l1)),
  k as (select *, row_number() over (partition by day order by round(z, 9) desc, ent) as rank from z where z is not null)
select ent, cast(day as varchar) as day, l1, round(ret_20, 6) + 0.0 as ret_20, round(ma_20, 6) + 0.0 as ma_20, round(z, 6) + 0.0 as z, rank from k where rank <= 10""",
)
def flagship_top_momentum(spark, d):
    """Daily panel, dimension join, 20-row return and mean, group-neutral z-score, ten best of each date."""
    x = panel(spark, d).join(F.broadcast(entities(spark, d)), "ent")
    x = ts.returns(x, "ent", "day", "close", [20])
    x = ts.moving_average(x, "ent", "day", "close", 20, "ma_20")
    x = x.withColumn("z", cs.neutralized(x, "ret_20", "l1", ["day"])).where("z is not null")
    top = rel.top_per_group(x, ["day"], [F.round("z", 9).desc(), F.col("ent")], 10)
    return rounded(top.select("ent", "day", "l1", "ret_20", "ma_20", "z", "rank"))


@query("s4_fetch_table", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R' and l_linenumber in (1, 2) order by l_orderkey, l_linenumber limit 500")
def s4_fetch_table(spark, d):
    """Generic scan: projection, equality and IN filters, order, limit (the limit is the feature)."""
    x = warehouse(spark, d).fetch("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], {"l_returnflag": "R", "l_linenumber": [1, 2]}, order_by=["l_orderkey", "l_linenumber"], limit=500)
    return rounded(x)


@query("s5_range_scan", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate <= timestamp '1997-12-31'")
def s5_range_scan(spark, d):
    """Date-range scan; both bounds reach the Parquet reader."""
    import datetime as dt

    return rounded(warehouse(spark, d).fetch("orders", ["o_orderkey", "o_custkey", "o_totalprice"], low={"o_orderdate": dt.datetime(1997, 1, 1)}, high={"o_orderdate": dt.datetime(1997, 12, 31)}), 2)


@query("s10_latest_date", "select cast(max(l_shipdate) as varchar) as latest from lineitem")
def s10_latest_date(spark, d):
    return warehouse(spark, d).latest_date("lineitem", "l_shipdate").select(F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("s11_trade_dates", "select distinct cast(cast(l_shipdate as date) as varchar) as day from lineitem where l_shipdate between timestamp '1996-01-01' and timestamp '1996-06-30'")
def s11_trade_dates(spark, d):
    import datetime as dt

    x = warehouse(spark, d).dates(dt.datetime(1996, 1, 1), dt.datetime(1996, 6, 30), "lineitem", "l_shipdate")
    return x.select(F.to_date("l_shipdate").cast("string").alias("day")).distinct()


@query("s1_catalog", "select * from (values " + ", ".join(f"('{t.name}', {len(t.fields)}, '{'|'.join(t.keys)}')" for t in CATALOG.values()) + ") t(table_name, columns, keys)")
def s1_catalog(spark, d):
    """The declared equity tables: how many columns, and the key."""
    w = Warehouse(spark, d, CATALOG)
    keys = spark.createDataFrame([(t, "|".join(w.spec(t).keys)) for t in w.list_tables()], "table_name string, keys string")
    return w.describe().groupBy("table_name").agg(F.count("*").alias("columns")).join(keys, "table_name")


@query("s16_dataset_assembly", "select c.c_custkey, c.c_name, n.n_name, n.n_regionkey from customer c left join nation n on c.c_nationkey = n.n_nationkey and n.n_regionkey < 3")
def s16_dataset_assembly(spark, d):
    """Records with metadata of a left join; no metadata gives NULLs."""
    n = load(spark, d, "nation").where("n_regionkey < 3")
    x = load(spark, d, "customer")
    return rounded(x.join(F.broadcast(n), x["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", "c_name", "n_name", "n_regionkey"))


@query("s22_file_query", "select s_suppkey, s_name from supplier where s_acctbal > 0")
def s22_file_query(spark, d):
    """SQL straight over a file."""
    return spark.sql(f"select s_suppkey, s_name from parquet.`{d}/supplier.parquet` where s_acctbal > 0")


@query("s25_bars_by_frequency", "select event_id, user_id, value from events where hour(ts) * 60 + minute(ts) between 570 and 900")
def s25_bars_by_frequency(spark, d):
    """Intraday rows between 09:30 and 15:00."""
    return load(spark, d, "events").where("hour(ts) * 60 + minute(ts) between 570 and 900").select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("s26_symbols", "select l_suppkey, count(*) as n, sum(l_quantity) as qty from lineitem where l_suppkey in (1, 3, 5, 7) group by 1")
def s26_symbols(spark, d):
    """Several symbols in one query."""
    return load(spark, d, "lineitem").where(F.col("l_suppkey").isin(1, 3, 5, 7)).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("p3_exclude_marked", "select s_suppkey, s_name from supplier where not coalesce(contains(nullif(s_name, 'Supplier#000000003'), '1'), false)")
def p3_exclude_marked(spark, d):
    """Names with a mark go, missing names stay."""
    name = F.nullif("s_name", F.lit("Supplier#000000003"))
    return load(spark, d, "supplier").where(~F.coalesce(F.contains(name, F.lit("1")), F.lit(False))).select("s_suppkey", "s_name")


@query("p7_finite", "select id, round(case when id % 5 = 0 then null else price / nullif(id % 3, 0) end, 6) + 0.0 as v from (select p_partkey as id, p_retailprice as price from part)")
def p7_finite(spark, d):
    """NaN and infinities become NULL."""
    from ..functions.scalars import finite

    x = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice") / F.nullif(F.col("p_partkey") % 3, F.lit(0))).alias("v"))
    return rounded(x.select("id", finite(F.col("v")).alias("v")))


@query("p9_piecewise_score", "select p_partkey, case when p_size between 10 and 20 then 2 when p_size between 21 and 35 then 1 else 0 end + case when p_retailprice > 1500 then 1 else 0 end as score from part")
def p9_piecewise_score(spark, d):
    s = F.when(F.col("p_size").between(10, 20), 2).when(F.col("p_size").between(21, 35), 1).otherwise(0) + F.when(F.col("p_retailprice") > 1500, 1).otherwise(0)
    return load(spark, d, "part").select("p_partkey", s.cast("long").alias("score"))


@query("j1_left_fact_join", with_(PANEL, VALUATION) + "select p.ent, cast(p.day as varchar) as day, round(p.close, 6) + 0.0 as close, round(v.discount, 6) + 0.0 as discount, v.turnover from panel p left join valuation v on p.ent = v.ent and p.day = v.day")
def j1_left_fact_join(spark, d):
    """Prices with valuation of the same entity and day."""
    return rounded(panel(spark, d).join(valuation(spark, d), ["ent", "day"], "left").select("ent", "day", "close", "discount", "turnover"))


@query("j2_dimension_join", with_(PANEL, ENTITIES) + "select p.ent, cast(p.day as varchar) as day, e.name, e.l1, e.l2, p.vol from panel p left join entities e on p.ent = e.ent")
def j2_dimension_join(spark, d):
    return rounded(panel(spark, d).join(F.broadcast(entities(spark, d)), "ent", "left").select("ent", "day", "name", "l1", "l2", "vol"))


ASOF = """with l as (select l_orderkey, l_linenumber, l_suppkey % 1000 + 1 as k, l_shipdate as at, l_quantity from lineitem),
  o as (select o_custkey as k, o_orderdate as told, max(o_totalprice) as figure from orders group by 1, 2)
select l.l_orderkey, l.l_linenumber, strftime(o.told, '%Y-%m-%d') as told, round(o.figure, 2) + 0.0 as figure
from l asof left join o on l.k = o.k and l.at >= o.told"""


@query("j3_asof_join", ASOF)
def j3_asof_join(spark, d):
    """For each line the latest earlier order of its key; of orders on one date the greater."""
    left = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 1000 + 1).alias("k"), F.col("l_shipdate").alias("at"))
    right = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("told"), F.col("o_totalprice").alias("figure"))
    x = rel.asof_join(left, right, "k", "at", "told", ["figure"], tie="figure")
    return rounded(x.select("l_orderkey", "l_linenumber", F.date_format("told", "yyyy-MM-dd").alias("told"), "figure"), 2)


@query("j3_asof_slices", ASOF)
def j3_asof_slices(spark, d):
    """The same join with a key's months in tasks of their own."""
    left = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 1000 + 1).alias("k"), F.col("l_shipdate").alias("at"))
    right = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("told"), F.col("o_totalprice").alias("figure"))
    x = rel.asof_join(left, right, "k", "at", "told", ["figure"], tie="figure", slices=lambda at: F.date_trunc("month", at))
    return rounded(x.select("l_orderkey", "l_linenumber", F.date_format("told", "yyyy-MM-dd").alias("told"), "figure"), 2)


@query("j5_asof_tolerance", ASOF.replace("strftime(o.told, '%Y-%m-%d')", "case when datediff('day', o.told, l.at) <= 90 then strftime(o.told, '%Y-%m-%d') end").replace("round(o.figure, 2) + 0.0", "case when datediff('day', o.told, l.at) <= 90 then round(o.figure, 2) + 0.0 end"))
def j5_asof_tolerance(spark, d):
    """As-of with matches older than 90 days as none."""
    left = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 1000 + 1).alias("k"), F.col("l_shipdate").alias("at"))
    right = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("told"), F.col("o_totalprice").alias("figure"))
    x = rel.asof_join(left, right, "k", "at", "told", ["figure"], tolerance_days=90, tie="figure")
    return rounded(x.select("l_orderkey", "l_linenumber", F.date_format("told", "yyyy-MM-dd").alias("told"), "figure"), 2)


@query("j4_latest_per_key", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def j4_latest_per_key(spark, d):
    x = load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rel.latest_per_key(x, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


MEMBERS = """members as (select ent, l1 as label, 19950101 + 10000 * s as in_date, case when s = 2 then 0 when s = 1 and ent % 3 = 0 then null else 19950101 + 10000 * (s + 2) end as out_date
  from entities, (values (0), (1), (2)) t(s))"""


def _members(spark, d):
    e = entities(spark, d).select("ent", F.col("l1").alias("label"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s"))
    out = F.when(F.col("s") == 2, 0).when((F.col("s") == 1) & (F.col("ent") % 3 == 0), None).otherwise(19950101 + 10000 * (F.col("s") + 2))
    return e.select("ent", "label", (19950101 + 10000 * F.col("s")).alias("in_date"), out.alias("out_date"))


@query(
    "j7_membership_join",
    with_(PANEL, ENTITIES, MEMBERS)
    + """select p.ent, cast(p.day as varchar) as day, m.label, m.since from panel p left join lateral (
  select label, in_date as since from members m where m.ent = p.ent and m.in_date <= cast(strftime(p.day, '%Y%m%d') as bigint)
    and (m.out_date is null or m.out_date = 0 or m.out_date > cast(strftime(p.day, '%Y%m%d') as bigint)) order by in_date desc limit 1) m on true""",
)
def j7_membership_join(spark, d):
    """Membership valid at the bar's date; the latest start wins."""
    p = panel(spark, d).select("ent", "day", F.date_format("day", "yyyyMMdd").cast("long").alias("at"))
    m = _members(spark, d).withColumn("since", F.col("in_date"))
    return rounded(rel.membership_join(p, m, "ent", "at", ["label", "since"]).select("ent", "day", "label", "since"))


@query(
    "p5_valid_at",
    with_(ENTITIES, MEMBERS) + "select ent, in_date, out_date from members where in_date <= 19970601 and (out_date is null or out_date = 0 or out_date > 19970601)",
)
def p5_valid_at(spark, d):
    return rounded(rel.valid_at(_members(spark, d), F.lit(19970601)).select("ent", "in_date", "out_date"))


@query(
    "b1_snapshot",
    with_(PANEL, VALUATION, ENTITIES, MEMBERS, "told as (select l_suppkey as ent, cast(o_orderdate as date) as ann, max(o_totalprice) as figure from orders join lineitem on o_orderkey = l_orderkey group by 1, 2)")
    + """, x as (select p.ent, p.day, p.close, p.vol, v.turnover, e.name, e.l2 from panel p left join valuation v on p.ent = v.ent and p.day = v.day left join entities e on p.ent = e.ent
  where p.day between date '1997-01-01' and date '1997-06-30' and not coalesce(contains(e.name, '7'), false) and p.vol > 0),
  y as (select x.*, m.label from x left join lateral (select label from members m where m.ent = x.ent and m.in_date <= cast(strftime(x.day, '%Y%m%d') as bigint)
    and (m.out_date is null or m.out_date = 0 or m.out_date > cast(strftime(x.day, '%Y%m%d') as bigint)) order by in_date desc limit 1) m on true)
select y.ent, cast(y.day as varchar) as day, round(y.close, 6) + 0.0 as close, y.vol, y.turnover, y.name, y.label, round(t.figure, 2) + 0.0 as figure, cast(t.ann as varchar) as ann,
  y.ent || '_' || cast(y.day as varchar) as record_key from y asof left join told t on y.ent = t.ent and y.day >= t.ann""",
)
def b1_snapshot(spark, d):
    """Point-in-time snapshots of all dates of a range, in one plan."""
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    told = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("l_suppkey").alias("ent"), F.to_date("o_orderdate").alias("ann"), F.col("o_totalprice").alias("figure"))
    span = [F.lit("1997-01-01").cast("date"), F.lit("1997-06-30").cast("date")]
    m = _members(spark, d).select("ent", "label", F.to_date(F.col("in_date").cast("string"), "yyyyMMdd").alias("in_date"), F.to_date(F.nullif("out_date", F.lit(0)).cast("string"), "yyyyMMdd").alias("out_date"))
    x = stock_snapshot(panel(spark, d), valuation(spark, d), entities(spark, d), m, told, "ent", "day", "ann", ["figure"], ["label"], span[0], span[1], mark="7", tie="figure")
    return rounded(x.select("ent", "day", "close", "vol", "turnover", "name", "label", F.round("figure", 2).alias("figure"), "ann", "record_key"))


@query("j9_align_vectors", "select d.doc_id as vec_id, p.pos, round(coalesce(cast(e.embedding[p.pos + 1] as double), 0), 5) + 0.0 as x from documents d left join embeddings e on e.vec_id = d.doc_id, range(0, 64) p(pos)")
def j9_align_vectors(spark, d):
    """Vectors by key, zeros where there is none; every component."""
    e = load(spark, d, "embeddings")
    keys = load(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    x = rel.align_vectors(keys, e, "vec_id", "embedding", 64)
    return rounded(x.select("vec_id", F.posexplode("embedding").alias("pos", "x")), 5)


@query("j12_match_share", "select count(e.vec_id) as matched, count(*) as total, round(count(e.vec_id) / count(*), 6) + 0.0 as share from documents d left join embeddings e on d.doc_id = e.vec_id")
def j12_match_share(spark, d):
    return rounded(rel.match_share(load(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), load(spark, d, "embeddings"), "vec_id"))


@query("j16_chained_joins", with_(PANEL, VALUATION) + ", f as (select l_suppkey as ent, cast(l_shipdate as date) as day, sum(case when l_returnflag = 'R' then l_quantity else 0 end) as back from lineitem group by 1, 2) select p.ent, cast(p.day as varchar) as day, p.vol, v.turnover, f.back, round(f.back / nullif(p.vol, 0), 6) + 0.0 as share from panel p left join valuation v on p.ent = v.ent and p.day = v.day left join f on p.ent = f.ent and p.day = f.day")
def j16_chained_joins(spark, d):
    """Three facts with one key: co-partitioned, so each is shuffled once."""
    f = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ent"), F.to_date("l_shipdate").alias("day")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("back"))
    x = panel(spark, d).join(valuation(spark, d), ["ent", "day"], "left").join(f, ["ent", "day"], "left")
    return rounded(x.select("ent", "day", "vol", "turnover", "back", (F.col("back") / F.nullif("vol", F.lit(0.0))).alias("share")))


@query("j17_group_mean", with_(PANEL, ENTITIES) + "select p.ent, cast(p.day as varchar) as day, round(p.close - avg(p.close) over (partition by p.day, e.l1), 6) + 0.0 as excess from panel p join entities e on p.ent = e.ent")
def j17_group_mean(spark, d):
    """A row against its group's mean: one window instead of an aggregate and a join."""
    x = panel(spark, d).join(F.broadcast(entities(spark, d)), "ent")
    return rounded(x.select("ent", "day", (F.col("close") - F.avg("close").over(Window.partitionBy("day", "l1"))).alias("excess")))


@query("j20_semi_join", "select l_orderkey, l_linenumber from lineitem l where l_orderkey in (select o_orderkey from orders o where o.o_orderdate <= l.l_shipdate - interval 60 day)")
def j20_semi_join(spark, d):
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    return li.join(o, (li["l_orderkey"] == o["o_orderkey"]) & (o["o_orderdate"] <= li["l_shipdate"] - F.expr("interval 60 days")), "left_semi").select("l_orderkey", "l_linenumber")


@query("j21_scalar_subquery", "select l_orderkey, l_linenumber from lineitem where l_shipdate = (select max(l_shipdate) from lineitem)")
def j21_scalar_subquery(spark, d):
    load(spark, d, "lineitem").createOrReplaceTempView("pf_lineitem")
    return spark.sql("select l_orderkey, l_linenumber from pf_lineitem where l_shipdate = (select max(l_shipdate) from pf_lineitem)")


@query("o3_top_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def o3_top_n(spark, d):
    """Top-k report."""
    return load(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("o5_paging", "select o_orderkey from orders order by o_orderkey limit 100 offset 200")
def o5_paging(spark, d):
    """One page (limit and offset are the feature)."""
    return load(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(200).limit(100)


@query("o6_union_all", "select c_custkey as k, c_nationkey as n from customer union all select s_suppkey, s_nationkey from supplier")
def o6_union_all(spark, d):
    return rounded(load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")).unionByName(load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))))


@query("w10_top_k_per_group", "select c_nationkey as nation, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer qualify rank <= 5")
def w10_top_k_per_group(spark, d):
    x = rel.top_per_group(load(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5)
    return rounded(x.select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal", "rank"))
