"""Alignment by key, record datasets, feature tables, round trips through files, staged jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog_queries import query
from ..operators import alignment, clusters, graphs, metrics, reports
from ..operators import crosssection as cs
from ..operators import relational as rel
from ..operators import timeseries as ts
from ..plans.staged import StagedJob
from ..plans.stages import run_stages
from ..sources import io
from ..sources.catalog import CATALOG, TableSpec, Warehouse
from ..sources.dataset import SemanticDataset
from ..sources.shared import shared_root
from .base import PANEL, SECTION, load, panel, r, rounded, section, with_
from .graph import LAYERS, _graph, _graph_sql, _layers, _vectors
from .relational import warehouse


def _fresh(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- scans ---------------------------------------------------------------------


@query("s3_inventory", "select * from (values ('lineitem', true), ('nothing', false), ('orders', true), ('supplier', true)) t(table_name, is_there)")
def s3_inventory(spark, d):
    """Declared tables and whether their data is there; a missing one raises only when it is read."""
    w = warehouse(spark, d)
    w.register(TableSpec("nothing", ("a",), (("a", "int"),)))
    return w.inventory()


@query("s6_valuation_scan", "select o_custkey, o_orderkey, o_totalprice from orders where o_custkey in (1, 4, 7, 10) and o_orderdate >= timestamp '1996-01-01'")
def s6_valuation_scan(spark, d):
    """Rows by codes from a date on, in key order."""
    import datetime as dt

    x = warehouse(spark, d).daily([1, 4, 7, 10], start=dt.datetime(1996, 1, 1), name="orders", key="o_custkey", at="o_orderdate")
    return x.select("o_custkey", "o_orderkey", "o_totalprice")


@query("s7_indicator_scan", "select o_custkey, o_orderkey from orders where o_custkey in (1, 2, 4, 5) and o_orderstatus = 'O'")
def s7_indicator_scan(spark, d):
    """Figures by codes and period, ordered by code and announcement."""
    x = warehouse(spark, d).indicators([1, 2, 4, 5], period="O", name="orders", key="o_custkey", at="o_orderdate", until="o_orderstatus")
    return x.select("o_custkey", "o_orderkey")


@query("s8_member_scan", "select s_suppkey, s_name from supplier where s_nationkey = 3")
def s8_member_scan(spark, d):
    """Memberships of one level's value."""
    return warehouse(spark, d).members(name="supplier", key="s_suppkey", s_nationkey=3).select("s_suppkey", "s_name")


@query("s9_dimension_scan", "select s_suppkey, s_name, s_acctbal from supplier")
def s9_dimension_scan(spark, d):
    return warehouse(spark, d).dimension(name="supplier", key="s_suppkey").select("s_suppkey", "s_name", "s_acctbal")


@query("s23_declared_columns", "select * from (values " + ", ".join(f"('{t.name}', '{n}', '{kind}', {i})" for t in CATALOG.values() for i, (n, kind) in enumerate(t.fields)) + ") t(table_name, column_name, data_type, position)")
def s23_declared_columns(spark, d):
    """Names and types of the declared equity tables."""
    return Warehouse(spark, d, CATALOG).describe()


@query("s13_metadata", "select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id")
def s13_metadata(spark, d):
    """Records with the columns of a dimension, NULLs where it lacks the key."""
    x = SemanticDataset(load(spark, d, "documents").drop("text"), key="doc_id").with_metadata(load(spark, d, "labels").withColumnRenamed("doc_id", "of"), "doc_id", "of")
    return x.records.select("doc_id", "lang", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


def _dataset(spark, d) -> SemanticDataset:
    v = load(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return SemanticDataset(load(spark, d, "documents").drop("text"), {"full_text": v, "even": v.where("label % 2 = 0")}, "doc_id")


@query("s17_dataset", "select 'documents' as name, count(*) as n from documents union all select 'full_text', count(*) from embeddings union all select 'even', count(*) from embeddings where label % 2 = 0 union all select 'record 5', count(*) from documents where doc_id = 5")
def s17_dataset(spark, d):
    """Rows of the records, of every view, and of one record."""
    x = _dataset(spark, d)
    out = spark.createDataFrame([("documents", x.num_rows()), ("record 5", x.record(5).count())], "name string, n long")
    for v in x.list_views():
        out = out.unionByName(x.view(v).agg(F.count("*").alias("n")).select(F.lit(v).alias("name"), "n"))
    return out


UNIT = "u as (select vec_id, list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * y)))) as u from embeddings)"


def _exploded(df, key: str, vector: str, digits: int = 5):
    return df.select(key, F.posexplode(vector).alias("pos", "x")).select(key, F.col("pos").cast("long").alias("pos"), r(F.col("x").cast("double"), digits).alias("x"))


@query("s18_unit_view", f"with {UNIT} select vec_id as doc_id, generate_subscripts(u, 1) - 1 as pos, round(unnest(u), 5) + 0.0 as x from u")
def s18_unit_view(spark, d):
    """A view's vectors at unit length, every component."""
    return _exploded(_dataset(spark, d).view("full_text", normalize=True), "doc_id", "embedding")


# --- round trips -----------------------------------------------------------------


@query("k1_csv_and_parquet", "select o_orderkey, o_orderpriority, round(o_totalprice, 2) + 0.0 as o_totalprice from orders union all select o_orderkey, o_orderpriority, round(o_totalprice, 2) + 0.0 from orders")
def k1_csv_and_parquet(spark, d):
    """A table written as Parquet and CSV, both read back."""
    path = _fresh(spark, "table")
    io.write_table(load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, csv=True)
    schema = "o_orderkey long, o_orderpriority string, o_totalprice double"
    return rounded(io.read_records(spark, f"{path}.parquet").unionByName(io.read_records(spark, f"{path}.csv", schema)), 2)


@query("k3_layers", with_(LAYERS) + "select src, dst, round(weight, 6) + 0.0 as weight, 'near' as layer from g union all select src, dst, weight, 'label' from h")
def k3_layers(spark, d):
    """Graph layers as one partitioned edge table, read back by layer."""
    path = _fresh(spark, "layers")
    io.write_layers(_layers(spark, d), path)
    out = None
    for name, e in io.read_layers(spark, path).items():
        e = e.select("src", "dst", "weight", F.lit(name).alias("layer"))
        out = e if out is None else out.unionByName(e)
    return rounded(out)


@query("k5_model", "select count(*) as n, cast(0 as bigint) as differ from embeddings")
def k5_model(spark, d):
    """A fitted k-means model saved, loaded and applied: rows whose cluster differs (none)."""
    from pyspark.ml.clustering import KMeans, KMeansModel
    from pyspark.ml.functions import array_to_vector

    x = load(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    path = _fresh(spark, "model")
    model = KMeans(k=5, seed=1).fit(x)
    model.write().save(path)
    a = model.transform(x).select("vec_id", F.col("prediction").alias("a"))
    b = KMeansModel.load(path).transform(x).select("vec_id", F.col("prediction").alias("b"))
    return a.join(b, "vec_id").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differ"))


@query("k7_report", with_(SECTION) + "select grp, count(*) as n, round(avg(price), 4) + 0.0 as avg_price from section where grp is not null group by 1")
def k7_report(spark, d):
    """A report written as one JSON text, its group table read back."""
    path = _fresh(spark, "report")
    io.write_report(reports.as_report({"groups": reports.group_profile(section(spark, d), "grp", ["price"])}), path)
    groups = F.from_json(F.get_json_object("value", "$.groups"), "array<struct<grp string, n bigint, avg_price double>>")
    return spark.read.text(path, wholetext=True).select(F.explode(groups).alias("g")).select("g.grp", "g.n", r("g.avg_price", 4).alias("avg_price"))


@query("k8_exports", "select 'customer' as name, count(*) as n from customer union all select 'supplier', count(*) from supplier")
def k8_exports(spark, d):
    """Several tables below one folder, counted there."""
    paths = io.write_tables({t: load(spark, d, t) for t in ("customer", "supplier")}, _fresh(spark, "exports"))
    out = None
    for p in paths:
        n = spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(p.rsplit("/", 1)[1]).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("k9_feature_mart", with_(PANEL) + "select cast(day as varchar) as day, ent, vol from panel where day between date '1996-03-01' and date '1996-03-31'")
def k9_feature_mart(spark, d):
    """Features by day as one partitioned table; a month's read touches its folders only."""
    path = _fresh(spark, "mart")
    io.write_partitioned(panel(spark, d).where("year(day) = 1996").select("ent", "day", "vol"), path, "day")
    return rounded(spark.read.parquet(path).where("day between date'1996-03-01' and date'1996-03-31'").select("day", "ent", "vol"))


# --- alignment ---------------------------------------------------------------------


@query("j5_asof_empty_right", "select o_orderkey, cast(null as varchar) as told, cast(null as double) as figure from orders")
def j5_asof_empty_right(spark, d):
    """As-of join with no events: every left row stays, its new columns NULL."""
    o = load(spark, d, "orders")
    right = o.where("o_orderkey < 0").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("told"), F.col("o_totalprice").alias("figure"))
    x = rel.asof_join(o.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")), right, "k", "at", "told", ["figure"])
    return x.select("o_orderkey", F.date_format("told", "yyyy-MM-dd").alias("told"), "figure")


@query(
    "j6_record_ids",
    """with s as (select l_orderkey, l_linenumber, l_suppkey as code, strftime(l_shipdate, '%Y%m%d') as at from lineitem),
  k as (select o_custkey as code, strftime(o_orderdate, '%Y%m%d') as told, max('r' || lpad(cast(o_orderkey as varchar), 9, '0')) as record_id from orders where o_orderdate >= timestamp '1995-06-01' group by 1, 2)
select l_orderkey, l_linenumber, case when s.at < (select min(told) from k) then cast(s.code as varchar) || '_' || s.at else k.record_id end as record_id from s asof left join k on s.code = k.code and s.at >= k.told""",
)
def j6_record_ids(spark, d):
    """The latest record of the row's code not after its date; before any record the code and date stand in."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("ts_code"), F.date_format("l_shipdate", "yyyyMMdd").alias("trade_date"))
    o = load(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1995-06-01 00:00:00'")
    o = o.select(F.col("o_custkey").alias("stock_code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("asof_date"), F.concat(F.lit("r"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("record_id"))
    return alignment.record_ids_asof(li, o).select("l_orderkey", "l_linenumber", "record_id")


@query("j8_momentum_merge", with_(SECTION) + "select id, price, round(p.p_size / 10.0 - p.p_retailprice / 1000, 6) + 0.0 as momentum_raw from section left join part p on p.p_partkey = id and p.p_size > 20")
def j8_momentum_merge(spark, d):
    """Long less short return from a panel, in place of a column of that name."""
    p = load(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10).alias("ret_252d"), (F.col("p_retailprice") / 1000).alias("ret_20d"))
    x = section(spark, d).select("id", "price", F.lit(-1.0).alias("momentum_raw"))
    return rounded(alignment.with_momentum(x, p, ["id"]))


SIZES = "v as (select vec_id as record, case when vec_id % 3 = 0 then vec_id + 1000 end as stock, label from embeddings)"


@query("j10_align_by", f"with {SIZES} select d.doc_id, coalesce((select min(label) from v where record = d.doc_id), (select min(label) from v where stock = d.doc_id + 500)) as label from documents d")
def j10_align_by(spark, d):
    """By record id, or else by stock code; never by position."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("record"), F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") + 1000).alias("stock"), F.col("label").cast("long").alias("label"))
    x = load(spark, d, "documents").select("doc_id", (F.col("doc_id") + 500).alias("other"))
    return alignment.align_by(x, v, [("doc_id", "record"), ("other", "stock")], "label").select("doc_id", "label")


@query("j11_key_positions", "with t as (select vec_id as pos, 'r' || vec_id as record_id, case when vec_id % 2 = 0 then 'r' || (vec_id + 1) end as stock_code from embeddings) select d.doc_id, coalesce((select max(pos) from t where stock_code = 'r' || d.doc_id), (select max(pos) from t where record_id = 'r' || d.doc_id), -1) as pos from documents d")
def j11_key_positions(spark, d):
    """Positions of keys, those of stock codes before those of record ids; -1 for misses."""
    i = F.col("vec_id")
    t = load(spark, d, "embeddings").select(i.alias("pos"), F.concat(F.lit("r"), i).alias("record_id"), F.when(i % 2 == 0, F.concat(F.lit("r"), i + 1)).alias("stock_code"))
    x = load(spark, d, "documents").select("doc_id", F.concat(F.lit("r"), "doc_id").alias("key"))
    return alignment.key_positions(x, t, "key").select("doc_id", "pos")


@query("o7_concat_by_key", "select d.doc_id, d.lang, e.label, l.quality from documents d left join embeddings e on d.doc_id = e.vec_id left join labels l on d.doc_id = l.doc_id")
def o7_concat_by_key(spark, d):
    """Tables side by side, matched by key."""
    parts = [load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("label")), load(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))]
    return alignment.concat_by_key(parts, "doc_id")


@query("o8_candidates", with_(LAYERS) + "select distinct src, dst from (select src, dst from g union all select src, dst from h)")
def o8_candidates(spark, d):
    """The union of the layers' neighbours."""
    a, b = _layers(spark, d).values()
    return a.select("src", "dst").unionByName(b.select("src", "dst")).distinct()


@query("o10_set_operations", "select 'both' as kind, k from (select c_nationkey as k from customer intersect select s_nationkey from supplier) union all select 'customers only', k from (select c_nationkey as k from customer except select s_nationkey from supplier)")
def o10_set_operations(spark, d):
    """INTERSECT and EXCEPT of keys."""
    c, s = load(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")), load(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    return c.intersect(s).select(F.lit("both").alias("kind"), "k").unionByName(c.subtract(s).select(F.lit("customers only").alias("kind"), "k"))


# --- features ------------------------------------------------------------------------


@query("f10_float_casts", "select p_partkey, cast(cast(p_retailprice as float) as double) as price from part")
def f10_float_casts(spark, d):
    """Columns in single precision (shown as the double it stands for)."""
    x = alignment.cast_columns(load(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price")), ["price", "absent"])
    return x.select("p_partkey", F.col("price").cast("double").alias("price"))


@query("f15_dates", "select o_orderkey, strftime(o_orderdate, '%Y%m%d') as compact, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month from orders")
def f15_dates(spark, d):
    from ..functions.scalars import compact_date

    x = load(spark, d, "orders")
    return x.select("o_orderkey", compact_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("compact"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month"))


@query("b3_valuation_features", "select p_partkey, cast(cast(p_size as float) as double) as pe, round(cast(cast(ln(nullif(case when p_size > 10 then p_retailprice else 0 end, 0)) as float) as double), 4) + 0.0 as log_total_mv from part")
def b3_valuation_features(spark, d):
    """Valuation columns as floats with logarithms of market values (zero as NULL)."""
    x = load(spark, d, "part").select("p_partkey", F.col("p_size").alias("pe"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).otherwise(0.0).alias("total_mv"))
    x = cs.valuation_features(x)
    return x.select("p_partkey", F.col("pe").cast("double").alias("pe"), r(F.col("log_total_mv").cast("double"), 4).alias("log_total_mv"))


@query("b4_figure_features", "select p_partkey, cast(cast(p_retailprice as float) as double) as roe, cast(cast(p_size / 7.0 as float) as double) as current_ratio, p_retailprice as other from part")
def b4_figure_features(spark, d):
    """Announced figures as floats; other columns as they are."""
    x = cs.figure_features(load(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("roe"), (F.col("p_size") / 7).alias("current_ratio"), F.col("p_retailprice").alias("other")))
    return x.select("p_partkey", F.col("roe").cast("double").alias("roe"), F.col("current_ratio").cast("double").alias("current_ratio"), "other")


@query("b17_view_features", f"with {UNIT} select d.doc_id, pos, round(coalesce(u[pos + 1], 0), 5) + 0.0 as x from documents d left join u on u.vec_id = d.doc_id, range(0, 64) t(pos)")
def b17_view_features(spark, d):
    """A view's unit vectors where the view is there (zeros for records it lacks); texts would be embedded else."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    v = load(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return _exploded(alignment.view_features(docs, "doc_id", "full_text", {"full_text": v}, 64), "doc_id", "embedding")


@query("b19_stand_in_vectors", with_(SECTION) + ", x as (select id, price, coalesce(size, 0) as size from section), m as (select avg(price) as mp, stddev_pop(price) as sp, avg(size) as ms, stddev_pop(size) as ss from x), z as (select id, (price - mp) / sp as a, (size - ms) / ss as b from x, m) select id, round(a / (sqrt(a * a + b * b) + 1e-8), 6) + 0.0 as first, round(b / (sqrt(a * a + b * b) + 1e-8), 6) + 0.0 as second from z")
def b19_stand_in_vectors(spark, d):
    """Standardised columns as unit vectors, for records without text vectors."""
    x = alignment.numeric_vectors(section(spark, d).select("id", "price", "size"), ["price", "size"])
    return rounded(x.select("id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", 2).alias("second")))


@query("b20_first_view", "with v as (select vec_id, label, 'full_text' as view, 0 as o from embeddings where vec_id % 3 = 0 union all select vec_id, label + 100, 'product_text', 1 from embeddings where vec_id % 2 = 0) select d.doc_id, arg_min(v.view, o) as view, arg_min(v.label, o) as label from documents d left join v on v.vec_id = d.doc_id group by 1")
def b20_first_view(spark, d):
    """For each record the first of the preferred views that has it."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("label"))
    views = e.where("doc_id % 3 = 0").withColumn("view", F.lit("full_text")).unionByName(e.where("doc_id % 2 = 0").select("doc_id", (F.col("label") + 100).alias("label"), F.lit("product_text").alias("view"))).unionByName(e.select("doc_id", "label", F.lit("unasked").alias("view")))
    return alignment.first_view(load(spark, d, "documents").select("doc_id"), views, "doc_id", ["full_text", "profile_text", "product_text"], "label").select("doc_id", "view", "label")


# --- graphs and clusters ----------------------------------------------------------------


@query("g2_inner_knn", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings), s as (select a.vec_id as src, b.vec_id as dst, round(list_inner_product(a.e, b.e), 9) as weight from v a join v b on a.vec_id <> b.vec_id) select src, dst, round(weight, 6) + 0.0 as weight, row_number() over (partition by src order by weight desc, dst) as rank from s qualify rank <= 5")
def g2_inner_knn(spark, d):
    """Exact neighbours by inner product."""
    return rounded(graphs.knn(_vectors(spark, d), "vec_id", "embedding", 5, "inner"))


@query(
    "g9_figures_graph",
    with_(PANEL)
    + """, f as (select ent, avg(close) as a, case when ent % 5 <> 0 then avg(vol) end as b, stddev_samp(close) as c from panel group by 1),
  m as (select ent, a, coalesce(b, (select median(b) from f)) as b, coalesce(c, (select median(c) from f)) as c from f),
  z as (select ent, (a - avg(a) over ()) / stddev_samp(a) over () as a, (b - avg(b) over ()) / stddev_samp(b) over () as b, (c - avg(c) over ()) / stddev_samp(c) over () as c from m),
  s as (select x.ent as src, y.ent as dst, round((x.a * y.a + x.b * y.b + x.c * y.c) / (sqrt(x.a * x.a + x.b * x.b + x.c * x.c) * sqrt(y.a * y.a + y.b * y.b + y.c * y.c)), 9) as weight from z x join z y on x.ent <> y.ent),
  k as (select *, row_number() over (partition by src order by weight desc, dst) as rank from s where weight >= 0 qualify rank <= 6),
  p as (select src, dst, weight from k where weight > 1e-8), b2 as (select * from p union all select dst, src, weight from p)
select src, dst, round(min(weight), 6) + 0.0 as weight from b2 group by 1, 2 having count(*) = 2""",
)
def g9_figures_graph(spark, d):
    """Mutual cosine neighbours of standardised figures, missing ones by the median."""
    f = panel(spark, d).groupBy("ent").agg(F.avg("close").alias("a"), F.avg("vol").alias("b"), F.stddev_samp("close").alias("c"))
    f = f.withColumn("b", F.when(F.col("ent") % 5 != 0, F.col("b")))
    return rounded(graphs.figures_graph(f, "ent", ["a", "b", "c", "absent"], 6))


@query(
    "g10_filled_correlation",
    with_(PANEL, "r as (select ent, day, close / nullif(lag(close) over (partition by ent order by day), 0) - 1 as ret from panel)", "t as (select distinct day from panel order by day desc limit 60)", "e as (select distinct ent from panel)")
    + """, x as (select e.ent, t.day, coalesce(r.ret, 0) as ret from e cross join t left join r on r.ent = e.ent and r.day = t.day),
  z as (select ent, day, coalesce((ret - avg(ret) over (partition by ent)) / nullif(stddev_pop(ret) over (partition by ent), 0), 0) as z from x),
  c as (select a.ent as src, b.ent as dst, round(sum(a.z * b.z) / 60, 9) as weight from z a join z b on a.day = b.day and a.ent <> b.ent group by 1, 2)
select src, dst, round(weight, 6) + 0.0 as weight, row_number() over (partition by src order by weight desc, dst) as rank from c where weight >= 0.05 qualify rank <= 5""",
)
def g10_filled_correlation(spark, d):
    """Correlation over the last 60 dates, missing returns as 0."""
    return rounded(graphs.filled_correlation(ts.returns_matrix(panel(spark, d), "ent", "day", dates=60), "ent", "day", "ret", 5, 0.05))


@query("g13_squared_distance", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings), s as (select a.vec_id as src, b.vec_id as dst, round(-list_distance(a.e, b.e), 9) as weight from v a join v b on a.vec_id <> b.vec_id) select src, dst, round(weight * weight, 5) + 0.0 as squared, row_number() over (partition by src order by weight desc, dst) as rank from s qualify rank <= 5")
def g13_squared_distance(spark, d):
    """Nearest neighbours with their squared distances."""
    x = graphs.knn(_vectors(spark, d), "vec_id", "embedding", 5, "l2")
    return x.select("src", "dst", r(F.col("weight") * F.col("weight"), 5).alias("squared"), F.col("rank").cast("long").alias("rank"))


@query("u3_fuse_candidates", with_(LAYERS) + ", f as (select src, dst, round(sum(w), 9) as w from (select src, dst, weight * 0.6 as w from g union all select src, dst, weight * 0.4 from h) group by 1, 2) select src, dst, round(w, 6) + 0.0 as weight, row_number() over (partition by src order by w desc, dst) as rank from f qualify rank <= 5")
def u3_fuse_candidates(spark, d):
    """Neighbours of all layers by weighted mean, the five best of each node."""
    return rounded(graphs.fuse_candidates(_layers(spark, d), {"near": 0.6, "label": 0.4}, 5))


@query("m15_community_sizes", "select vec_id, cast(label as bigint) as community_id, count(*) over (partition by label) as community_size from embeddings")
def m15_community_sizes(spark, d):
    v = _vectors(spark, d).select("vec_id", F.col("label").cast("long").alias("community_id"))
    return clusters.community_sizes(v, "vec_id")


def _reach(steps: int = 40) -> str:
    """Least reachable id by label propagation along edges, as many steps as paths of the test graphs need."""
    parts = ["l0 as materialized (select vec_id as id, vec_id as c from embeddings)"]
    parts += [f"l{i} as materialized (select l.id, least(l.c, coalesce(min(m.c), l.c)) as c from l{i - 1} l left join g on g.src = l.id left join l{i - 1} m on m.id = g.dst group by l.id, l.c)" for i in range(1, steps + 1)]
    return ", ".join(parts)


@query("m5_components", with_(_graph_sql(5), "d as (select vec_id, count(g.src) as degree, coalesce(sum(weight), 0) as w from embeddings left join g on vec_id = g.src group by 1)", _reach()) + "select d.vec_id, d.degree, round(d.w, 5) + 0.0 as weighted_degree, c as component, count(*) over (partition by c) as size from d join l40 on l40.id = d.vec_id")
def m5_components(spark, d):
    """Degrees and components in one node table."""
    v, g = _vectors(spark, d), _graph(spark, d, 5)
    x = metrics.degrees(g, v, "vec_id").join(metrics.connected_components(g, v, "vec_id"), "vec_id")
    return rounded(x, 5)


@query("a8_cluster_sizes", "with n as (select doc_id % 7 as c, count(*) as n from documents where doc_id % 7 <> 3 group by 1) select count(*) as n_clusters, round(avg(n), 6) + 0.0 as mean_size, round(stddev_samp(n), 6) + 0.0 as std_size, min(n) as least_size, max(n) as greatest_size from n")
def a8_cluster_sizes(spark, d):
    c = F.when(F.col("doc_id") % 7 == 3, -1).otherwise(F.col("doc_id") % 7)
    return rounded(clusters.cluster_sizes(load(spark, d, "documents").withColumn("c", c), "c"))


@query("a13_missing_report", with_(SECTION) + "select printf('%s: %d/%d (%.1f%%)', name, missing, n, 100.0 * missing / n) as line from (select 'grp' as name, count(*) - count(grp) as missing, count(*) as n from section union all select 'size', count(*) - count(size), count(*) from section)")
def a13_missing_report(spark, d):
    """One line for each column with gaps."""
    return reports.missing_report(section(spark, d))


LINES = "n as (select c, count(*) as n from (select case when doc_id % 9 = 4 then -1 else doc_id % 9 % 5 end as c from documents) where c >= 0 group by 1), o as (select c, n, row_number() over (order by n desc, c) as i from n)"


@query("r2_summary_lines", f"with {LINES} select 0 as position, printf('rows: %d, clusters: %d', (select count(*) from documents), (select count(*) from n)) as line union all select i, printf('cluster %d: %d', c, n) from o where i <= 3")
def r2_summary_lines(spark, d):
    """What a console shows: rows, clusters, the largest ones."""
    i = F.col("doc_id") % 9
    x = load(spark, d, "documents").withColumn("c", F.when(i == 4, -1).otherwise(i % 5))
    return reports.summary_lines(x, "c", 3).select(F.col("position").cast("long").alias("position"), "line")


@query("o4_largest_clusters", "select label as cluster_id, count(*) as n from embeddings group by 1 order by n desc, label limit 5")
def o4_largest_clusters(spark, d):
    """The five largest clusters (a top-k report)."""
    return rounded(load(spark, d, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(5))


@query("c3_kmeans_instead", None)
def c3_kmeans_instead(spark, d):
    """k-means with one cluster for 50 rows where density clusters aren't wanted."""
    return clusters.density_or_kmeans(_vectors(spark, d), "vec_id", "embedding", how="kmeans")


# --- jobs -------------------------------------------------------------------------------


@query("x2_staged_job", None)
def x2_staged_job(spark, d):
    """The ten stages over vectors as entities: parts' figures, their shipments as bars."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("ent"), "embedding", "label")
    li, p = load(spark, d, "lineitem"), load(spark, d, "part").select(F.col("p_partkey").alias("ent"), F.col("p_retailprice").alias("total_mv"), F.col("p_size").cast("double").alias("roe"))
    bars = li.groupBy((F.col("l_partkey")).alias("ent"), F.to_date("l_shipdate").alias("day")).agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_quantity").alias("vol"), F.sum("l_extendedprice").alias("amount"))
    bars = bars.join(v.select("ent"), "ent", "left_semi")
    snap = v.drop("embedding").join(p, "ent", "left").select("ent", F.lit("1998-12-31").alias("day"), (F.col("label") % 3).cast("string").alias("l1_name"), F.col("label").cast("string").alias("l2_name"), "total_mv", "roe", (F.col("roe") / 3 + 1).alias("pb"), (F.col("total_mv") / 100).alias("pe_ttm"), (F.col("roe") * 2).alias("debt_to_assets"), (F.col("total_mv") % 7).alias("realized_vol_20d"))
    job = StagedJob(snap, bars, {"full_text": v.select("ent", "embedding")}, "ent", "day", ("l1_name", "l2_name"), n_clusters=10, k_semantic=10, k=8, top=10, least_rows=1)
    done = run_stages(spark, job.stages(), _fresh(spark, "staged"))
    return rounded(done["graph_metrics"].join(done["clustering"], "ent").select("ent", "cluster_id", "degree", "core", "community_size", "pagerank"), 4)


