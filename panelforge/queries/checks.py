"""What must hold for jobs and iterations that SQL can't express row by row, and their parts that it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog_queries import QUERIES, query
from ..operators import clusters, metrics
from ..plans.research import research_report
from ..sources.shared import cut
from .base import load, rounded, with_
from .graph import _graph, _graph_sql, _vectors

NODE_METRICS = with_(
    _graph_sql(5),
    "nodes as (select vec_id as id, label, label % 3 as grp, count(*) over (partition by label) as community_size from embeddings)",
    "deg as (select id, count(g.src) as degree, coalesce(sum(weight), 0) as weighted_degree from nodes v left join g on id = src group by 1)",
    "tri as (select a.src as id, count(*) / 2 as t from g a join g b on a.src = b.src and a.dst <> b.dst join g c on c.src = a.dst and c.dst = b.dst group by 1)",
    """near as (select v.id, coalesce(avg(u.label), 0) as neighbour_label,
    coalesce(avg(case when u.label <> v.label then 1.0 else 0.0 end) filter (u.id is not null), 0) as bridge_score,
    coalesce(avg(case when u.label = v.label then 1.0 else 0.0 end) filter (u.id is not null), 0) as cluster_agreement,
    coalesce(avg(case when u.grp = v.grp then 1.0 else 0.0 end) filter (u.id is not null), 0) as group_agreement
    from nodes v left join g on v.id = src left join nodes u on u.id = dst group by 1)""",
    "disp as (select g.src as id, abs(u.label - avg(u.label) over (partition by g.src)) as dd from g join nodes u on u.id = g.dst)",
    "styles as (select v.id, case when count(x.id) >= 2 then avg(dd) else 0 end as style_dispersion from nodes v left join disp x on v.id = x.id group by 1)",
)


@query(
    "m16_node_metrics_parts",
    NODE_METRICS
    + """select v.id as vec_id, community_size, degree, round(weighted_degree, 5) + 0.0 as weighted_degree, cast(coalesce(t, 0) as bigint) as triangles,
  round(case when degree < 2 then 0 else 2 * coalesce(t, 0) / (degree * (degree - 1)) end, 5) + 0.0 as clustering,
  round(neighbour_label, 5) + 0.0 as neighbour_label, round(bridge_score, 5) + 0.0 as bridge_score, round(cluster_agreement, 5) + 0.0 as cluster_agreement,
  round(group_agreement, 5) + 0.0 as group_agreement, round(style_dispersion, 5) + 0.0 as style_dispersion, true as core_in_degree, true as ranks_sum_to_one
from nodes v join deg using (id) join near using (id) join styles using (id) left join tri using (id)""",
)
def m16_node_metrics_parts(spark, d):
    """The table of all node metrics; of the iterated ones only what must hold (each has a query of its own)."""
    v = _vectors(spark, d).withColumn("grp", F.col("label") % 3)
    x = cut(metrics.node_metrics(_graph(spark, d, 5), v, "vec_id", "label", "grp", ["label"], ["label"]))
    whole = x.agg((F.abs(F.sum("pagerank") - 1) < 1e-6).alias("ranks_sum_to_one"))
    exact = ["weighted_degree", "clustering", "neighbour_label", "bridge_score", "cluster_agreement", "group_agreement", "style_dispersion"]
    shown = x.select("vec_id", "community_size", "degree", "triangles", *exact, (F.col("core") <= F.col("degree")).alias("core_in_degree"))
    return rounded(shown.join(F.broadcast(whole)), 5)


def _rows(table, part, key, names):
    """part, key, name, value: the numbers ``names`` of a report table as rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("c")
    return table.select(F.lit(part).alias("part"), (F.col(key).cast("string") if key else F.lit("")).alias("key"), cells).select("part", "key", "c.*")


REPORT = with_(
    _graph_sql(5),
    "people as (select vec_id, vec_id % 7 - 1 as c, cast(label % 3 as varchar) as grp, case when vec_id % 9 <> 0 then cast(embedding[1] as double) end as x from embeddings)",
    "inside as (select * from people where c >= 0)",
    "counted as (select c, grp, count(*) as n from inside group by 1, 2)",
    "shares as (select *, sum(n) over (partition by c) as na, sum(n) over (partition by grp) as nb, sum(n) over () as t from counted)",
    "deg as (select vec_id, count(g.src) as degree from embeddings left join g on vec_id = g.src group by 1)",
    """parts as (
  select 'summary' as part, '' as key, unnest([{'name': 'n_rows', 'value': count(*)}, {'name': 'n_unclustered', 'value': count(*) filter (c < 0)}, {'name': 'n_clusters', 'value': count(distinct c) filter (c >= 0)}]) as f from people
  union all select 'clusters', cast(c as varchar), unnest([{'name': 'n', 'value': count(*)}, {'name': 'avg_x', 'value': avg(x)}]) from inside group by c
  union all select 'clusters', cast(c as varchar), unnest([{'name': 'mode_grp', 'value': cast(arg_min(grp, (-n, grp)) as double)}, {'name': 'mode_grp_share', 'value': max(n) / sum(n)}]) from counted group by c
  union all select 'groups', grp, unnest([{'name': 'n', 'value': count(*)}, {'name': 'avg_x', 'value': avg(x)}]) from people group by grp
  union all select 'styles', cast(c as varchar), {'name': 'x', 'value': avg(x)} from inside group by c
  union all select 'graph', '', unnest([{'name': 'avg_degree', 'value': avg(degree)}, {'name': 'median_degree', 'value': median(degree)}, {'name': 'isolated', 'value': count(*) filter (degree = 0)}]) from deg
  union all select 'missing', 'x', unnest([{'name': 'missing', 'value': count(*) filter (x is null)}, {'name': 'missing_share', 'value': count(*) filter (x is null) / count(*)}]) from people
  union all select 'missing', 'grp', unnest([{'name': 'missing', 'value': 0}, {'name': 'missing_share', 'value': 0}])
  union all select 'agreement', '', {'name': 'nmi', 'value': 2 * sum(n / t * ln((n / t) / ((na / t) * (nb / t)))) / (-sum(n / t * ln(na / t)) - sum(n / t * ln(nb / t)))} from shares
  union all select 'agreement', '', {'name': 'purity', 'value': sum(m) / sum(s)} from (select max(n) as m, sum(n) as s from counted group by c))""",
)


@query("r1_report_parts", REPORT + "select part, key, f.name as name, round(cast(f.value as double), 6) + 0.0 as value from parts")
def r1_report_parts(spark, d):
    """Every table of the research report as rows, with unclustered rows and missing values (the mean rank is m3's work)."""
    v = _vectors(spark, d)
    x = F.when(F.col("vec_id") % 9 != 0, F.element_at("embedding", 1).cast("double"))
    snap = v.select("vec_id", (F.col("label") % 3).cast("string").alias("grp"), x.alias("x"))
    labels = v.select("vec_id", (F.col("vec_id") % 7 - 1).alias("cluster_id"))
    g = _graph(spark, d, 5)
    nodes = metrics.degrees(g, v, "vec_id").join(metrics.pagerank(g, v, "vec_id", rounds=5, tol=0.0), "vec_id")
    t = research_report(snap, labels, nodes, "vec_id", "grp", ["x"], ["x"], ["x", "grp"])
    out = _rows(t["summary"], "summary", None, ["n_rows", "n_unclustered", "n_clusters"])
    out = out.unionByName(_rows(t["clusters"], "clusters", "cluster_id", ["n", "avg_x", "mode_grp", "mode_grp_share"]))
    out = out.unionByName(_rows(t["groups"], "groups", "grp", ["n", "avg_x"])).unionByName(_rows(t["styles"], "styles", "cluster_id", ["x"]))
    out = out.unionByName(_rows(t["graph"], "graph", None, ["avg_degree", "median_degree", "isolated"]))
    out = out.unionByName(_rows(t["missing"], "missing", "column_name", ["missing", "missing_share"]))
    return rounded(out.unionByName(_rows(t["agreement"], "agreement", None, ["nmi", "purity"])))


@query("c1_kmeans_checks", "select count(*) as n_rows, count(*) as labelled, least(10, count(*)) as n_clusters, true as nearest, true as tighter from embeddings")
def c1_kmeans_checks(spark, d):
    """Every row once; clusters as many as asked for; distances are to centres beside the clusters' means (1 % of the squares), and squares are under those around one mean."""
    v = _vectors(spark, d)
    found = cut(clusters.kmeans(v, "vec_id", "embedding", 10))
    x = v.join(found, "vec_id").select("cluster_id", F.col("cluster_distance").alias("d"), F.posexplode("embedding").alias("pos", "x"))
    spread = lambda *by: x.groupBy(*by, "pos").agg(F.var_pop(F.col("x").cast("double")).alias("s"), F.count("*").alias("n")).agg(F.sum(F.col("s") * F.col("n")))
    inside, whole = spread("cluster_id").withColumnRenamed("sum((s * n))", "inside"), spread().withColumnRenamed("sum((s * n))", "whole")
    told = found.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("labelled"), F.count_distinct("cluster_id").alias("n_clusters"), F.sum(F.col("cluster_distance") ** 2).alias("squares"))
    y = told.join(inside).join(whole)
    near = (F.col("squares") >= F.col("inside") * (1 - 1e-6)) & (F.col("squares") <= F.col("inside") * 1.01)
    return y.select("n_rows", "labelled", "n_clusters", near.alias("nearest"), (F.col("squares") < F.col("whole")).alias("tighter"))


@query("c6_spectral_checks", with_(_graph_sql(5)) + "select count(distinct src) as n_rows, count(distinct src) as labelled, true as in_range from g where src <> dst")
def c6_spectral_checks(spark, d):
    """Every node with an edge has one of five clusters."""
    x = clusters.spectral_clusters(_graph(spark, d, 5), 5, "vec_id")
    return x.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("labelled"), (F.count_if(~F.col("cluster_id").between(0, 4)) == 0).alias("in_range"))


@query("x2_staged_job_checks", "select count(*) as n_rows, count(*) as entities, 10 as n_clusters, true as sizes, true as cores, true as ranks from embeddings")
def x2_staged_job_checks(spark, d):
    """The ten-stage job's result: each entity once, sizes that its labels have, cores within degrees, ranks between 0 and 1."""
    x = cut(QUERIES["x2_staged_job"](spark, d))
    size = x.groupBy("cluster_id").agg(F.count("*").alias("n"))
    y = x.join(size, "cluster_id")
    bad = lambda c: (F.count_if(~c) == 0)
    fine = {"sizes": F.col("n") == F.col("community_size"), "cores": F.col("core") <= F.col("degree"), "ranks": F.col("pagerank").between(0, 1)}
    return y.agg(F.count("*").alias("n_rows"), F.count_distinct("ent").alias("entities"), F.count_distinct("cluster_id").cast("int").alias("n_clusters"), *[bad(c).alias(n) for n, c in fine.items()])


@query(
    "s20_incremental_merge",
    with_("b as (select o_custkey as k, o_orderkey as told, o_totalprice as total, o_orderstatus as status from orders)")
    + "select k, max(told) as told, arg_max(status, told) as status, round(arg_max(total, told), 2) + 0.0 as total, cast(2 as bigint) as version from b group by 1",
)
def s20_incremental_merge(spark, d):
    """Orders arriving as three batches of files, merged into a table of each customer's latest; later files also hold older orders."""
    from ..streaming.ingest import current_version, loaded, merge_load
    from .records import _fresh

    root = _fresh(spark, "incremental")
    x = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("told"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    for i in range(3):
        x.where(F.pmod(F.xxhash64("told"), F.lit(3)) == i).write.mode("append").parquet(f"{root}/in")
        merge_load(spark, f"{root}/in", x.schema, f"{root}/out", f"{root}/state", ["k"], "told", buckets=8).awaitTermination()
    out = loaded(spark, f"{root}/out").withColumn("version", F.lit(current_version(spark, f"{root}/out")).cast("long"))
    return rounded(out, 2)
