"""Clustering, communities, cluster quality, research jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog_queries import query
from ..operators import clusters
from ..plans.research import research_report, semantic_stages
from .base import load, rounded, with_
from .graph import _graph, _graph_sql, _vectors

CENTRES = """p as (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding) as x from embeddings), m as (select label, pos, avg(cast(x as double)) as m from p group by 1, 2),
  c as (select label, list(m order by pos) as m from m group by 1), u as (select label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) as p from c)"""


@query("c1_kmeans", None)
def c1_kmeans(spark, d):
    return rounded(clusters.kmeans(_vectors(spark, d), "vec_id", "embedding", 10))


@query("c3_density_clusters", None)
def c3_density_clusters(spark, d):
    return rounded(clusters.density_clusters(_vectors(spark, d), "vec_id", "embedding", 5))


@query("c4_leiden", None)
def c4_leiden(spark, d):
    return clusters.communities(_graph(spark, d, 5), _vectors(spark, d), "vec_id", refine=True)


@query("c5_louvain", None)
def c5_louvain(spark, d):
    return clusters.communities(_graph(spark, d, 5), _vectors(spark, d), "vec_id")


@query("c6_spectral", None)
def c6_spectral(spark, d):
    return rounded(clusters.spectral_clusters(_graph(spark, d, 5), 5, "vec_id"))


@query("c7_modularity", with_(_graph_sql(5)) + ", sm as (select a.label, sum(case when a.label = b.label then weight else 0 end) as i, sum(weight) as d from g join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst group by 1), tt as (select sum(d) as m2 from sm) select round(sum(i / m2 - power(d / m2, 2)), 6) + 0.0 as modularity from sm, tt")
def c7_modularity(spark, d):
    return rounded(clusters.modularity(_graph(spark, d, 5), _vectors(spark, d), "vec_id", "label"))


LABELS = "x as (select doc_id % 7 as a, lang as b from documents), c as (select a, b, count(*) as n from x group by 1, 2), w as (select *, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as t from c)"


@query("c8_nmi", with_(LABELS) + "select round(2 * sum(n / t * ln((n / t) / ((na / t) * (nb / t)))) / (-sum(n / t * ln(na / t)) - sum(n / t * ln(nb / t))), 6) + 0.0 as nmi from w")
def c8_nmi(spark, d):
    return rounded(clusters.nmi(load(spark, d, "documents").withColumn("a", F.col("doc_id") % 7), "a", "lang"))


@query("c9_purity", with_(LABELS) + "select round(sum(m) / sum(s), 6) + 0.0 as purity from (select max(n) as m, sum(n) as s from c group by a)")
def c9_purity(spark, d):
    return rounded(clusters.purity(load(spark, d, "documents").withColumn("a", F.col("doc_id") % 7), "a", "lang"))


@query("a7_cluster_summary", "with x as (select case when doc_id % 11 = 5 then -1 when doc_id % 11 = 3 then 12 else doc_id % 11 end as c, case when doc_id % 13 <> 0 then lang end as g from documents), k as (select c, g, count(*) as n from x where c >= 0 group by 1, 2), s as (select c, sum(n) as n, max(n) filter (g is not null) as m, arg_max(g, (n, g)) filter (g is not null) as top_group from k group by 1) select cast(i as bigint) as cluster_id, cast(coalesce(n, 0) as bigint) as n, top_group, round(m / nullif(n, 0), 6) + 0.0 as top_share from range(0, 13) t(i) left join s on i = c")
def a7_cluster_summary(spark, d):
    """Empty ids are listed too."""
    i = F.col("doc_id") % 11
    x = load(spark, d, "documents").withColumns({"c": F.when(i == 5, -1).when(i == 3, 12).otherwise(i), "g": F.when(F.col("doc_id") % 13 != 0, F.col("lang"))})
    return rounded(clusters.cluster_summary(x, "c", "g"))


@query("c11_prototypes", with_(CENTRES) + "select label, generate_subscripts(p, 1) - 1 as pos, round(unnest(p), 5) + 0.0 as x from u")
def c11_prototypes(spark, d):
    v = _vectors(spark, d)
    x = clusters.prototypes(v.drop("label"), v, "vec_id", "embedding", "label")
    return rounded(x.select("label", F.posexplode("prototype").alias("pos", "x")), 5)


@query("c12_exposures", with_(CENTRES) + ", s as (select vec_id, u.label, list_inner_product(cast(embedding as double[]), p) as score from embeddings, u) select vec_id, arg_max(label, score) as top_proto_id, round(max(score), 5) + 0.0 as top_proto_score from s group by 1")
def c12_exposures(spark, d):
    v = _vectors(spark, d)
    p = clusters.prototypes(v.drop("label"), v, "vec_id", "embedding", "label")
    return rounded(clusters.top_exposure(clusters.exposures(v.drop("label"), p, "vec_id", "embedding", "label"), "vec_id", "label"), 5)


CENTRED = """p as (select vec_id, label, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as x from embeddings),
  m as (select label, pos, avg(x) as m from p group by 1, 2), w as (select pos, avg(x) as g from p group by 1),
  d as (select p.vec_id, p.label, sqrt(sum((p.x - m.m) ** 2)) as d from p join m using (label, pos) group by 1, 2),
  s as (select label, avg(d) as s, sum(d * d) as w, count(*) as n from d group by 1),
  b as (select label, sum((m.m - g) ** 2) as b from m join w using (pos) group by 1),
  q as (select i.label, max((i.s + j.s) / nullif(dd, 0)) as r from s i join s j on i.label <> j.label join (select x.label as a, y.label as b, sqrt(sum((x.m - y.m) ** 2)) as dd from m x join m y using (pos) group by 1, 2) t on t.a = i.label and t.b = j.label group by 1)"""


@query("c10_separation", with_(CENTRED) + "select round((select avg(r) from q), 5) + 0.0 as davies_bouldin, round((sum(n * b) / (count(*) - 1)) / nullif(sum(w) / (sum(n) - count(*)), 0), 5) + 0.0 as calinski_harabasz from s join b using (label)")
def c10_separation(spark, d):
    v = _vectors(spark, d)
    return rounded(clusters.separation(v.drop("label"), v, "vec_id", "embedding", "label"), 5)


@query(
    "c10_silhouette",
    """with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), k as (select label, count(*) as n from v group by 1),
  s as (select x.vec_id, x.label, y.label as other, sum(list_distance(x.e, y.e)) as t from v x join v y on true group by 1, 2, 3),
  a as (select vec_id, max(case when s.label = other then t / greatest(n - 1, 1) end) as a, max(case when s.label = other then n end) as own, min(case when s.label <> other then t / n end) as b from s join k on k.label = other group by 1)
select round(avg(case when own > 1 and b is not null then (b - a) / greatest(a, b) else 0 end), 5) + 0.0 as silhouette from a""",
)
def c10_silhouette(spark, d):
    v = _vectors(spark, d)
    return rounded(clusters.silhouette(v.drop("label"), v, "vec_id", "embedding", "label"), 5)


@query("x1_semantic_job", None)
def x1_semantic_job(spark, d):
    """The staged semantic job over the documents' texts."""
    import uuid

    from ..plans.stages import run_stages
    from ..sources.shared import shared_root

    records = load(spark, d, "documents").select("doc_id", "text", "lang", "source")
    stages = semantic_stages(records, "doc_id", {"text": ["text"]}, {"text": 0.55}, ["lang", "source"], k=5, clusters_n=8, text_size=16)
    root = f"{shared_root(spark)}/semantic-{uuid.uuid4().hex}"
    return rounded(run_stages(spark, stages, root)["result"], 4)


@query("r1_research_report", None)
def r1_research_report(spark, d):
    """All tables of the research report as one JSON row."""
    from ..operators import metrics
    from ..operators.reports import as_report

    v = _vectors(spark, d).withColumns({"grp": (F.col("label") % 3).cast("string"), "x": F.element_at("embedding", 1).cast("double")})
    g = _graph(spark, d, 5)
    nodes = metrics.degrees(g, v, "vec_id").join(metrics.pagerank(g, v, "vec_id", rounds=10, tol=0.0), "vec_id")
    labels = v.select("vec_id", F.col("label").alias("cluster_id"))
    return as_report(research_report(v.drop("embedding"), labels, nodes, "vec_id", "grp", ["x"], ["x"], ["x", "grp"]))
