"""Similarity graphs, fusion, smoothing and node metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog_queries import query
from ..operators import graphs, metrics
from .base import ENTITIES, PANEL, entities, load, panel, r, rounded, with_

PAIRS = """v as (select vec_id, cast(embedding as double[]) as e, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as n from embeddings),
  s as (select a.vec_id as src, b.vec_id as dst, round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) as weight from v a join v b on a.vec_id <> b.vec_id),
  k as (select *, row_number() over (partition by src order by weight desc, dst) as rank from s qualify rank <= {k})"""


def _graph_sql(k: int = 5, mutual: bool = False) -> str:
    """The symmetric kNN graph g(src, dst, weight)."""
    how = "min(weight) as weight from b group by 1, 2 having count(*) = 2" if mutual else "max(weight) as weight from b group by 1, 2"
    return PAIRS.format(k=k) + f""", p as (select src, dst, weight from k where weight > 1e-8), b as (select * from p union all select dst, src, weight from p), g as (select src, dst, {how})"""


def _vectors(spark, d):
    return load(spark, d, "embeddings").select("vec_id", "embedding", "label")


def _graph(spark, d, k: int = 5, mutual: bool = False):
    return graphs.knn_graph(_vectors(spark, d), "vec_id", "embedding", k, -1.0, mutual)


@query("g1_knn", with_(PAIRS.format(k=5)) + "select src, dst, round(weight, 6) + 0.0 as weight, rank from k")
def g1_knn(spark, d):
    """Exact cosine neighbours by block products."""
    return rounded(graphs.knn(_vectors(spark, d), "vec_id", "embedding", 5))


@query("g3_knn_l2", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings), s as (select a.vec_id as src, b.vec_id as dst, round(-list_distance(a.e, b.e), 9) as weight from v a join v b on a.vec_id <> b.vec_id) select src, dst, round(weight, 6) + 0.0 as weight, row_number() over (partition by src order by weight desc, dst) as rank from s qualify rank <= 5")
def g3_knn_l2(spark, d):
    return rounded(graphs.knn(_vectors(spark, d), "vec_id", "embedding", 5, "l2"))


@query("g4_mutual_knn_graph", with_(_graph_sql(8, True)) + "select src, dst, round(weight, 6) + 0.0 as weight from g")
def g4_mutual_knn_graph(spark, d):
    return rounded(_graph(spark, d, 8, True))


@query("g5_knn_graph", with_(_graph_sql(5)) + "select src, dst, round(weight, 6) + 0.0 as weight from g")
def g5_knn_graph(spark, d):
    return rounded(_graph(spark, d, 5))


@query("g7_group_cliques", with_(ENTITIES) + ", e as (select a.ent as src, b.ent as dst, 1.0 as w from entities a join entities b on a.l2 = b.l2 and a.ent <> b.ent union all select a.ent, b.ent, 0.4 from entities a join entities b on a.l1 = b.l1 and a.ent <> b.ent) select src, dst, cast(max(w) as double) as weight from e group by 1, 2")
def g7_group_cliques(spark, d):
    """All pairs of an industry with the weight of the finest level shared (quadratic in group sizes)."""
    return graphs.group_cliques(entities(spark, d), "ent", [("l2", 1.0), ("l1", 0.4)])


@query(
    "g6_group_graph",
    with_(ENTITIES)
    + """, m as (select ent, l2 as g, 1.0 as w, 4 as cap, row_number() over (partition by l2 order by ent) - 1 as i, count(*) over (partition by l2) as n from entities
       union all select ent, l1, 0.4, 2, row_number() over (partition by l1 order by ent) - 1, count(*) over (partition by l1) from entities),
  e as (select a.ent as src, b.ent as dst, a.w from m a join m b on a.g = b.g and a.w = b.w and a.ent <> b.ent and (b.i - a.i + a.n) % a.n between 1 and a.cap),
  u as (select src, dst, w from e union all select dst, src, w from e) select src, dst, cast(max(w) as double) as weight from u group by 1, 2""",
)
def g6_group_graph(spark, d):
    """Industry graph with capped degree: edges grow with nodes times cap."""
    return graphs.group_graph(entities(spark, d), "ent", [("l2", 1.0, 4), ("l1", 0.4, 2)])


@query("g8_factor_graph", with_(PANEL) + """, f as (select ent, avg(close) as a, avg(vol) as b, stddev_samp(close) as c from panel group by 1),
  z as (select ent, (a - avg(a) over ()) / stddev_pop(a) over () as a, (b - avg(b) over ()) / stddev_pop(b) over () as b, (c - avg(c) over ()) / stddev_pop(c) over () as c from f),
  s as (select x.ent as src, y.ent as dst, round((x.a * y.a + x.b * y.b + x.c * y.c) / 3, 9) as weight from z x join z y on x.ent <> y.ent)
select src, dst, round(weight, 6) + 0.0 as weight, row_number() over (partition by src order by weight desc, dst) as rank from s where weight >= 0 qualify rank <= 5""")
def g8_factor_graph(spark, d):
    """Mean product of standardised factors."""
    f = panel(spark, d).groupBy("ent").agg(F.avg("close").alias("a"), F.avg("vol").alias("b"), F.stddev_samp("close").alias("c"))
    m = f.agg(*[g(c).alias(f"{n}{c}") for c in "abc" for n, g in (("m", F.avg), ("s", F.stddev_pop))])
    z = f.join(F.broadcast(m)).select("ent", F.array(*[(F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}") for c in "abc"]).alias("z"))
    return rounded(graphs.knn(z, "ent", "z", 5, "mean_product", 0.0))


@query("g11_return_correlation", with_(PANEL) + """, ret as (select ent, day, close / nullif(lag(close) over (partition by ent order by day), 0) - 1 as ret from panel),
  t as (select distinct day from panel order by day desc limit 250),
  x as (select ent, day, ret from ret where day in (select day from t) and ret is not null),
  c as (select a.ent as src, b.ent as dst, round(coalesce(corr(a.ret, b.ret), 0), 9) as weight from x a join x b on a.day = b.day and a.ent < b.ent group by 1, 2 having count(*) > 1),
  u as (select src, dst, case when isnan(weight) then 0 else weight end as weight from c union all select dst, src, case when isnan(weight) then 0 else weight end from c)
select src, dst, round(weight, 6) + 0.0 as weight, row_number() over (partition by src order by weight desc, dst) as rank from u qualify rank <= 5""")
def g11_return_correlation(spark, d):
    """Pairwise-complete correlation over the last 250 dates."""
    from ..operators.timeseries import returns

    p = returns(panel(spark, d), "ent", "day", periods=[1])
    t = p.select("day").distinct().orderBy(F.desc("day")).limit(250)
    return rounded(graphs.correlation_edges(p.join(F.broadcast(t), "day"), "ent", "day", "ret_1", 5))


@query("g12_style_graph", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings), s as (select a.vec_id as src, b.vec_id as dst, round(exp(-list_distance(a.e, b.e) / 0.5), 9) as weight from v a join v b on a.vec_id <> b.vec_id) select src, dst, round(weight, 6) + 0.0 as weight, row_number() over (partition by src order by weight desc, dst) as rank from s qualify rank <= 5")
def g12_style_graph(spark, d):
    return rounded(graphs.knn(_vectors(spark, d), "vec_id", "embedding", 5, "decay", tau=0.5))


@query("g15_edge_table", with_(_graph_sql(5)) + "select src, dst, round(weight, 6) + 0.0 as weight, row_number() over (order by src, dst) as rank, 'semantic' as edge_type from g where src < dst")
def g15_edge_table(spark, d):
    return rounded(graphs.edge_table(_graph(spark, d, 5), "semantic"))


LAYERS = _graph_sql(5) + """, h as (select a.vec_id as src, b.vec_id as dst, 1.0 as weight from embeddings a join embeddings b on a.label = b.label and abs(a.vec_id - b.vec_id) between 1 and 40)"""


def _layers(spark, d):
    v = _vectors(spark, d)
    a = v.select(F.col("vec_id").alias("src"), "label")
    b = v.select(F.col("vec_id").alias("dst"), "label")
    return {"near": _graph(spark, d, 5), "label": a.join(b, "label").where("abs(src - dst) between 1 and 40").select("src", "dst", F.lit(1.0).alias("weight"))}


@query("u1_fuse", with_(LAYERS) + "select src, dst, round(sum(weight), 6) + 0.0 as weight from (select src, dst, weight * 0.6 as weight from g union all select src, dst, weight * 0.4 from h) group by 1, 2")
def u1_fuse(spark, d):
    return rounded(graphs.fuse(_layers(spark, d), {"near": 0.6, "label": 0.4, "none": 1.0}))


@query(
    "u2_fuse_normalized_top",
    with_(LAYERS)
    + """, n as (select src, dst, weight / (select max(weight) from g) * 0.6 as weight from g union all select src, dst, weight / (select max(weight) from h) * 0.4 from h),
  f as (select src, dst, sum(weight) as weight from n group by 1, 2 having sum(weight) >= 0.05),
  t as (select src, dst, weight from f qualify row_number() over (partition by src order by weight desc, dst) <= 4)
select src, dst, round(max(weight), 6) + 0.0 as weight from (select * from t union all select dst, src, weight from t) group by 1, 2""",
)
def u2_fuse_normalized_top(spark, d):
    return rounded(graphs.fuse(_layers(spark, d), {"near": 0.6, "label": 0.4}, "max", 4, 0.05))


@query("u4_multiplex", with_(LAYERS) + "select src, dst, round(sum(weight), 6) + 0.0 as weight from (select src, dst, weight * 0.3 as weight from g union all select src, dst, weight * 0.2 from h) group by 1, 2")
def u4_multiplex(spark, d):
    """Weights over the sum of all configured ones, absent layers included."""
    return rounded(graphs.fuse(_layers(spark, d), {"near": 0.6, "label": 0.4, "absent": 1.0}, denominator="all"))


@query(
    "u5_smooth",
    with_(_graph_sql(5), "x as (select vec_id as id, cast(label as double) as x from embeddings)", "o1 as (select x.id, 0.7 * x.x + 0.3 * coalesce(m, 0) as o from x left join (select src, sum(x * weight) / sum(weight) as m from g join x on dst = id group by 1) on src = id)")
    + "select x.id as vec_id, round(0.7 * x.x + 0.3 * coalesce(m, 0), 6) + 0.0 as label from x left join (select src, sum(o * weight) / sum(weight) as m from g join o1 on dst = id group by 1) on src = x.id",
)
def u5_smooth(spark, d):
    return rounded(graphs.smooth(_graph(spark, d, 5), _vectors(spark, d), "vec_id", ["label"], 0.7, 2))


@query("m1_degrees", with_(_graph_sql(5)) + "select vec_id, count(g.src) as degree, round(coalesce(sum(weight), 0), 5) + 0.0 as weighted_degree from embeddings left join g on vec_id = g.src group by 1")
def m1_degrees(spark, d):
    return rounded(metrics.degrees(_graph(spark, d, 5), _vectors(spark, d), "vec_id"), 5)


def _components_sql(rounds: int) -> str:
    """Least labels along edges and labels of labels, as many rounds as the tables need and some more."""
    parts = ["e as materialized (select distinct o_custkey as a, 1000000 + (o_orderkey * 7) // 40 as b from orders)", "u as materialized (select a, b from e union select b, a from e)", "c0 as materialized (select distinct a as id, a as c from u)"]
    for i in range(1, rounds + 1):
        parts.append(f"n{i} as materialized (select o.id, least(o.c, min(x.c)) as c from c{i - 1} o join u on u.a = o.id join c{i - 1} x on x.id = u.b group by o.id, o.c)")
        parts.append(f"c{i} as materialized (select n.id, least(n.c, m.c) as c from n{i} n join n{i} m on m.id = n.c)")
    return with_(*parts) + f"select id, c as component, count(*) over (partition by c) as size from c{rounds}"


@query("m2_components", _components_sql(16))
def m2_components(spark, d):
    """Connected components of customers and groups of neighbouring orders."""
    e = load(spark, d, "orders").select(F.col("o_custkey").alias("src"), (1000000 + F.floor(F.col("o_orderkey") * 7 / 40)).alias("dst")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return metrics.connected_components(both, both.select(F.col("src").alias("id")).distinct(), "id")


def _pagerank_sql(rounds: int) -> str:
    steps = [f"r{i} as (select v.vec_id as id, 0.15 / n + 0.85 * coalesce(m, 0) as r from embeddings v cross join nn left join (select dst, sum(p * r) as m from p1 join r{i - 1} on src = id group by 1) on dst = v.vec_id)" for i in range(1, rounds + 1)]
    return with_(_graph_sql(5), "nn as (select count(*) as n from embeddings)", "p1 as materialized (select src, dst, weight / sum(weight) over (partition by src) as p from g)", "r0 as (select vec_id as id, 1.0 / n as r from embeddings, nn)", *[s.replace(" as (", " as materialized (", 1) for s in steps]) + f"select id as vec_id, round(r, 6) + 0.0 as pagerank from r{rounds}"


@query("m3_pagerank", _pagerank_sql(10))
def m3_pagerank(spark, d):
    """Ten rounds of power iteration."""
    return rounded(metrics.pagerank(_graph(spark, d, 5), _vectors(spark, d), "vec_id", rounds=10, tol=0.0, check_every=10))


def _eigenvector_sql(rounds: int) -> str:
    steps = ["x0 as materialized (select vec_id as id, 1.0 as x from embeddings)"]
    steps += [f"x{i} as materialized (select l.id, (l.x + coalesce(sum(g.weight * m.x), 0)) / 10 as x from x{i - 1} l left join g on g.src = l.id left join x{i - 1} m on m.id = g.dst group by l.id, l.x)" for i in range(1, rounds + 1)]
    return with_(_graph_sql(5), *steps) + f"select id as vec_id, round(x / (select sum(x) from x{rounds}), 6) + 0.0 as eigenvector from x{rounds}"


@query("m6_eigenvector", _eigenvector_sql(30))
def m6_eigenvector(spark, d):
    """Thirty rounds of power iteration."""
    return rounded(metrics.eigenvector_centrality(_graph(spark, d, 5), _vectors(spark, d), "vec_id", rounds=30, tol=0.0, check_every=10))


def _betweenness_sql(levels: int) -> str:
    parts = ["e as materialized (select distinct src, dst from g where src <> dst)", "l0 as materialized (select vec_id as root, vec_id as id, cast(1 as double) as paths from embeddings order by vec_id limit 20)", "s0 as materialized (select root, id from l0)"]
    for i in range(1, levels + 1):
        parts.append(f"l{i} as materialized (select root, dst as id, sum(paths) as paths from l{i - 1} join e on id = src where not exists (select 1 from s{i - 1} s where s.root = l{i - 1}.root and s.id = e.dst) group by 1, 2)")
        parts.append(f"s{i} as materialized (select * from s{i - 1} union all select root, id from l{i})")
    parts.append(f"b{levels} as materialized (select root, id, paths, cast(0 as double) as s from l{levels})")
    for i in range(levels - 1, -1, -1):
        parts.append(f"b{i} as materialized (select u.root, u.id, u.paths, coalesce(sum(u.paths / b.paths * (1 + b.s)), 0) as s from l{i} u left join (e join b{i + 1} b on e.dst = b.id) on b.root = u.root and e.src = u.id group by 1, 2, 3)")
    every = " union all ".join(f"select root, id, s from b{i} where root <> id" for i in range(levels + 1))
    return with_(_graph_sql(5), *parts, f"t as (select id, sum(s) as s from ({every}) group by 1)", "n as (select cast(count(*) as double) as n from embeddings)") + "select vec_id, round(coalesce(s, 0) * (n / 20) / ((n - 1) * (n - 2)), 6) + 0.0 as betweenness from embeddings left join t on vec_id = id, n"


@query("m7_betweenness", _betweenness_sql(14))
def m7_betweenness(spark, d):
    """Shortest-path shares from the 20 least ids (the sources are a parameter of the estimate)."""
    v = _vectors(spark, d)
    return rounded(metrics.betweenness(_graph(spark, d, 5), v, "vec_id", roots=v.orderBy("vec_id").limit(20)))


@query("m8_clustering_coefficient", with_(_graph_sql(8)) + ", d as (select vec_id, count(g.src) as degree from embeddings left join g on vec_id = g.src group by 1), t as (select a.src as id, count(*) / 2 as t from g a join g b on a.src = b.src and a.dst <> b.dst join g c on c.src = a.dst and c.dst = b.dst group by 1) select vec_id, degree, cast(coalesce(t, 0) as bigint) as triangles, round(case when degree < 2 then 0 else 2 * coalesce(t, 0) / (degree * (degree - 1)) end, 6) + 0.0 as clustering from d left join t on vec_id = id")
def m8_clustering_coefficient(spark, d):
    return rounded(metrics.clustering_coefficient(_graph(spark, d, 8), _vectors(spark, d), "vec_id"))


def _core_sql(rounds: int) -> str:
    parts = ["e as materialized (select distinct src, dst from g where src <> dst)", "h0 as materialized (select vec_id as id, count(e.dst) as h from embeddings left join e on e.src = vec_id group by 1)"]
    for i in range(1, rounds + 1):
        ranked = f"select e.src, x.h, row_number() over (partition by e.src order by x.h desc) as i from e join h{i - 1} x on x.id = e.dst"
        parts.append(f"h{i} as materialized (select o.id, coalesce(max(least(r.h, r.i)), 0) as h from h{i - 1} o left join ({ranked}) r on r.src = o.id group by 1)")
    return with_(_graph_sql(5), *parts) + f"select id as vec_id, cast(h as bigint) as core from h{rounds}"


@query("m9_core_numbers", _core_sql(40))
def m9_core_numbers(spark, d):
    return metrics.core_numbers(_graph(spark, d, 5), _vectors(spark, d), "vec_id")


@query("m10_neighbour_means", with_(_graph_sql(5)) + "select v.vec_id, round(coalesce(avg(u.label), 0), 6) + 0.0 as neighbour_label from embeddings v left join g on v.vec_id = g.src left join embeddings u on u.vec_id = g.dst group by 1")
def m10_neighbour_means(spark, d):
    return rounded(metrics.neighbour_means(_graph(spark, d, 5), _vectors(spark, d), "vec_id", ["label"]))


@query("m11_bridge_score", with_(_graph_sql(5)) + "select v.vec_id, round(coalesce(avg(case when u.label <> v.label then 1.0 else 0.0 end) filter (u.vec_id is not null), 0), 6) + 0.0 as bridge_score from embeddings v left join g on v.vec_id = g.src left join embeddings u on u.vec_id = g.dst group by 1")
def m11_bridge_score(spark, d):
    return rounded(metrics.neighbour_agreement(_graph(spark, d, 5), _vectors(spark, d), "vec_id", "label", True, "bridge_score"))


@query("m12_neighbour_dispersion", with_(_graph_sql(5)) + ", x as (select g.src, abs(u.label - avg(u.label) over (partition by g.src)) as dd from g join embeddings u on u.vec_id = g.dst) select v.vec_id, round(case when count(x.src) >= 2 then avg(dd) else 0 end, 6) + 0.0 as dispersion from embeddings v left join x on v.vec_id = x.src group by 1")
def m12_neighbour_dispersion(spark, d):
    return rounded(metrics.neighbour_dispersion(_graph(spark, d, 5), _vectors(spark, d), "vec_id", ["label"]))


@query("m13_agreement", with_(_graph_sql(5)) + "select v.vec_id, round(coalesce(avg(case when u.label = v.label then 1.0 else 0.0 end) filter (u.vec_id is not null), 0), 6) + 0.0 as agreement from embeddings v left join g on v.vec_id = g.src left join embeddings u on u.vec_id = g.dst group by 1")
def m13_agreement(spark, d):
    return rounded(metrics.neighbour_agreement(_graph(spark, d, 5), _vectors(spark, d), "vec_id", "label"))


@query("m14_conductance", with_(_graph_sql(5)) + "select a.label, round(sum(case when a.label = b.label then weight else 0 end), 5) + 0.0 as internal, round(sum(case when a.label <> b.label then weight else 0 end), 5) + 0.0 as external, round(sum(case when a.label <> b.label then weight else 0 end) / sum(weight), 5) + 0.0 as conductance from g join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst group by 1")
def m14_conductance(spark, d):
    return rounded(metrics.conductance(_graph(spark, d, 5), _vectors(spark, d), "vec_id", "label"), 5)


@query("a22_layer_quality", with_(LAYERS) + ", u as (select 'near' as layer, * from g union all select 'label', * from h), n as (select count(*) as n from embeddings) select layer, count(*) filter (src < dst) as n_edges, round(2.0 * count(*) filter (src < dst) / any_value(n), 6) + 0.0 as avg_degree, any_value(n) - count(distinct src) as isolated, round(2.0 * count(*) filter (src < dst) / (any_value(n) * (any_value(n) - 1)), 6) + 0.0 as density, round(avg(weight), 6) + 0.0 as mean_weight from u, n group by 1")
def a22_layer_quality(spark, d):
    return rounded(graphs.layer_quality(_layers(spark, d), _vectors(spark, d), "vec_id"))


@query("v4_top_pagerank", _pagerank_sql(90).replace("round(r, 6)", "round(r, 5)") + " order by pagerank desc, vec_id limit 20")
def v4_top_pagerank(spark, d):
    """The 20 nodes of greatest rank (a top-k report)."""
    x = metrics.pagerank(_graph(spark, d, 5), _vectors(spark, d), "vec_id", tol=1e-7, rounds=200)
    return x.orderBy(F.round("pagerank", 5).desc(), "vec_id").limit(20).select("vec_id", r("pagerank", 5).alias("pagerank"))


@query("m16_node_metrics", None)
def m16_node_metrics(spark, d):
    v = _vectors(spark, d).withColumn("grp", F.col("label") % 3)
    return rounded(metrics.node_metrics(_graph(spark, d, 5), v, "vec_id", "label", "grp", ["label"], ["label"]), 5)
