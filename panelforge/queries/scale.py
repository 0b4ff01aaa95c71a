"""Vector files, stage manifests and run logs; what must hold for results that SQL can't express row by row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog_queries import query
from ..operators import clusters, density, neighbours, text
from ..plans.stages import Stage, at_least_rows, manifests, run_log, run_stages
from ..sources import npy
from ..sources.shared import cut, shared_root
from .base import load, rounded, with_
from .graph import _graph, _graph_sql, _vectors


def _fresh(spark, name):
    return f"{shared_root(spark)}/panelforge/{name}-{uuid.uuid4().hex}"


@query("s14_vector_files", "select cast(vec_id as varchar) as record_id, cast(len(embedding) as bigint) as size, round(list_sum(cast(embedding as double[])), 4) + 0.0 as total, cast(embedding[1] as double) as first from embeddings")
def s14_vector_files(spark, d):
    """All vectors written as vector files by many tasks and read back by ranges of bytes."""
    path = _fresh(spark, "vectors")
    npy.write_npy(load(spark, d, "embeddings"), "vec_id", "embedding", path, file_bytes=1 << 20)
    x = npy.read_records_npy(spark, path, split_bytes=1 << 18)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return rounded(x.select("record_id", F.size("embedding").cast("long").alias("size"), total.alias("total")), 4).join(x.select("record_id", F.col("embedding")[0].cast("double").alias("first")), "record_id")


@query(
    "s14_vector_ranges",
    "with n as (select count(*) as n, max(len(embedding)) as d from embeddings) select cast(n as bigint) as n_rows, cast(n as bigint) as distinct_rows, cast(0 as bigint) as first_pos from n",
)
def s14_vector_ranges(spark, d):
    """Positions alone, read from the files' headers: no vector is read."""
    path = _fresh(spark, "vectors")
    npy.write_npy(load(spark, d, "embeddings").coalesce(1), "vec_id", "embedding", path, file_bytes=1 << 30)
    x = npy.read_npy(spark, path, "file string, pos long", split_bytes=1 << 16)
    return x.agg(F.count("*").alias("n_rows"), F.count_distinct("file", "pos").alias("distinct_rows"), F.min("pos").alias("first_pos"))


def _account_stages(spark, d, least):
    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")

    def accounts(s, done):
        return orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))

    def active(s, done):
        return done["accounts"].where(F.col("n") >= least)

    def segments(s, done):
        return done["active"].join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))

    def statuses(s, done):
        return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))

    return [
        Stage("accounts", accounts, (), (at_least_rows(1),), {}, {"orders": orders}),
        Stage("active", active, ("accounts",), (), {"least": least}),
        Stage("segments", segments, ("active",), (at_least_rows(1),), {}, {"customer": customer}),
        Stage("statuses", statuses, (), (at_least_rows(1),), {}, {"orders": orders}),
    ]


@query(
    "k6_stage_manifests",
    """with a as (select o_custkey, count(*) as n from orders group by 1)
select 'accounts' as stage, 'built,kept' as actions, count(*) as n_rows, 0 as n_needs, 'o_custkey,n,total' as columns from a
union all select 'active', 'built,built', count(*), 1, 'o_custkey,n,total' from a where n >= 9
union all select 'segments', 'built,built', count(distinct c_mktsegment), 1, 'c_mktsegment,n' from a join customer on o_custkey = c_custkey where n >= 9
union all select 'statuses', 'built,kept', count(distinct o_orderstatus), 0, 'o_orderstatus,n' from orders""",
)
def k6_stage_manifests(spark, d):
    """A job run, one parameter changed, resumed: what its manifests and logs say of each stage."""
    root = _fresh(spark, "accounts")
    run_stages(spark, _account_stages(spark, d, 5), root, resume=True)
    first = run_log(spark, root).agg(F.first("run")).first()[0]
    run_stages(spark, _account_stages(spark, d, 9), root, resume=True)
    told = run_log(spark, root).groupBy("stage").agg(F.concat_ws(",", F.max(F.when(F.col("run") == first, F.col("action"))), F.max(F.when(F.col("run") != first, F.col("action")))).alias("actions"))
    needs = F.size(F.from_json("needs", "map<string,string>"))
    m = manifests(spark, root).select("stage", F.col("rows").alias("n_rows"), needs.alias("n_needs"), F.array_join("columns", ",").alias("columns"))
    return m.join(told, "stage")


@query(
    "c3_density_edges",
    with_(
        "v as (select vec_id, cast(embedding as double[]) as e from embeddings)",
        "s as (select a.vec_id as src, b.vec_id as dst, round(list_distance(a.e, b.e), 9) as d, row_number() over (partition by a.vec_id order by round(list_distance(a.e, b.e), 9), b.vec_id) as i from v a join v b on a.vec_id <> b.vec_id qualify i <= 15)",
        "c as (select src, max(d) as core from s where i <= 5 group by 1)",
        "e as (select least(src, dst) as a, greatest(src, dst) as b, greatest(d, x.core, y.core) as w from s join c x using (src) join c y on y.src = dst)",
    )
    + "select count(*) as n_edges, round(sum(w), 3) + 0.0 as weights from (select a, b, min(w) as w from e group by 1, 2)",
)
def c3_density_edges(spark, d):
    """The mutual-reachability graph that density clusters rest on."""
    near = cut(neighbours.nearest(_vectors(spark, d), "vec_id", "embedding", 15, "l2").select("src", "dst", (-F.col("weight")).alias("d"), "rank"))
    e = density.reachability(near, 5).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("w").alias("w"))
    return rounded(e.agg(F.count("*").alias("n_edges"), F.sum("w").alias("weights")), 3)


@query("c3_density_forest", "select count(*) as n_rows, count(*) as labelled, true as strengths, true as one_tree, true as spans from embeddings")
def c3_density_forest(spark, d):
    """What must hold of density clusters and of the forest below them, in one row."""
    v = _vectors(spark, d)
    near = cut(neighbours.nearest(v, "vec_id", "embedding", 15, "l2").select("src", "dst", (-F.col("weight")).alias("d"), "rank"))
    e = cut(density.reachability(near, 5))
    forest = density.spanning_forest(e)
    from ..operators.metrics import connected_components

    both = lambda x: x.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(x.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    parts = connected_components(both(e), v, "vec_id").select("vec_id", "component")
    own = connected_components(both(forest), v, "vec_id").select("vec_id", F.col("component").alias("mine"))
    same = parts.join(own, "vec_id").agg(F.count_if(F.col("component") != F.col("mine")).alias("apart"), F.count_distinct("component").alias("trees"))
    n = forest.agg(F.count("*").alias("edges"))
    found = density.density_clusters(v, "vec_id", "embedding", 5)
    sound = (F.col("probability").between(0, 1)) & ((F.col("cluster_id") >= 0) | (F.col("probability") == 0)) & (F.col("cluster_id") >= -1)
    told = found.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("labelled"), F.count_if(~sound).alias("unsound"))
    x = told.join(same).join(n)
    return x.select("n_rows", "labelled", (F.col("unsound") == 0).alias("strengths"), (F.col("edges") == F.col("n_rows") - F.col("trees")).alias("one_tree"), (F.col("apart") == 0).alias("spans"))


def _community_checks(spark, d, refine):
    from ..operators.metrics import connected_components

    g, v = cut(_graph(spark, d, 5)), _vectors(spark, d)
    found = cut(clusters.communities(g, v, "vec_id", refine=refine))
    mine, other = clusters.modularity(g, found, "vec_id", "community_id").select(F.col("modularity").alias("mine")), clusters.modularity(g, v, "vec_id", "label").select(F.col("modularity").alias("labels"))
    a, b = (found.select(F.col("vec_id").alias(end), F.col("community_id").alias(f"_{end}")) for end in ("src", "dst"))
    inside = g.join(a, "src").join(b, "dst").where("_src = _dst").select("src", "dst", "weight")
    parts = connected_components(inside, v, "vec_id").select("vec_id", "component")
    split = found.join(parts, "vec_id").groupBy("community_id").agg(F.count_distinct("component").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split"))
    told = found.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("labelled"), (F.max("community_id") + 1 == F.count_distinct("community_id")).alias("gapless"))
    x = told.join(mine).join(other).join(split)
    better = (F.col("mine") > F.col("labels")).alias("better")
    return x.select("n_rows", "labelled", "gapless", better, *([(F.col("split") == 0).alias("connected")] if refine else []))


CHECKED = with_(_graph_sql(5)) + "select count(*) as n_rows, count(*) as labelled, true as gapless, true as better{more} from embeddings"


@query("c4_leiden_checks", CHECKED.format(more=", true as connected"))
def c4_leiden_checks(spark, d):
    """Every node once, communities numbered without gaps and connected, modularity above that of the labels."""
    return _community_checks(spark, d, True)


@query("c5_louvain_checks", CHECKED.format(more=""))
def c5_louvain_checks(spark, d):
    """As above, but Louvain's communities need not be connected."""
    return _community_checks(spark, d, False)


@query("b12_text_embedding_checks", "select count(*) as n_rows, true as unit_or_zero, true as same_length from documents")
def b12_text_embedding_checks(spark, d):
    """Each document has one vector of the length asked for, of length 1 or all zero."""
    x = text.text_embedding(load(spark, d, "documents"), "doc_id", "text", 16, 400)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v))
    fine = (F.abs(size - 1) < 1e-6) | (size == 0)
    return x.agg(F.count("*").alias("n_rows"), (F.count_if(~fine) == 0).alias("unit_or_zero"), (F.count_if(F.size("embedding") != 16) == 0).alias("same_length"))
