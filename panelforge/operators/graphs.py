"""Similarity graphs as edge tables (src, dst, weight): construction, fusion, smoothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .correlations import correlated
from .neighbours import nearest
from .numbering import numbered
from .quantiles import exact_quantiles, one_row

def knn(vectors: DataFrame, id_col: str, vector_col: str, k: int, metric: str = "cosine", min_sim: float | None = None, tau: float = 1.0) -> DataFrame:
    """src, dst, weight, rank: each vector's k most similar others (rounded to 9 digits before ranking, ties by dst id).

    A row is never its own neighbour, whatever copies of it there are. Fewer than k edges come out where fewer reach
    ``min_sim``. Exact: blocks of vectors are compared in pairs, and pairs too far apart to matter are left out. Metrics:
    cosine, inner, mean_product, l2 (weight is the negative distance), decay (exp(-distance / tau)). Vectors have one length.
    """
    return nearest(vectors, id_col, vector_col, k, metric, min_sim, tau)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def symmetric(edges: DataFrame, how: str = "max", least: float = 1e-8) -> DataFrame:
    """Both directions of every edge, with the greater of the two weights (``max``) or, for pairs with both, the smaller (``min``). Self-loops, missing weights and those up to ``least`` go; weights of repeated edges add up first."""
    e = edges.where((F.col("src") != F.col("dst")) & (F.col("weight") > least) & ~F.isnan("weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    both = e.unionByName(reversed_edges(e)).groupBy("src", "dst")
    if how == "max":
        return both.agg(F.max("weight").alias("weight"))
    return both.agg(F.min("weight").alias("weight"), F.count("*").alias("n")).where("n = 2").drop("n")


def knn_graph(vectors: DataFrame, id_col: str, vector_col: str, k: int, min_sim: float = 0.0, mutual: bool = True, metric: str = "cosine", tau: float = 1.0) -> DataFrame:
    """Symmetric kNN graph: edges both ends chose (mutual), or any end chose. It is written, so that whatever reads it, however often, compares no vectors again."""
    return cut(symmetric(knn(vectors, id_col, vector_col, k, metric, min_sim, tau), "min" if mutual else "max"))


def figures_graph(df: DataFrame, id_col: str, columns: Sequence[str], k: int = 20) -> DataFrame:
    """Mutual cosine kNN graph of figures: NULLs become the column's median, then z-scores with the sample deviation (0 counts as 1). Columns that ``df`` lacks are left out."""
    used = [c for c in columns if c in df.columns]
    x = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in used])
    medians = one_row(exact_quantiles(x, used, [0.5]), used, "_m_")
    x = x.join(F.broadcast(medians)).select(id_col, *[F.coalesce(F.col(c), F.col(f"_m_{c}")[0]).alias(c) for c in used])
    stats = x.agg(*[g(c).alias(f"_{n}_{c}") for c in used for n, g in (("a", F.avg), ("s", F.stddev_samp))])
    sd = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    z = x.join(F.broadcast(stats)).select(id_col, F.array(*[(F.col(c) - F.col(f"_a_{c}")) / sd(c) for c in used]).alias("z"))
    return knn_graph(z, id_col, "z", k, 0.0, mutual=True)


def filled_correlation(cells: DataFrame, id_col: str, at: str, value: str, k: int, min_corr: float = 0.0) -> DataFrame:
    """src, dst, weight, rank: correlation of series on one set of dates (missing cells are 0 already): standardised series under the block kernel. Constant series correlate with nothing."""
    w = Window.partitionBy(id_col)
    z = cells.select(id_col, at, ((F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))).alias("z"))
    v = z.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, F.coalesce("z", F.lit(0.0)).alias("z")))), lambda s: s["z"]).alias("v"))
    return knn(v, id_col, "v", k, "mean_product", min_corr)


def fuse_candidates(layers: Mapping[str, DataFrame], weights: Mapping[str, float], k: int) -> DataFrame:
    """src, dst, weight, rank: each node's union of neighbours over the layers, by weighted mean (a layer without the edge counts 0), the k greatest."""
    total = sum(weights[n] for n in layers)
    parts = None
    for name, e in layers.items():
        e = e.where("src <> dst").select("src", "dst", (F.col("weight") * F.lit(weights[name] / total)).alias("weight"))
        parts = e if parts is None else parts.unionByName(e)
    fused = parts.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("src").orderBy(F.round("weight", 9).desc(), "dst")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def group_graph(nodes: DataFrame, id_col: str, levels: Sequence[tuple[str, float, int]]) -> DataFrame:
    """Edges between members of a group: for each (column, weight, cap) a node is linked with the ``cap`` members that follow it in a ring by id, so hubs stay small and edges grow with nodes times cap. A pair has the greatest of its levels' weights."""
    out = None
    for column, weight, cap in levels:
        m = nodes.where(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), F.col(column).alias("g"))
        m = m.withColumns({"i": F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1, "n": F.count("*").over(Window.partitionBy("g"))})
        a = m.select(F.col("id").alias("src"), "g", "i", "n", F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("step")).where(F.col("step") < F.col("n")).withColumn("to", F.pmod(F.col("i") + F.col("step"), F.col("n")))
        e = a.join(m.select(F.col("id").alias("dst"), "g", F.col("i").alias("to")), ["g", "to"]).select("src", "dst", F.lit(float(weight)).alias("weight"))
        out = e if out is None else out.unionByName(e)
    return out.unionByName(reversed_edges(out)).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


#: Members of a group that one task pairs with all others of it, on average.
CLIQUE_ROWS = 1024


def group_cliques(nodes: DataFrame, id_col: str, levels: Sequence[tuple[str, float]]) -> DataFrame:
    """All pairs of a group, the greatest weight of the levels that match. Grows with the squares of group sizes; ``group_graph`` doesn't.

    Pairs are not shuffled: each is made by the level of greatest weight that its ends share, in a task that holds some
    of a group's members. Ids with several rows have their pairs brought together afterwards.
    """
    order = sorted(levels, key=lambda x: -x[1])
    names = [f"_l{i}" for i in range(len(order))]
    x = cut(nodes.select(F.col(id_col).alias("id"), *[F.col(c).alias(n) for (c, _), n in zip(order, names)]).distinct())
    out = None
    for i, (n, (_, weight)) in enumerate(zip(names, order)):
        a = x.where(F.col(n).isNotNull()).select(F.col(n).alias("g"), "id", *names[:i])
        size = a.groupBy("g").agg(F.ceil(F.count("*") / CLIQUE_ROWS).cast("int").alias("parts"))
        a = a.join(F.broadcast(size), "g")
        mine = a.select("g", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("src"), *[F.col(m).alias(f"{m}_a") for m in names[:i]])
        other = a.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("dst"), *[F.col(m).alias(f"{m}_b") for m in names[:i]])
        e = mine.join(other.hint("shuffle_hash"), ["g", "part"]).where("src <> dst")
        for m in names[:i]:
            e = e.where(~F.coalesce(F.col(f"{m}_a") == F.col(f"{m}_b"), F.lit(False)))
        e = e.select("src", "dst", F.lit(float(weight)).alias("weight"))
        out = e if out is None else out.unionByName(e)
    if x.groupBy("id").count().where("count > 1").limit(1).count():
        return out.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return out


def correlation_edges(long: DataFrame, id_col: str, at: str, value: str, k: int, min_corr: float | None = None, signed: bool = True) -> DataFrame:
    """src, dst, weight, rank: Pearson correlation of series over the dates both have (two at least), each entity's k greatest (by size if not ``signed``).

    Weights are rounded to 9 digits before ranking, ties by dst; a series that is constant over the common dates has 0. By
    masked products of blocks of series: no row for a pair and a date.
    """
    return correlated(long, id_col, at, value, k, min_corr, signed)


def edge_table(edges: DataFrame, kind: str) -> DataFrame:
    """Each undirected edge once, numbered by (src, dst)."""
    e = edges.where("src < dst").select("src", "dst", "weight")
    return numbered(e, ["src", "dst"], "rank").withColumn("edge_type", F.lit(kind))


def fuse(layers: Mapping[str, DataFrame], weights: Mapping[str, float], normalize: str = "none", top: int | None = None, min_weight: float = 0.0, denominator: str = "used") -> DataFrame:
    """Weighted mean of layers: sum of w * weight over the sum of weights (of the layers used, or of all configured).

    ``normalize``: none, max (each layer by its greatest weight) or row_sum (each edge by its source's sum). With
    ``top`` each row keeps its greatest and the result is made symmetric again.
    """
    used = {n: w for n, w in weights.items() if n in layers and w > 0}
    if not used:
        raise ValueError("no layer has a positive weight")
    total = sum(used.values()) if denominator == "used" else sum(w for w in weights.values() if w > 0)
    parts = None
    for name, w in used.items():
        e = layers[name].where("src <> dst").select("src", "dst", "weight")
        if normalize == "row_sum":
            e = e.withColumn("weight", F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy("src")), F.lit(0.0)))
        elif normalize == "max":
            e = e.join(F.broadcast(e.agg(F.max("weight").alias("_m")))).select("src", "dst", (F.col("weight") / F.nullif(F.col("_m"), F.lit(0.0))).alias("weight"))
        elif normalize != "none":
            raise ValueError(f"unknown normalization {normalize}")
        e = e.withColumn("weight", F.col("weight") * F.lit(w / total))
        parts = e if parts is None else parts.unionByName(e)
    fused = parts.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= min_weight)
    if top is None:
        return fused
    kept = fused.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where(F.col("_r") <= top).drop("_r")
    return kept.unionByName(reversed_edges(kept)).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def smooth(edges: DataFrame, features: DataFrame, id_col: str, columns: Sequence[str], alpha: float = 0.7, steps: int = 2) -> DataFrame:
    """out = alpha * x + (1 - alpha) * weighted mean of the neighbours' out, ``steps`` times; isolated nodes get alpha * x. Columns are scalars, so each step is one join and one partial aggregation."""
    base = features.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in columns])
    out = base
    for _ in range(steps):
        near = edges.join(out, F.col("dst") == F.col("id")).groupBy("src").agg(*[(F.sum(F.col(c) * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias(f"_{c}") for c in columns])
        out = base.join(near, F.col("id") == F.col("src"), "left").select("id", *[(F.lit(alpha) * F.col(c) + F.lit(1 - alpha) * F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in columns])
    return out.withColumnRenamed("id", id_col)


def layer_quality(layers: Mapping[str, DataFrame], nodes: DataFrame, id_col: str) -> DataFrame:
    """layer, n_edges, avg_degree, isolated, density, mean_weight of symmetric layers."""
    every = None
    for name, e in layers.items():
        x = e.select(F.lit(name).alias("layer"), "src", "dst", "weight")
        every = x if every is None else every.unionByName(x)
    n = nodes.agg(F.countDistinct(id_col).alias("n"))
    stats = every.groupBy("layer").agg(F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(0)).alias("n_edges"), F.countDistinct("src").alias("touched"), F.avg("weight").alias("mean_weight"))
    pairs: Column = F.col("n") * (F.col("n") - 1)
    return stats.join(F.broadcast(n)).select("layer", "n_edges", (2 * F.col("n_edges") / F.col("n")).alias("avg_degree"), (F.col("n") - F.col("touched")).alias("isolated"), (2 * F.col("n_edges") / F.nullif(pairs, F.lit(0))).alias("density"), "mean_weight")
