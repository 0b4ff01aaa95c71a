"""Clustering, communities and their quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distance, dot, unit
from ..sources.shared import cut
from .communities import communities
from .density import density_clusters
from .numbering import numbered_ids

__all__ = ["communities", "density_clusters", "density_or_kmeans", "kmeans", "spectral_clusters"]


def kmeans(vectors: DataFrame, id_col: str, vector_col: str, k: int, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """id, cluster_id, cluster_distance (Euclidean, to the centre). k is at most the number of rows; no rows give none."""
    v = vectors.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where("v is not null")
    n = v.count()
    spark = vectors.sparkSession
    if not n:
        return v.select(F.col("id").alias(id_col), F.lit(0).alias("cluster_id"), F.lit(0.0).alias("cluster_distance"))
    x = v.withColumn("features", array_to_vector("v"))
    model = KMeans(k=min(k, n), seed=seed, maxIter=max_iter).fit(x) if n > 1 else None
    if model is None:
        return v.select(F.col("id").alias(id_col), F.lit(0).alias("cluster_id"), F.lit(0.0).alias("cluster_distance"))
    centres = spark.createDataFrame([(i, [float(a) for a in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, _c array<double>")
    labelled = model.transform(x).select("id", "v", F.col("prediction").alias("cluster_id"))
    return labelled.join(F.broadcast(centres), "cluster_id").select(F.col("id").alias(id_col), "cluster_id", distance(F.col("v"), F.col("_c")).alias("cluster_distance"))


def prototypes(vectors: DataFrame, labels: DataFrame, id_col: str, vector_col: str, label: str = "cluster_id") -> DataFrame:
    """label, prototype: unit mean vector of each cluster, by one aggregation over (label, position)."""
    x = vectors.join(labels.select(id_col, label), id_col).select(label, F.posexplode(vector_col).alias("pos", "x"))
    m = x.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    sorted_ = m.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("_p"))
    return sorted_.select(label, unit(F.col("_p")).alias("prototype"))


def exposures(vectors: DataFrame, protos: DataFrame, id_col: str, vector_col: str, label: str = "cluster_id") -> DataFrame:
    """id, label, score: dot product of every row with every prototype (which number as many as the clusters)."""
    return vectors.join(F.broadcast(protos)).select(id_col, label, dot(F.col(vector_col), F.col("prototype")).alias("score"))


def top_exposure(scores: DataFrame, id_col: str, label: str = "cluster_id") -> DataFrame:
    """id, top_proto_id, top_proto_score; the smaller label wins ties."""
    return scores.groupBy(id_col).agg(F.max_by(label, F.struct("score", -F.col(label))).alias("top_proto_id"), F.max("score").alias("top_proto_score"))


def modularity(edges: DataFrame, labels: DataFrame, id_col: str, label: str, resolution: float = 1.0) -> DataFrame:
    """modularity = sum over communities of internal / 2m - resolution * (degree / 2m)^2, on symmetric edges; 0 without edges."""
    a = labels.select(F.col(id_col).alias("src"), F.col(label).alias("_a"))
    b = labels.select(F.col(id_col).alias("dst"), F.col(label).alias("_b"))
    s = edges.join(a, "src").join(b, "dst").groupBy("_a").agg(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("i"), F.sum("weight").alias("d"))
    total = s.agg(F.sum("d").alias("m2"))
    return s.join(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("i") / F.col("m2") - resolution * F.pow(F.col("d") / F.col("m2"), 2)), F.lit(0.0)).alias("modularity"))


def contingency(df: DataFrame, label: str, truth: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("a"), F.col(truth).alias("b")).agg(F.count("*").alias("n"))


def nmi(df: DataFrame, label: str, truth: str) -> DataFrame:
    """Mutual information over the mean of the entropies; 1 where both are constant. All from the contingency table."""
    c = contingency(df, label, truth)
    wa, wb = Window.partitionBy("a"), Window.partitionBy("b")
    c = c.withColumns({"na": F.sum("n").over(wa), "nb": F.sum("n").over(wb)})
    total = c.agg(F.sum("n").alias("t"))
    p = c.join(F.broadcast(total)).withColumns({"p": F.col("n") / F.col("t"), "pa": F.col("na") / F.col("t"), "pb": F.col("nb") / F.col("t")})
    s = p.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), (-F.sum(F.col("p") * F.ln("pa"))).alias("ha"), (-F.sum(F.col("p") * F.ln("pb"))).alias("hb"))
    return s.select(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def purity(df: DataFrame, label: str, truth: str) -> DataFrame:
    c = contingency(df, label, truth).groupBy("a").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return c.agg((F.sum("m") / F.sum("n")).alias("purity"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """n_clusters and the mean, sample deviation, least and greatest of their sizes; negative labels are no clusters."""
    n = df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_clusters"), F.avg("n").alias("mean_size"), F.stddev_samp("n").alias("std_size"), F.min("n").alias("least_size"), F.max("n").alias("greatest_size"))


def community_sizes(labels: DataFrame, id_col: str, label: str = "community_id") -> DataFrame:
    """id, label and the number of nodes with that label."""
    return labels.select(id_col, label, F.count("*").over(Window.partitionBy(label)).alias("community_size"))


def cluster_summary(df: DataFrame, label: str, group: str) -> DataFrame:
    """cluster_id from 0 to the greatest, n, top group and its share; empty ids have 0."""
    counts = df.where(F.col(label) >= 0).groupBy(label, group).agg(F.count("*").alias("_c"))
    named = F.col(group).isNotNull()
    s = counts.groupBy(F.col(label).alias("_id")).agg(F.sum("_c").alias("_n"), F.max(F.when(named, F.col("_c"))).alias("_m"), F.max_by(F.when(named, F.col(group)), F.when(named, F.struct("_c", group))).alias("top_group"))
    ids = df.agg(F.coalesce(F.max(label), F.lit(-1)).alias("last")).select(F.explode(F.when(F.col("last") >= 0, F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("cluster_id"))
    return ids.join(s, F.col("cluster_id") == F.col("_id"), "left").select("cluster_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n"), "top_group", (F.col("_m") / F.nullif(F.col("_n"), F.lit(0))).alias("top_share"))


def separation(vectors: DataFrame, labels: DataFrame, id_col: str, vector_col: str, label: str = "cluster_id") -> DataFrame:
    """davies_bouldin and calinski_harabasz, from per-cluster sums; NULL with fewer than two clusters. Centres number as many as the clusters."""
    x = vectors.join(labels.select(id_col, label), id_col).select(id_col, F.col(label).alias("c"), F.col(vector_col).alias("v"))
    centre = x.select("c", F.posexplode("v").alias("p", "x")).groupBy("c", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = centre.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("m"))
    whole = x.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("g"))
    d = x.join(F.broadcast(centre), "c").select("c", distance(F.col("v"), F.col("m")).alias("d"))
    s = centre.join(d.groupBy("c").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"), F.count("*").alias("n")), "c")
    s = s.join(F.broadcast(whole)).withColumn("b", F.col("n") * F.pow(distance(F.col("m"), F.col("g")), 2))
    pair = s.alias("i").join(F.broadcast(s.alias("j")), F.col("i.c") != F.col("j.c")).select(F.col("i.c").alias("c"), ((F.col("i.s") + F.col("j.s")) / F.nullif(distance(F.col("i.m"), F.col("j.m")), F.lit(0.0))).alias("r"))
    db = pair.groupBy("c").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = s.agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ch = ch.select(F.when(F.col("k") > 1, (F.col("b") / (F.col("k") - 1)) / F.nullif(F.col("w") / (F.col("n") - F.col("k")), F.lit(0.0))).alias("calinski_harabasz"))
    return db.join(F.broadcast(ch))


def silhouette(vectors: DataFrame, labels: DataFrame, id_col: str, vector_col: str, label: str = "cluster_id", sample: int = 5000) -> DataFrame:
    """Mean silhouette (Euclidean) of the ``sample`` rows of least id hash, against one another: the sample is the operator's feature and bounds what is broadcast."""
    x = vectors.join(labels.select(id_col, label), id_col).select(F.col(id_col).alias("id"), F.col(label).alias("c"), F.col(vector_col).alias("v"))
    taken = cut(x.orderBy(F.xxhash64("id"), "id").limit(sample))
    local = taken.toPandas()
    matrix, groups = np.array(local["v"].tolist(), np.float64).reshape(len(local), -1), local["c"].to_numpy()
    names, at = np.unique(groups, return_inverse=True) if len(local) else (np.zeros(0), np.zeros(0, int))
    member = np.eye(len(names))[at] if len(names) else np.zeros((0, 0))
    size = member.sum(axis=0)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for low in range(0, len(part), 512):
                rows = part.iloc[low : low + 512]
                y, own = np.array(rows["v"].tolist(), np.float64), np.searchsorted(names, rows["c"].to_numpy())
                d = np.sqrt(np.maximum((y * y).sum(1)[:, None] + (matrix * matrix).sum(1)[None, :] - 2 * y @ matrix.T, 0))
                sums = d @ member
                i = np.arange(len(rows))
                a = sums[i, own] / np.maximum(size[own] - 1, 1)
                mean = sums / size
                mean[i, own] = np.inf
                b = mean.min(axis=1)
                s = np.where((size[own] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
                yield pd.DataFrame({"s": s})

    return taken.mapInPandas(run, "s double").agg(F.avg("s").alias("silhouette"))


def spectral_clusters(edges: DataFrame, k: int, id_col: str = "id", max_iter: int = 20) -> DataFrame:
    """id, cluster_id by power iteration over the affinities, each undirected edge once; ids are of any type that has an order. Nodes without edges have no row."""
    names = numbered_ids(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))), "id")
    a, b = (names.select(F.col("id").alias(end), F.col("no").alias(f"_{end}")) for end in ("src", "dst"))
    e = edges.where("src < dst").join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.col("weight").cast("double").alias("weight"))
    model = PowerIterationClustering(k=k, maxIter=max_iter, weightCol="weight", initMode="degree")
    found = model.assignClusters(cut(e)).select(F.col("id").alias("no"), F.col("cluster").alias("cluster_id"))
    return found.join(names, "no").select(F.col("id").alias(id_col), "cluster_id")


def density_or_kmeans(vectors: DataFrame, id_col: str, vector_col: str, min_size: int = 5, how: str = "density") -> DataFrame:
    """id, cluster_id, probability: ``density_clusters``, or where those aren't wanted k-means with one cluster for 50 rows (two at least) and probability 1."""
    if how == "density":
        return density_clusters(vectors, id_col, vector_col, min_size)
    n = vectors.count()
    return kmeans(vectors, id_col, vector_col, max(2, n // 50)).select(id_col, "cluster_id", F.lit(1.0).alias("probability"))
