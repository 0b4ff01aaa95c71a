"""The semantic and research jobs, as stages over the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, graphs, metrics, reports, text
from .stages import Stage, at_least_rows, distinct_at_least, mean_above


def semantic_stages(records: DataFrame, id_col: str, views: Mapping[str, Sequence[str]], weights: Mapping[str, float], anchor_fields: Sequence[str], k: int = 10, clusters_n: int = 10, text_size: int = 32) -> list[Stage]:
    """Records to fused features, clusters, prototypes, graph, node metrics and smoothed scores."""

    def features(spark, done):
        x = records
        for family in views.values():
            for view in family:
                e = text.text_embedding(records, id_col, view, text_size).withColumnRenamed("embedding", f"_{view}")
                x = x.join(e, id_col)
        x = text.fused_views(x, {f: [f"_{v}" for v in vs] for f, vs in views.items()})
        x = x.join(text.anchors(records, id_col, anchor_fields), id_col)
        return text.semantic_vector(x, {**{f: weights.get(f, 1.0) for f in views}, "anchor": weights.get("anchor", 0.1)}).select(id_col, "semantic")

    def labelled(spark, done):
        return clusters.kmeans(done["features"], id_col, "semantic", clusters_n)

    def exposure(spark, done):
        protos = clusters.prototypes(done["features"], done["clusters"], id_col, "semantic")
        return clusters.top_exposure(clusters.exposures(done["features"], protos, id_col, "semantic"), id_col)

    def graph(spark, done):
        e = graphs.knn_graph(done["features"], id_col, "semantic", k, 0.0, mutual=False)
        return graphs.fuse({"semantic": e}, {"semantic": 1.0}, normalize="max", top=k)

    def nodes(spark, done):
        n = records.select(id_col)
        d = metrics.degrees(done["graph"], n, id_col)
        return d.join(metrics.pagerank(done["graph"], n, id_col), id_col).join(metrics.connected_components(done["graph"], n, id_col), id_col)

    def result(spark, done):
        return records.select(id_col).join(done["clusters"], id_col, "left").join(done["prototypes"], id_col, "left").join(done["nodes"], id_col, "left")

    return [
        Stage("features", features, (), (at_least_rows(1),)),
        Stage("clusters", labelled, ("features",), (distinct_at_least("cluster_id", 2),)),
        Stage("prototypes", exposure, ("features", "clusters")),
        Stage("graph", graph, ("features",)),
        Stage("nodes", nodes, ("graph",), (mean_above("degree", 1),)),
        Stage("result", result, ("clusters", "prototypes", "nodes")),
    ]


def research_report(snapshot: DataFrame, labels: DataFrame, nodes: DataFrame, id_col: str, group: str, fields: Sequence[str], styles: Sequence[str], key_columns: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of a research report. Rows without a cluster have -1 and count as unclustered; clusters go by their actual ids."""
    x = snapshot.drop("cluster_id").join(labels.select(id_col, "cluster_id"), id_col, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    inside = x.where("cluster_id >= 0")
    return {
        "summary": x.agg(F.count("*").alias("n_rows"), F.count_if(F.col("cluster_id") < 0).alias("n_unclustered"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters")),
        "clusters": inside.groupBy("cluster_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in fields]).join(reports.mode_by(inside, "cluster_id", group), "cluster_id", "left"),
        "groups": reports.group_profile(x, group, fields),
        "styles": inside.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in styles]),
        "graph": nodes.agg(F.avg("degree").alias("avg_degree"), F.median("degree").alias("median_degree"), F.avg("pagerank").alias("avg_pagerank"), F.count_if(F.col("degree") == 0).alias("isolated")),
        "missing": reports.column_quality(x, key_columns),
        "agreement": clusters.nmi(inside, "cluster_id", group).join(clusters.purity(inside, "cluster_id", group)),
    }
