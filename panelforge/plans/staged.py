"""The staged job of one date: snapshot, styles, price features, vectors, graphs, fusion, clusters, metrics, report, chart data.

Each stage is a table of its own, checked and stored; a run can resume or begin at any stage. Thresholds are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..operators import alignment, clusters, graphs, metrics, reports
from ..operators import crosssection as cs
from ..operators import timeseries as ts
from .research import research_report
from .stages import Stage, at_least_rows, distinct_at_least, has_columns, least_at_least, mean_above, mean_sum_above, never_null, null_share_below, unit_length, values_of

#: Weights of the graph layers, and columns that stand in for missing vectors.
LAYER_WEIGHTS = {"semantic": 0.35, "industry": 0.20, "fundamental": 0.20, "return_corr": 0.15, "style": 0.10}
STAND_INS = ["close", "pct_chg", "turnover_rate", "pe_ttm", "roe", "total_mv"]


@dataclass(frozen=True)
class StagedJob:
    """Inputs and parameters. ``snapshot`` has one row a key for the date, ``bars`` the series up to it, ``views`` vectors by key."""

    snapshot: DataFrame
    bars: DataFrame
    views: Mapping[str, DataFrame] = field(default_factory=dict)
    key: str = "ts_code"
    at: str = "trade_date"
    levels: Sequence[str] = ("l1_name", "l2_name", "l3_name")
    styles: Mapping[str, list[str]] = field(default_factory=lambda: cs.STYLES)
    #: The styles that must be there, the order in which views are taken, the figures of a graph layer.
    critical: Sequence[str] = ("Size", "Value", "Volatility", "Leverage")
    preference: Sequence[str] = ("full_text", "profile_text", "product_text", "raw_json")
    figures: Sequence[str] = ("roe", "roa", "roic", "grossprofit_margin", "netprofit_margin", "debt_to_assets", "turnover_rate", "pe_ttm", "pb")
    weights: Mapping[str, float] = field(default_factory=lambda: LAYER_WEIGHTS)
    method: str = "kmeans"
    n_clusters: int | None = None
    k_semantic: int = 30
    k: int = 20
    top: int = 30
    dates: int = 60
    least_rows: int = 4001
    top_nodes: int = 20

    def stages(self) -> list[Stage]:
        key, rows = self.key, at_least_rows(self.least_rows)
        industry = self.levels[0]

        def snapshot(spark, done):
            return self.snapshot

        def styles(spark, done):
            x = cs.style_exposures(done["snapshot"], self.at, industry, dict(self.styles))
            return x.select(key, self.at, *self.styles, *[f"{s}_neutral" for s in self.styles])

        def prices(spark, done):
            return ts.latest_price_features(self.bars, key, self.at)

        def semantic(spark, done):
            x = done["snapshot"].select(key)
            if not self.views:
                return alignment.numeric_vectors(done["snapshot"], [c for c in STAND_INS if c in done["snapshot"].columns]).select(key, "embedding", F.lit(None).cast("string").alias("view"))
            every = None
            for name, v in self.views.items():
                v = v.select(key, "embedding", F.lit(name).alias("view"))
                every = v if every is None else every.unionByName(v)
            x = alignment.first_view(x, every, key, [*self.preference, *[v for v in self.views if v not in self.preference]])
            return x.where("embedding is not null")

        def layers(spark, done):
            snap, out = done["snapshot"], {}
            out["semantic"] = graphs.knn_graph(done["semantic"], key, "embedding", self.k_semantic, 0.0, mutual=True)
            # fixed values: weights and numbers of neighbours of the levels, the narrowest first
            caps = [(level, w, cap) for level, w, cap in zip(reversed(self.levels), (1.0, 0.7, 0.4), (20, 10, 5)) if level in snap.columns]
            out["industry"] = graphs.group_graph(snap, key, caps)
            if len([c for c in self.figures if c in snap.columns]) >= 3:
                out["fundamental"] = graphs.figures_graph(snap, key, self.figures, self.k)
            cells = ts.returns_matrix(self.bars, key, self.at, dates=self.dates)
            out["return_corr"] = graphs.symmetric(graphs.filled_correlation(cells, key, self.at, "ret", self.k))
            neutral = [c for c in done["styles"].columns if c.endswith("_neutral")]
            z = done["styles"].select(key, F.array(*[F.coalesce(c, F.lit(0.0)) for c in neutral]).alias("z"))
            out["style"] = graphs.symmetric(graphs.knn(z, key, "z", self.k, "decay"))
            every = None
            for name, e in out.items():
                e = e.select("src", "dst", "weight", F.lit(name).alias("layer"))
                every = e if every is None else every.unionByName(e)
            return every

        def fusion(spark, done):
            return graphs.fuse(split_layers(done["graphs"]), self.weights, "max", self.top, 1e-6)

        def clustering(spark, done):
            n = self.n_clusters or max(10, done["semantic"].count() // 50)
            if self.method == "kmeans":
                found = clusters.kmeans(done["semantic"], key, "embedding", n)
            elif self.method == "density":
                found = clusters.density_clusters(done["semantic"], key, "embedding").select(key, "cluster_id", F.col("probability").alias("cluster_distance"))
            elif self.method in ("leiden", "louvain"):
                found = clusters.communities(done["fusion"], done["snapshot"].select(key), key, refine=self.method == "leiden")
                found = found.select(key, F.col("community_id").cast("int").alias("cluster_id"), F.lit(0.0).alias("cluster_distance"))
            else:
                raise InvalidValue(f"unknown way to cluster: {self.method}")
            return done["snapshot"].select(key).join(found, key)

        def node_metrics(spark, done):
            neutral = [c for c in done["styles"].columns if c.endswith("_neutral")]
            n = done["snapshot"].select(key, industry).join(done["clustering"].select(key, "cluster_id"), key).join(done["styles"].select(key, *neutral), key)
            return metrics.node_metrics(done["fusion"], n, key, "cluster_id", industry, neutral[:1], neutral)

        def report(spark, done):
            x = done["snapshot"].join(done["clustering"].select(key, "cluster_id"), key)
            fields = [c for c in ("close", "pct_chg", "pe_ttm", "roe") if c in x.columns]
            styles_ = list(self.styles)
            x = x.drop(*styles_).join(done["styles"].select(key, *styles_), key)
            tables = research_report(x, done["clustering"], done["graph_metrics"], key, industry, fields, styles_, [*fields, industry])
            labels = done["clustering"].select(key, "cluster_id")
            tables["modularity"] = clusters.modularity(done["fusion"], labels, key, "cluster_id")
            tables["conductance"] = metrics.conductance(done["fusion"], labels, key, "cluster_id")
            tables["separation"] = clusters.separation(done["semantic"], labels, key, "embedding")
            tables["sizes"] = clusters.cluster_sizes(labels, "cluster_id")
            tables["profile"] = reports.cluster_profile(x, "cluster_id", industry, fields, key, fields[0] if fields else key)
            tables["layers"] = graphs.layer_quality(split_layers(done["graphs"]), done["snapshot"], key)
            n = clusters.cluster_sizes(labels, "cluster_id").select("n_clusters")
            q = clusters.modularity(done["fusion"], labels, key, "cluster_id")
            return reports.as_report(tables).join(F.broadcast(n)).join(F.broadcast(q))

        def charts(spark, done):
            """chart, label, value: the numbers behind the figures."""
            labels = done["clustering"].select(key, "cluster_id")
            parts = [
                labels.groupBy(F.col("cluster_id").cast("string").alias("label")).agg(F.count("*").cast("double").alias("value")).select(F.lit("cluster_size").alias("chart"), "label", "value"),
                reports.histogram(done["graph_metrics"], "degree", 20).select(F.lit("degree").alias("chart"), F.col("low").cast("string").alias("label"), F.col("n").cast("double").alias("value")),
                reports.crosstab(done["snapshot"].join(labels, key), "cluster_id", industry).select(F.lit("industry").alias("chart"), F.concat_ws("|", F.col("cluster_id").cast("string"), industry).alias("label"), F.col("n").cast("double").alias("value")),
                reports.correlations(done["styles"], list(self.styles)).select(F.lit("style_correlation").alias("chart"), F.concat_ws("|", "a", "b").alias("label"), F.col("corr").alias("value")),
                done["graph_metrics"].orderBy(F.desc("pagerank"), key).limit(self.top_nodes).select(F.lit("pagerank").alias("chart"), F.col(key).cast("string").alias("label"), F.col("pagerank").alias("value")),
            ]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        industry_of = {"industry": industry, "key": key, "at": self.at}
        # noise is a label of density clusters only
        labelled = (rows, distinct_at_least("cluster_id", 2), never_null("cluster_id"), least_at_least("cluster_id", -1 if self.method == "density" else 0))
        sources = {"snapshot": self.snapshot}
        series = {"bars": self.bars}
        return [
            Stage("snapshot", snapshot, (), (rows, has_columns(key, self.at, *self.levels[:1]), null_share_below(industry, 0.5)), industry_of, sources),
            Stage("styles", styles, ("snapshot",), (has_columns(*self.critical),), {"styles": dict(self.styles), **industry_of}),
            Stage("price_features", prices, (), (rows,), industry_of, series),
            Stage("semantic", semantic, ("snapshot",), (rows, unit_length("embedding")), {"preference": list(self.preference), "views": list(self.views)}, dict(self.views)),
            Stage("graphs", layers, ("snapshot", "styles", "semantic"), (values_of("layer", "semantic", "industry"), mean_sum_above("weight", "src", 1.0)), {"k": self.k, "k_semantic": self.k_semantic, "dates": self.dates, "figures": list(self.figures), "levels": list(self.levels)}, series),
            Stage("fusion", fusion, ("graphs",), (at_least_rows(1),), {"weights": dict(self.weights), "top": self.top}),
            Stage("clustering", clustering, ("snapshot", "semantic", "fusion"), labelled, {"method": self.method, "n_clusters": self.n_clusters}),
            Stage("graph_metrics", node_metrics, ("snapshot", "styles", "fusion", "clustering"), (has_columns("degree", "pagerank", "clustering", "core"), never_null("degree"), mean_above("degree", 1.0)), industry_of),
            Stage("report", report, ("snapshot", "styles", "semantic", "graphs", "fusion", "clustering", "graph_metrics"), (least_at_least("n_clusters", 2), least_at_least("modularity", 0.0)), {"styles": list(self.styles), **industry_of}),
            Stage("charts", charts, ("snapshot", "styles", "clustering", "graph_metrics"), (at_least_rows(1),), {"top_nodes": self.top_nodes, **industry_of}),
        ]


def split_layers(edges: DataFrame) -> dict[str, DataFrame]:
    """Edges by layer; layers are as few as their names."""
    return {r[0]: edges.where(F.col("layer") == r[0]).drop("layer") for r in edges.select("layer").distinct().orderBy("layer").collect()}


def research_exports(job: StagedJob, done: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that a research run hands out."""
    key = job.key
    labelled = done["snapshot"].join(done["clustering"], key)
    fields = [c for c in ("close", "pct_chg", "pe_ttm", "roe") if c in labelled.columns]
    return {
        "cluster_result": done["clustering"],
        "graph_stats": done["graph_metrics"],
        "cluster_panel": labelled.select(key, job.at, "cluster_id", *job.levels[:1], *fields),
        "cluster_profile": reports.cluster_profile(labelled, "cluster_id", job.levels[0], fields, key, fields[0] if fields else key),
        "style_exposure_panel": done["styles"],
        "stock_snapshot_preview": done["snapshot"].orderBy(key).limit(100),
        "edge_table_fused": graphs.edge_table(done["fusion"], "fused"),
    }
