"""Density clusters: a spanning forest by rounds of least edges, its tree of merges, and the leaves of that tree.

1. Each round every part of the graph takes the least edge that leaves it (edges are ordered by weight and ends, so no
   two are equal), parts that are linked that way become one, and of the edges between two parts the least stays. Parts
   at least halve, so rounds grow with the logarithm of the nodes.
2. The forest's edges, from the least on, merge parts. A part below ``min_size`` carries its points; a greater one only
   whether it has grown around one seed (the merge that made it great enough) or around several. Points get their
   cluster, and the weight at which they join it, when their part becomes great enough: with one seed they belong to
   it, with several to none. Edges are taken in pieces of bounded size, a task each; between two pieces the ends of what
   is left are renamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, iteration
from .neighbours import nearest
from .numbering import numbered, numbered_ids

#: Edges that one task merges at once.
PIECE = 1_000_000
#: The seed of a part with several.
SEVERAL = -1


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, w: the least spanning forest of undirected edges (a, b: long, w), a < b; of equal weights the lesser ends come first."""
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a <> b and w is not null")
    one = ends.groupBy("a", "b").agg(F.min("w").alias("w"))
    live = cut(one.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("e")))
    forest = []
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("y").alias("x"), F.col("x").alias("y"), "e"))
        # each part points at the part across its least edge; two that point at each other are a root, named by the lesser
        points = cut(both.groupBy("x").agg(F.min(F.struct("e", "y")).alias("m")).select("x", F.col("m.y").alias("y"), "m.e"))
        forest.append(points.select("e.a", "e.b", "e.w").distinct())
        back = points.select(F.col("x").alias("y"), F.col("y").alias("z"))
        root = (F.col("z") == F.col("x")) & (F.col("x") < F.col("y"))
        up = cut(points.select("x", "y").join(back, "y").select("x", F.when(root, F.col("x")).otherwise(F.col("y")).alias("up")))
        moved = 1
        while moved:
            above = up.select(F.col("x").alias("up"), F.col("up").alias("top"))
            jumped = cut(up.join(above, "up").select("x", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            up = jumped.select("x", "up")
        a, b = up.select("x", F.col("up").alias("p")), up.select(F.col("x").alias("y"), F.col("up").alias("q"))
        between = live.join(a, "x").join(b, "y").where("p <> q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "e")
        live = cut(between.groupBy("x", "y").agg(F.min("e").alias("e")))
    if not forest:
        return one.limit(0)
    out = forest[0]
    for f in forest[1:]:
        out = out.unionByName(f)
    return cut(out)


class Merges:
    """Parts of a graph while its edges are merged in order. ``size``, ``points`` (of small parts) and ``seed`` are by a part's name."""

    def __init__(self, min_size: int):
        self.min_size = min_size
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.points: dict[int, list[int]] = {}
        self.seed: dict[int, int] = {}

    def begin(self, x: int, size: int = 1, points: list[int] | None = None, seed: int | None = None) -> None:
        self.parent[x], self.size[x] = x, size
        if seed is None:
            self.points[x] = points or [x]
        else:
            self.seed[x] = seed

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def merge(self, x: int, y: int, number: int, w: float) -> Iterator[tuple[int, int, float]]:
        """(point, seed, weight) of the points that join a seed's cluster by this edge; ``number`` names the seed that it may be."""
        x, y = self.find(x), self.find(y)
        if self.size[x] < self.size[y] or (self.size[x] == self.size[y] and y < x):
            x, y = y, x
        great = [p in self.seed for p in (x, y)]
        self.parent[y] = x
        self.size[x] = min(self.size[x] + self.size.pop(y), 1 << 62)
        if all(great):
            self.seed.pop(y)
            self.seed[x] = SEVERAL
            return
        joining = self.points.pop(y)
        if not great[0]:
            joining = self.points.pop(x) + joining
            if len(joining) < self.min_size:
                self.points[x] = joining
                return
            self.seed[x] = number
        if self.seed[x] != SEVERAL:
            for p in joining:
                yield p, self.seed[x], w


ROWS = "kind int, number long, x long, y long, w double, size long, points array<long>, seed long"


def joined_points(forest: DataFrame, min_size: int, piece: int = PIECE) -> DataFrame:
    """point, seed, w: the points of a forest that belong to a seed, and the weight at which they join it."""
    n = forest.count()
    rest = numbered(forest.select(F.col("a").alias("x"), F.col("b").alias("y"), "w"), ["w", "x", "y"], "number", 0)
    rest = cut(rest.withColumn("piece", F.expr(f"number div {piece}")))
    parts = forest.sparkSession.createDataFrame([], "x long, size long, points array<long>, seed long")
    found = []

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Merges(min_size)
        out: list[tuple] = []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [f.split()[0] for f in ROWS.split(", ")])

        for batch in batches:
            for kind, number, x, y, w, size, points, seed in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    m.begin(x, size, points, seed)
                    continue
                for end in (x, y):
                    if end not in m.parent:
                        m.begin(end)
                out += [(2, None, p, None, weight, None, None, s) for p, s, weight in m.merge(x, y, number, w)]
                if len(out) > 50_000:
                    yield rows(out)
                    out = []
        # new names, and the parts that bear them
        out += [(3, None, x, m.find(x), None, None, None, None) for x in m.parent]
        out += [(4, None, x, None, None, s, m.points.get(x), m.seed.get(x)) for x, s in m.size.items()]
        for low in range(0, len(out), 50_000):
            yield rows(out[low : low + 50_000])

    none = lambda kind: F.lit(None).cast(kind)
    for i in range(-(-n // piece)):
        now = rest.where(F.col("piece") == i)
        ends = now.select("x").unionByName(now.select(F.col("y").alias("x"))).distinct()
        known = parts.join(ends, "x", "left_semi").select(F.lit(0).alias("kind"), none("long").alias("number"), "x", none("long").alias("y"), none("double").alias("w"), "size", "points", "seed")
        edges = now.select(F.lit(1).alias("kind"), "number", "x", "y", "w", none("long").alias("size"), none("array<long>").alias("points"), none("long").alias("seed"))
        # at most PIECE edges and the parts at their ends
        done = cut(known.unionByName(edges).repartition(1).sortWithinPartitions("kind", "number").mapInArrow(merged, ROWS))
        found.append(done.where("kind = 2").select(F.col("x").alias("point"), "seed", "w"))
        if (i + 1) * piece < n:
            names = done.where("kind = 3").select("x", F.col("y").alias("to"))
            later = rest.where(F.col("piece") > i).join(names, "x", "left").select(F.coalesce("to", "x").alias("x"), "y", "w", "number", "piece")
            later = later.join(names.withColumnRenamed("x", "y"), "y", "left").select("x", F.coalesce("to", "y").alias("y"), "w", "number", "piece")
            rest = cut(later)
            parts = cut(parts.join(names, "x", "left_anti").unionByName(done.where("kind = 4").select("x", "size", "points", "seed")))
    if not found:
        return forest.sparkSession.createDataFrame([], "point long, seed long, w double")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def reachability(near: DataFrame, min_size: int) -> DataFrame:
    """a, b, w of neighbours (src, dst, d, rank): the greatest of their distance and of both ends' distances to their ``min_size``-th neighbour, or the last there is."""
    core = near.where(F.col("rank") <= min_size).groupBy("src").agg(F.max("d").alias("core"))
    e = near.join(core, "src").join(core.select(F.col("src").alias("dst"), F.col("core").alias("c2")), "dst")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.greatest("d", "core", "c2").alias("w"))


def density_clusters(vectors: DataFrame, id_col: str, vector_col: str, min_size: int = 5, k: int | None = None, piece: int = PIECE) -> DataFrame:
    """id, cluster_id, probability: leaf clusters of the tree of merges over the mutual-reachability graph; noise is -1 with probability 0.

    The graph has each vector's ``k`` (by default ``min_size``, 15 at least) nearest others; an edge weighs the greatest of
    its distance and its ends' distances to their ``min_size``-th neighbour. Clusters are numbered by their least id. A
    probability is the weight at which the cluster began over the weight at which the point joined it, 1 for the first.
    A tree that never splits is no cluster, unless there are others beside it. Vectors that are NULL are noise.
    """
    with iteration(vectors.sparkSession) as kept:
        ids = numbered_ids(vectors, id_col)
        v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).join(ids, "id").select("no", "v")
        near = cut(nearest(v, "no", "v", k or max(min_size, 15), "l2").select("src", "dst", (-F.col("weight")).alias("d"), "rank"))
        forest = spanning_forest(reachability(near, min_size))
        points = cut(joined_points(forest, min_size, piece))
        seeds = points.groupBy("seed").agg(F.min("point").alias("first"), F.min("w").alias("began"))
        clusters = cut(numbered(seeds, ["first"], "cluster_id", 0))
        if clusters.count() < 2:
            clusters = clusters.limit(0)
        strength = F.when(F.col("w") == 0, 1.0).otherwise(F.col("began") / F.col("w"))
        of = points.join(clusters, "seed").select(F.col("point").alias("no"), F.col("cluster_id").cast("int").alias("cluster_id"), strength.alias("probability"))
        out = ids.join(of, "no", "left")
        return kept(out.select(F.col("id").alias(id_col), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("probability", F.lit(0.0)).alias("probability")))
