"""Node and graph metrics over symmetric edge tables (src, dst, weight) with a node table that holds isolated nodes too.

Iterations cut their lineage by tables in the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotSettled
from ..sources.shared import cut, tidied
from .numbering import numbered_ids


def degrees(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """id, degree (neighbours), weighted_degree; isolated nodes have 0."""
    d = edges.groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))
    return nodes.select(id_col).join(d, F.col(id_col) == F.col("src"), "left").select(id_col, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))


@tidied
def connected_components(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """id, component (its least id), size: least labels flow along edges, and labels of labels are followed each round, so rounds grow with the logarithm of path lengths."""
    label = nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("label"))
    while True:
        seen = edges.select("src", "dst").join(label, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("m"))
        new = label.join(seen, F.col("id") == F.col("src"), "left").select("id", "label", F.least("label", "m").alias("m"))
        up = new.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        new = cut(new.join(up, "m").select("id", "label", F.least("m", "mm").alias("new")))
        changed = new.where("new <> label").limit(1).count()
        label = new.select("id", F.col("new").alias("label"))
        if not changed:
            break
    return label.select(F.col("id").alias(id_col), F.col("label").alias("component"), F.count("*").over(Window.partitionBy("label")).alias("size"))


#: Edges and nodes of a graph that one task ranks by itself, at most; larger ones go by joins.
PIECE = 250_000


def _in_one_task(rows: DataFrame, kernel: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """id, x: what ``kernel`` makes of the columns of all rows (src, dst and others), in the order of src and dst."""

    def run(t: pa.Table) -> pa.Table:
        t = t.drop_columns(["piece"]).sort_by([("src", "ascending"), ("dst", "ascending")])
        ids, x = kernel(*(c.to_numpy() for c in t.columns))
        return pa.table([pa.array(ids, t.schema.field("src").type), pa.array(x, pa.float64())], names=["id", "x"])

    kind = dict(rows.dtypes)["src"]
    return rows.where("src is not null and dst is not null").withColumn("piece", F.lit(0)).groupBy("piece").applyInArrow(run, f"id {kind}, x double")


def _rank_step(share: DataFrame, every: DataFrame, rank: DataFrame, alpha: float, n: int) -> DataFrame:
    """One round; the ranks enter its plan once, as nodes without incoming edges come from the node table."""
    moved = share.join(rank, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), (F.col("p") * F.col("r")).alias("m"))
    return moved.unionByName(every).groupBy("id").agg((F.lit((1 - alpha) / max(n, 1)) + F.lit(alpha) * F.sum("m")).alias("r"))


@tidied
def pagerank(edges: DataFrame, nodes: DataFrame, id_col: str, alpha: float = 0.85, rounds: int = 100, tol: float = 1e-6, normalize: bool = False, check_every: int = 5) -> DataFrame:
    """id, pagerank: power iteration with weights as transition shares and no redistribution from nodes without edges, until the L1 change is under ``tol`` (looked at every few rounds); ``tol`` 0 asks for just ``rounds`` rounds. Raises if the rounds don't suffice."""
    n = nodes.count()
    share = edges.join(edges.groupBy("src").agg(F.sum("weight").alias("_s")), "src").select("src", "dst", (F.col("weight") / F.nullif(F.col("_s"), F.lit(0.0))).alias("p"))
    share = cut(share)
    if n and n + share.count() <= PIECE:
        one = nodes.select(F.col(id_col).alias("src"), F.col(id_col).alias("dst"), F.lit(0.0).alias("p"), F.lit(True).alias("own"))
        rows = one.unionByName(share.select(F.col("src").cast(dict(one.dtypes)["src"]).alias("src"), F.col("dst").cast(dict(one.dtypes)["src"]).alias("dst"), F.coalesce("p", F.lit(0.0)).alias("p"), F.lit(False).alias("own")))
        rank = cut(_in_one_task(rows, lambda *e: ranked(*e, alpha, rounds, tol, check_every)).withColumnRenamed("x", "r"))
        if rank.where("isnan(r)").limit(1).count():
            raise NotSettled(f"pagerank changes by {tol} or more after {rounds} rounds")
        return _shares(rank, id_col, normalize)
    every = nodes.select(F.col(id_col).alias("id"), F.lit(0.0).alias("m"))
    rank = nodes.select(F.col(id_col).alias("id"), F.lit(1.0 / max(n, 1)).alias("r"))
    for i in range(1, rounds + 1):
        if i % check_every and i != rounds:
            rank = _rank_step(share, every, rank, alpha, n)
        else:
            old = cut(rank)
            rank = cut(_rank_step(share, every, old, alpha, n))
            if tol > 0 and (rank.join(old.withColumnRenamed("r", "old"), "id").agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0) < tol:
                break
    else:
        if tol > 0 and n:
            raise NotSettled(f"pagerank changes by {tol} or more after {rounds} rounds")
    return _shares(rank, id_col, normalize)


def _shares(rank: DataFrame, id_col: str, normalize: bool) -> DataFrame:
    """id, pagerank, summing to 1 if asked for."""
    if normalize:
        rank = rank.join(F.broadcast(rank.agg(F.sum("r").alias("_s")))).select("id", (F.col("r") / F.nullif(F.col("_s"), F.lit(0.0))).alias("r"))
    return rank.select(F.col("id").alias(id_col), F.col("r").alias("pagerank"))


def ranked(src: np.ndarray, dst: np.ndarray, p: np.ndarray, own: np.ndarray, alpha: float, rounds: int, tol: float, check_every: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes (of the rows ``own``) and their ranks as ``pagerank`` has them, NaN if ``rounds`` don't suffice."""
    own = own.astype(bool)
    nodes = np.unique(src[own])
    i, j = (np.minimum(np.searchsorted(nodes, x[~own]), len(nodes) - 1) for x in (src, dst))
    here = (nodes[i] == src[~own]) & (nodes[j] == dst[~own])
    i, j, p = i[here], j[here], p[~own][here]
    rank = np.full(len(nodes), 1.0 / len(nodes))
    for r in range(1, rounds + 1):
        old, rank = rank, (1 - alpha) / len(nodes) + alpha * np.bincount(j, p * rank[i], len(nodes))
        if tol > 0 and (not r % check_every or r == rounds) and np.abs(rank - old).sum() < tol:
            return nodes, rank
    return nodes, rank if tol <= 0 else np.full(len(nodes), np.nan)


#: Products of a cycle that seeks the greatest eigenvector, and vectors that it hands to the next one.
CYCLE, HANDED = 14, 4


def _products(shifted: DataFrame, x: DataFrame, take: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """id, the columns ``keep`` as they are and, for each of ``take``, its product with A + I as ``_<name>``; ``own`` marks the rows of I."""
    near = shifted.join(x, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("key"))
    kept = [F.sum(F.when(F.col("own"), F.col(c))).alias(c) for c in keep]
    return near.agg(*kept, *[F.sum(F.col("weight") * F.col(c)).alias(f"_{c}") for c in take]).withColumnRenamed("key", "id")


def _gram(x: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The sums of products of all pairs of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.stack([c.to_numpy() for c in b.columns]) if b.num_rows else np.zeros((len(columns), 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[0] ** 2)), pa.array((m @ m.T).ravel())], ["i", "v"])

    out = np.zeros(len(columns) ** 2)
    for r in x.select(*columns).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(len(columns), -1)


def _greatest(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and coefficients, the greatest first, of what comes nearest to eigenvectors in the span of vectors with inner products ``g``, and ``h`` with their images."""
    size = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    e, v = np.linalg.eigh(g * size[:, None] * size[None, :])
    v = v[:, e > 1e-12 * e[-1]] / np.sqrt(e[e > 1e-12 * e[-1]])
    v = size[:, None] * v
    value, c = np.linalg.eigh(v.T @ (h + h.T) @ v / 2)
    return value[::-1], (v @ c)[:, ::-1]


def _images(m: int, products: int, half: float) -> np.ndarray:
    """How the images of ``m`` vectors and of their chain, whose last one is left out, are made of the vectors, the chain and the first ones' images."""
    held, to = m + products, np.zeros((m + products + 1 + m, m + products))
    for i in range(held):
        if i < m:
            to[held + 1 + i, i] = 1.0
        else:
            to[i, i] = 1.0
            to[i + 1, i] = half if i == m else half / 2
            if i > m:
                to[i - 1, i] = half / 2
    return to


@tidied
def eigenvector_centrality(edges: DataFrame, nodes: DataFrame, id_col: str, rounds: int = 2000, tol: float = 1e-6, check_every: int = 10) -> DataFrame:
    """id, eigenvector: the eigenvector of the greatest eigenvalue of A + I (so that there is one on bipartite graphs as well), summing to 1, to where one more product changes it by under ``tol`` (L1).

    Cycles of products, each from the best vectors that the one before found in the span of its own (a restarted Lanczos
    method); the driver sees the sums of products of their columns. ``tol`` 0 asks for just ``rounds`` products with the vector itself
    (power iteration, written every few rounds). Raises if ``rounds`` products don't suffice.
    """
    x = nodes.select(F.col(id_col).alias("id"), F.lit(1.0).alias("x"))
    one = nodes.select(F.col(id_col).alias("src"), F.col(id_col).alias("dst"), F.lit(1.0).alias("weight"), F.lit(True).alias("own"))
    shifted = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), F.lit(False).alias("own")).unionByName(one))
    whole = lambda x: x.join(F.broadcast(x.agg(F.sum("x").alias("_s")))).select("id", (F.col("x") / F.col("_s")).alias("x"))
    if tol > 0:
        return _settled_eigenvector(shifted, x, rounds, tol).select(F.col("id").alias(id_col), F.col("x").alias("eigenvector"))
    step = lambda x: _products(shifted, x, ["x"], []).withColumnRenamed("_x", "x")
    for i in range(1, rounds + 1):
        x = step(x)
        if i % check_every == 0 or i == rounds:
            x = cut(whole(cut(x)))
    return x.select(F.col("id").alias(id_col), F.col("x").alias("eigenvector"))


def _settled_eigenvector(shifted: DataFrame, x: DataFrame, rounds: int, tol: float) -> DataFrame:
    """id, x: see ``eigenvector_centrality``."""
    n, used, state, values = x.count(), 0, x.select("id", F.col("x").alias("u0")), [None]
    size, first = shifted.agg(F.count("*"), F.sum("weight")).first()
    if 0 < size <= PIECE:
        found = cut(_in_one_task(shifted.select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight")), lambda *e: principal(*e, rounds, tol)))
        if found.where("isnan(x)").limit(1).count():
            raise NotSettled(f"eigenvector centrality changes by {tol} or more after {rounds} rounds")
        return found
    while True:
        if used >= rounds:
            raise NotSettled(f"eigenvector centrality changes by {tol} or more after {rounds} rounds")
        u = [f"u{i}" for i in range(len(values))]
        # u0 is the vector itself, ``c`` is it without the rounding errors below zero
        x = state.withColumn("c", F.greatest("u0", F.lit(0.0)))
        x = cut(_products(shifted, x, [*u, "c"], [*u, "c"]))
        used += 1
        was, now = x.agg(F.sum("c"), F.sum("_c")).first()
        if not n or x.agg(F.sum(F.abs(F.col("_c") / now - F.col("c") / was))).first()[0] < tol:
            return x.select("id", (F.col("_c") / (now or 1.0)).alias("x"))
        # what is left of u0's product begins a chain of Chebyshev polynomials, whose vectors stay apart from each other
        top = first / n if values[0] is None else values[0]
        half = max(abs(top - 1.0), 1e-9)
        chain, products = ["w0"], min(CYCLE, rounds - used)
        w = x.select("id", (F.col("_u0") - top * F.col("u0")).alias("w0"))
        for i in range(products):
            w = _products(shifted, w, chain[-1:], chain)
            image = (F.col(f"_{chain[-1]}") - F.col(chain[-1])) / half
            w = w.withColumn(f"w{i + 1}", image if not i else 2 * image - F.col(chain[-2])).drop(f"_{chain[-1]}")
            chain.append(f"w{i + 1}")
        used += products
        x = cut(x.select("id", *u, *[f"_{c}" for c in u]).join(w, "id"))
        held, every = [*u, *chain[:-1]], [*u, *chain, *[f"_{c}" for c in u]]
        gram = _gram(x, every)
        to = _images(len(u), products, half)
        values, found = _greatest(gram[: len(held), : len(held)], gram[: len(held)] @ to)
        values, found = values[:HANDED], found[:, :HANDED]
        mixed = lambda f: sum((F.col(c) * float(a) for c, a in zip(held, f)), F.lit(0.0))
        if (x.agg(F.sum(mixed(found[:, 0]))).first()[0] or 0.0) < 0:
            found[:, 0] *= -1
        state = x.select("id", *[mixed(found[:, i]).alias(f"u{i}") for i in range(found.shape[1])])


def principal(src: np.ndarray, dst: np.ndarray, w: np.ndarray, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of ``src`` and what ``_settled_eigenvector`` finds for them, NaN if ``rounds`` products don't suffice."""
    nodes = np.unique(src)
    j = np.minimum(np.searchsorted(nodes, dst), len(nodes) - 1)
    here = nodes[j] == dst
    i, j, w = np.searchsorted(nodes, src[here]), j[here], w[here]
    product = lambda x: np.bincount(i, w * x[j], len(nodes))
    used, u, top = 0, np.ones((1, len(nodes))), w.sum() / len(nodes)
    while used < rounds:
        c = np.maximum(u[0], 0.0)
        now = product(c)
        images, used = np.stack([product(x) for x in u]), used + 1
        if np.abs(now / now.sum() - c / c.sum()).sum() < tol:
            return nodes, now / now.sum()
        half, products = max(abs(top - 1.0), 1e-9), min(CYCLE, rounds - used)
        chain = [images[0] - top * u[0]]
        for step in range(products):
            image = (product(chain[-1]) - chain[-1]) / half
            chain.append(image if not step else 2 * image - chain[-2])
        used += products
        every = np.concatenate([u, chain, images])
        held = len(u) + products
        gram = every @ every.T
        values, found = _greatest(gram[:held, :held], gram[:held] @ _images(len(u), products, half))
        top, u = values[0], found[:, :HANDED].T @ every[:held]
        u[0] *= np.sign(u[0].sum()) or 1.0
    return nodes, np.full(len(nodes), np.nan)


def node_stats(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """id, degree, weighted_degree, pagerank (summing to 1) and component with its size."""
    return degrees(edges, nodes, id_col).join(pagerank(edges, nodes, id_col, normalize=True), id_col).join(connected_components(edges, nodes, id_col), id_col)


def clustering_coefficient(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """id, degree, triangles, clustering: each triangle is found once, from its lowest-ordered end (fewest neighbours first), which bounds the pairs a hub forms."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    d = e.groupBy("src").agg(F.count("*").alias("n"))
    o = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst").where("n < m or (n = m and src < dst)").select("src", "dst")
    pairs = o.alias("a").join(o.alias("b"), "src").where("a.dst < b.dst").select(F.col("src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    known = o.select(F.least("src", "dst").alias("y"), F.greatest("src", "dst").alias("z"))
    t = pairs.join(known, ["y", "z"]).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    out = nodes.select(F.col(id_col).alias("id")).join(d, F.col("id") == F.col("src"), "left").drop("src").join(t, "id", "left")
    k, tri = F.coalesce("n", F.lit(0)), F.coalesce("t", F.lit(0))
    return out.select(F.col("id").alias(id_col), k.cast("long").alias("degree"), tri.cast("long").alias("triangles"), F.when(k < 2, 0.0).otherwise(2 * tri / (k * (k - 1))).alias("clustering"))


#: Neighbours beyond which a node's are counted by value and not brought together.
HUB = 1_000_000


def h_index(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of ``values`` (runs begin at ``first``, none is empty) the greatest m of which m values are at least m."""
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
    values = values[np.lexsort((-values, run))]
    return np.maximum.reduceat(np.minimum(values, np.arange(1, len(values) + 1) - first[run]), first)


def settled(src: np.ndarray, dst: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of ``src`` (in order) and their h-indices, taken again and again while the values of nodes elsewhere stay as they are.

    Only nodes next to one whose value fell are looked at again.
    """
    nodes, first = np.unique(src, return_index=True)
    size = np.diff(np.append(first, len(src)))
    of = np.repeat(np.arange(len(nodes)), size)
    at = np.minimum(np.searchsorted(nodes, dst), len(nodes) - 1)
    here = np.flatnonzero(nodes[at] == dst)
    back = here[np.argsort(at[here], kind="stable")]
    bounds = np.searchsorted(at[back], np.arange(len(nodes) + 1))
    value, now, todo = h.copy(), np.full(len(nodes), np.iinfo(np.int64).max), np.arange(len(nodes))

    def ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())

    while len(todo):
        n = size[todo]
        new = h_index(value[ranges(first[todo], n)], np.append(0, np.cumsum(n)[:-1]))
        fell = todo[new < now[todo]]
        now[todo] = np.minimum(now[todo], new)
        edges = back[ranges(bounds[fell], bounds[fell + 1] - bounds[fell])]
        value[edges] = now[at[edges]]
        todo = np.unique(of[edges])
    return nodes, now


@tidied
def core_numbers(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """id, core: the h-index of the neighbours' values, taken again and again from the degrees, settles on core numbers.

    A task settles a range of nodes by itself, looking only at neighbours of what fell, so rounds over the whole graph
    grow with the ranges a change has to cross and not with the length of paths. Nodes with more than ``HUB``
    neighbours have them counted by value instead.
    """
    names = numbered_ids(nodes, id_col)
    a, b = (names.select(F.col("id").alias(end), F.col("no").alias(f"_{end}")) for end in ("src", "dst"))
    e = edges.where("src <> dst").join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    e = cut(e.distinct())
    degree = cut(e.groupBy("src").agg(F.count("*").alias("h")))
    hubs = degree.where(F.col("h") > HUB).select("src")
    few, many = e.join(hubs, "src", "left_anti"), e.join(hubs, "src")
    h = degree.select(F.col("src").alias("id"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            ids, now = settled(*(t.column(c).to_numpy() for c in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(now)], ["id", "new"])

    while True:
        near = lambda x: x.join(h.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "h")  # noqa: E731, B023
        local = near(few).repartitionByRange("src").sortWithinPartitions("src").mapInArrow(run, "id long, new long")
        counts = near(many).groupBy("src", "h").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("h")))
        counted = counts.withColumn("m", F.least("h", upto)).groupBy(F.col("src").alias("id")).agg(F.max("m").alias("new"))
        new = cut(local.unionByName(counted).join(h, "id").select("id", F.least("new", "h").alias("new"), "h"))
        changed = new.where("new < h").limit(1).count()
        h = new.select("id", F.col("new").alias("h"))
        if not changed:
            break
    out = names.join(h.withColumnRenamed("id", "no"), "no", "left")
    return nodes.select(id_col).join(out.select(F.col("id").alias(id_col), "h"), id_col, "left").select(id_col, F.coalesce("h", F.lit(0)).cast("long").alias("core"))


def neighbour_means(edges: DataFrame, nodes: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """id and, for each column, the unweighted mean over neighbours that have a value; 0 without any."""
    v = nodes.select(F.col(id_col).alias("dst"), *columns)
    near = edges.join(v, "dst").groupBy("src").agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return nodes.select(id_col).join(near, F.col(id_col) == F.col("src"), "left").select(id_col, *[F.coalesce(f"_{c}", F.lit(0.0)).alias(f"neighbour_{c}") for c in columns])


def neighbour_agreement(edges: DataFrame, nodes: DataFrame, id_col: str, label: str, differ: bool = False, name: str = "agreement") -> DataFrame:
    """Share of neighbours with the same label (or, as a bridge score, with another one); 0 without neighbours."""
    a = nodes.select(F.col(id_col).alias("src"), F.col(label).alias("_a"))
    b = nodes.select(F.col(id_col).alias("dst"), F.col(label).alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    near = edges.join(a, "src").join(b, "dst").groupBy("src").agg(F.avg((~same if differ else same).cast("double")).alias("_s"))
    return nodes.select(id_col).join(near, F.col(id_col) == F.col("src"), "left").select(id_col, F.coalesce("_s", F.lit(0.0)).alias(name))


def neighbour_dispersion(edges: DataFrame, nodes: DataFrame, id_col: str, columns: Sequence[str], name: str = "dispersion") -> DataFrame:
    """Mean distance of the neighbours' rows of ``columns`` to their mean; 0 with fewer than two neighbours."""
    v = nodes.select(F.col(id_col).alias("dst"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    x = edges.select("src", "dst").join(v, "dst")
    w = Window.partitionBy("src")
    gaps = [F.pow(F.col(c) - F.avg(c).over(w), 2) for c in columns]
    total = gaps[0]
    for g in gaps[1:]:
        total = total + g
    s = x.select("src", F.sqrt(total).alias("_d")).groupBy("src").agg(F.avg("_d").alias("_m"), F.count("*").alias("_n"))
    return nodes.select(id_col).join(s, F.col(id_col) == F.col("src"), "left").select(id_col, F.when(F.col("_n") >= 2, F.col("_m")).otherwise(0.0).alias(name))


def conductance(edges: DataFrame, nodes: DataFrame, id_col: str, label: str) -> DataFrame:
    """label, internal, external, conductance = external / (internal + external) by weight of edge ends; NULL without edges."""
    a = nodes.select(F.col(id_col).alias("src"), F.col(label).alias("_a"))
    b = nodes.select(F.col(id_col).alias("dst"), F.col(label).alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    s = edges.join(a, "src").join(b, "dst").groupBy("_a").agg(F.sum(F.when(same, F.col("weight")).otherwise(0.0)).alias("internal"), F.sum(F.when(same, 0.0).otherwise(F.col("weight"))).alias("external"))
    every = nodes.select(F.col(label).alias("_l")).distinct().join(s, F.col("_l").eqNullSafe(F.col("_a")), "left")
    i, e = F.coalesce("internal", F.lit(0.0)), F.coalesce("external", F.lit(0.0))
    return every.select(F.col("_l").alias(label), i.alias("internal"), e.alias("external"), (e / F.nullif(i + e, F.lit(0.0))).alias("conductance"))


@tidied
def betweenness(edges: DataFrame, nodes: DataFrame, id_col: str, sources: int = 200, roots: DataFrame | None = None) -> DataFrame:
    """id, betweenness: shortest-path shares from the ids in ``roots``, or else from the ``sources`` nodes of least id hash, scaled to all sources, unweighted.

    Breadth-first rounds over the edge table hold (source, node, distance, paths); shares flow back level by level.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct())
    n = nodes.count()
    roots = nodes.select(F.col(id_col).alias("root")).orderBy(F.xxhash64("root"), "root").limit(sources) if roots is None else roots.select(F.col(id_col).alias("root"))
    used = roots.count()
    level = cut(roots.select("root", F.col("root").alias("id"), F.lit(1.0).alias("paths")))
    seen = level.select("root", "id")
    levels = [level]
    while True:
        step = level.join(e, F.col("id") == F.col("src")).groupBy("root", "dst").agg(F.sum("paths").alias("paths")).withColumnRenamed("dst", "id")
        level = cut(step.join(seen, ["root", "id"], "left_anti"))
        if not level.limit(1).count():
            break
        seen = cut(seen.unionByName(level.select("root", "id")))
        levels.append(level)
    total = None
    share = levels[-1].select("root", "id", "paths", F.lit(0.0).alias("s"))
    for upper in reversed(levels[:-1]):
        down = upper.select("root", F.col("id").alias("src"), F.col("paths").alias("p")).join(e, "src")
        part = down.join(share.select("root", F.col("id").alias("dst"), "paths", "s"), ["root", "dst"]).groupBy("root", "src").agg(F.sum(F.col("p") / F.col("paths") * (1 + F.col("s"))).alias("s"))
        got = cut(upper.join(part.withColumnRenamed("src", "id"), ["root", "id"], "left").select("root", "id", "paths", F.coalesce("s", F.lit(0.0)).alias("s")))
        inner = got.where("root <> id").select("id", "s")
        total = inner if total is None else total.unionByName(inner)
        share = got
    scale = (n / used) / ((n - 1) * (n - 2)) if n > 2 and used else 0.0
    base = nodes.select(F.col(id_col).alias("id"))
    if total is None:
        return base.select(F.col("id").alias(id_col), F.lit(0.0).alias("betweenness"))
    return base.join(total.groupBy("id").agg(F.sum("s").alias("s")), "id", "left").select(F.col("id").alias(id_col), (F.coalesce("s", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))


def node_metrics(edges: DataFrame, nodes: DataFrame, id_col: str, label: str, group: str, values: Sequence[str], styles: Sequence[str]) -> DataFrame:
    """All node metrics in one table."""
    parts = [
        degrees(edges, nodes, id_col),
        pagerank(edges, nodes, id_col, normalize=True),
        eigenvector_centrality(edges, nodes, id_col),
        clustering_coefficient(edges, nodes, id_col).drop("degree"),
        core_numbers(edges, nodes, id_col),
        neighbour_means(edges, nodes, id_col, values),
        neighbour_agreement(edges, nodes, id_col, label, differ=True, name="bridge_score"),
        neighbour_agreement(edges, nodes, id_col, label, name="cluster_agreement"),
        neighbour_agreement(edges, nodes, id_col, group, name="group_agreement"),
        neighbour_dispersion(edges, nodes, id_col, styles, name="style_dispersion"),
    ]
    out = nodes.select(id_col, F.col(label).alias("community_id"), F.count("*").over(Window.partitionBy(label)).alias("community_size"))
    for p in parts:
        out = out.join(p, id_col, "left")
    return out
