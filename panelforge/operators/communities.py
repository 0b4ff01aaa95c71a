"""Communities of a weighted graph: Louvain's moves in parallel, with Leiden's refinement if asked for."""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, iteration
from .numbering import numbered, numbered_ids

log = logging.getLogger("panelforge")

#: Gains up to this are none.
LEAST = 1e-9
#: Of how many gaining nodes one moves in a round: at first, and beyond which moves are picked so that none disturbs another.
COLOURS, MOST_COLOURS = 2, 16
#: Edges of a piece of the graph, or of a whole level, that one task settles by itself.
PIECE = 200_000


def _between(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The edges between the labels (and within them) of their ends."""
    a, b = label.select(F.col("id").alias("src"), F.col("label").alias("a")), label.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))


def _inside(edges: DataFrame, label: DataFrame) -> DataFrame:
    """The edges whose ends have one label."""
    a, b = label.select(F.col("id").alias("src"), F.col("label").alias("_a")), label.select(F.col("id").alias("dst"), F.col("label").alias("_b"))
    return edges.join(a, "src").join(b, "dst").where("_a = _b and src <> dst").select("src", "dst", "weight")


def _by_piece(rows: DataFrame, piece: object, kernel: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """id, label: what ``kernel`` makes of the columns of each piece's rows, sorted by the first column."""

    def run(t: pa.Table) -> pa.Table:
        t = t.drop_columns(["piece"])
        t = t.sort_by(t.column_names[0])
        ids, labels = kernel(*(c.to_numpy() for c in t.columns))
        return pa.table([pa.array(ids, pa.int64()), pa.array(labels, pa.int64())], names=["id", "label"])

    return rows.withColumn("piece", piece).groupBy("piece").applyInArrow(run, "id long, label long")


def _neighbours(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
    """The nodes of ``src`` (sorted) and for each the places of the others of them that it is linked with, with weights."""
    nodes, first = np.unique(src, return_index=True)
    at = np.minimum(np.searchsorted(nodes, dst), len(nodes) - 1)
    keep = (nodes[at] == dst) & (src != dst)
    ends = np.searchsorted(src[keep], nodes, side="right").tolist()
    pairs = list(zip(at[keep].tolist(), w[keep].tolist()))
    return nodes, [pairs[a:b] for a, b in zip([0, *ends], ends)]


def parted(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each is connected with."""
    nodes, near = _neighbours(src, dst, w)
    part = [-1] * len(nodes)
    for v in range(len(nodes)):
        if part[v] < 0:
            part[v], todo = v, [v]
            while todo:
                for u, _ in near[todo.pop()]:
                    if part[u] < 0:
                        part[u] = v
                        todo.append(u)
    return nodes, nodes[part]


def _split_by_size(edges: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame | None, object]:
    """src, dst, weight, label inside the labels that a task can hold, with a row of its own for each node; id, label of the others' nodes, if there are any; and the piece of a row."""
    inside = edges.join(label.withColumnRenamed("id", "src"), "src").select("src", "dst", "weight", "label")
    size = cut(inside.groupBy("label").agg(F.count("*").alias("n")))
    most, every = size.agg(F.max("n"), F.sum("n")).first()
    piece = F.pmod(F.xxhash64("label"), F.lit(max(1, -(-(every or 0) // PIECE))))
    rows = inside.unionByName(label.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"), "label"))
    if (most or 0) <= PIECE:
        return rows, None, piece
    large = size.where(F.col("n") > PIECE).select("label")
    return rows.join(large, "label", "left_anti").select("src", "dst", "weight", "label"), label.join(large, "label").select("id", "label"), piece


def connected_parts(edges: DataFrame, label: DataFrame) -> DataFrame:
    """id, label: each label's nodes parted into those that its edges connect, named by their least id. A task parts whole labels; those with over ``PIECE`` edges are parted by joins."""
    from .metrics import connected_components

    e = cut(_inside(edges, label))
    rows, large, piece = _split_by_size(e, label)
    out = _by_piece(rows.select("src", "dst", "weight", "label"), piece, lambda src, dst, w, of: parted(src, dst, w))
    if large is not None:
        whole = cut(e.join(large.select(F.col("id").alias("src")), "src"))
        out = out.unionByName(connected_components(whole, large.select("id"), "id").select("id", F.col("component").alias("label")))
    return cut(out)


def settled(src: np.ndarray, k: np.ndarray, now: np.ndarray, dst: np.ndarray, label: np.ndarray, vol: np.ndarray, w: np.ndarray, total: float, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of ``src`` (sorted) and their labels when none of them gains by a move, one after the other; nodes elsewhere keep ``label``."""
    nodes, first = np.unique(src, return_index=True)
    names, code = np.unique(label, return_inverse=True)
    volume = np.zeros(len(names))
    volume[code] = vol
    volume, k = volume.tolist(), k[first].tolist()
    of = np.searchsorted(names, now[first]).tolist()
    at = np.minimum(np.searchsorted(nodes, dst), len(nodes) - 1)
    # places of nodes that are here, and codes of labels elsewhere below zero
    to = np.where(nodes[at] == dst, at, -code - 1)
    keep = src != dst
    ends = np.searchsorted(src[keep], nodes, side="right").tolist()
    pairs = list(zip(to[keep].tolist(), w[keep].tolist()))
    near = [pairs[a:b] for a, b in zip([0, *ends], ends)]
    todo, waits = deque(range(len(nodes))), [True] * len(nodes)
    while todo:
        v = todo.popleft()
        waits[v] = False
        c, share = of[v], resolution * k[v] / total
        links = {c: 0.0}
        for u, x in near[v]:
            a = of[u] if u >= 0 else -u - 1
            links[a] = links.get(a, 0.0) + x
        volume[c] -= k[v]
        least = round(links[c] - share * volume[c], 9)
        gains = {a: round(x - share * volume[a], 9) for a, x in links.items()}
        best = max(gains.values())
        if best > least + LEAST * max(1.0, abs(least)):
            of[v] = min(a for a, g in gains.items() if g == best)
            for u, _ in near[v]:
                if u >= 0 and not waits[u] and of[u] != of[v]:
                    waits[u] = True
                    todo.append(u)
        volume[of[v]] += k[v]
    return nodes, names[of]


def _settled_by_one(e: DataFrame, state: DataFrame, size: DataFrame, total: float, resolution: float) -> DataFrame:
    """id, label after moves that one task makes, one after the other, while the rest stays as it is.

    ``size`` (id, edges, gains) has the nodes' numbers of edges and which of them gain: these move, and so do the nodes up to two
    steps around them, as long as that makes up to ``PIECE`` edges. ``state`` is id, k, label, vol.
    """
    some = size.where("gains").select("id")
    for _ in range(2):
        ring = cut(e.join(some.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).unionByName(some).distinct())
        if (size.join(ring, "id").agg(F.sum("edges")).first()[0] or 0) > PIECE:
            break
        some = ring
    mine = state.join(some, "id").select(F.col("id").alias("src"), "k", F.col("label").alias("now"), "vol")
    own = mine.select("src", "k", "now", F.col("src").alias("dst"), F.col("now").alias("label"), "vol", F.lit(0.0).alias("w"))
    there = state.select(F.col("id").alias("dst"), "label", "vol")
    near = e.join(mine.drop("vol"), "src").join(there, "dst").select("src", "k", "now", "dst", "label", "vol", F.col("weight").alias("w"))
    new = _by_piece(own.unionByName(near), F.lit(0), lambda *x: settled(*x, total, resolution))
    return cut(state.select("id", "label").join(new.withColumnRenamed("label", "to"), "id", "left").select("id", F.coalesce("to", "label").alias("label")))


def _moved(edges: DataFrame, label: DataFrame, degree: DataFrame, total: float, resolution: float) -> DataFrame:
    """Local moves until no node gains by a move to a neighbouring community.

    In a round a random half of the nodes that gain move at once, each to where it gains most; of two nodes that are alone
    only the one joins the other. That may undo a gain: a round after which modularity isn't greater is taken back, and
    fewer nodes move at once. Beyond ``MOST_COLOURS`` only moves are made that leave or enter a community which no other
    move of the round touches; such gains add up, so modularity grows with each round and the rounds come to an end. Where
    the nodes that gain have up to ``PIECE`` edges together, a task moves them and those around them one after the other instead.
    """
    e = cut(edges.where("src <> dst"))
    best, most, colours, r = label, None, COLOURS, 0
    while True:
        state = label.join(degree, "id")
        volume = state.groupBy("label").agg(F.sum("k").alias("vol"), F.count("*").alias("n"))
        state = cut(state.join(volume, "label").select("id", "k", "label", "vol", "n"))
        own = state.select(F.col("id").alias("src"), "k", F.col("label").alias("now"), F.col("vol").alias("all"), F.col("n").alias("alone"))
        near = e.join(state.select(F.col("id").alias("dst"), "label", "vol", "n"), "dst").select("src", "label", "vol", "n", "weight")
        # every node is also linked with its own community, by nothing
        near = near.unionByName(state.select(F.col("id").alias("src"), "label", "vol", "n", F.lit(0.0).alias("weight")))
        x = near.groupBy("src", "label").agg(F.sum("weight").alias("w"), F.first("vol").alias("vol"), F.first("n").alias("n"), F.count("*").alias("edges")).join(own, "src")
        here = F.col("label") == F.col("now")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("vol") - F.when(here, F.col("k")).otherwise(0.0)) / total, 9)
        x = x.withColumns({"g": gain, "here": here}).groupBy(F.col("src").alias("id"))
        x = x.agg(
            F.first("now").alias("now"), F.first("alone").alias("alone"), F.sum("edges").alias("edges"),
            F.max_by(F.struct(F.col("label").alias("to"), F.col("n").alias("there")), F.struct("g", F.struct(-F.col("label")))).alias("to"),
            F.max("g").alias("g1"), F.max(F.when(F.col("here"), F.col("g"))).alias("g0"),
            F.max(F.when(F.col("here"), F.col("w"))).alias("inside"), F.first(F.col("k") * F.col("all")).alias("square"),
        )
        x = cut(x.select("id", "now", "to.to", "g0", "g1", "inside", "square", "edges", (F.col("g1") > F.col("g0") + LEAST).alias("gains"), ((F.col("alone") > 1) | (F.col("to.there") > 1) | (F.col("to.to") < F.col("now"))).alias("first")))
        # modularity is of the labels that this round began with: what all rounds share (links inside a node) is left out
        inside, square, there, held = x.agg(F.sum("inside"), F.sum("square"), F.count_if("gains"), F.sum(F.when(F.col("gains"), F.col("edges")))).first()
        value = (inside or 0.0) / total - resolution * (square or 0.0) / total**2
        log.info("communities: round %d, %d nodes gain, modularity %.6f", r, there, value)
        if most is not None and value <= most:
            label, most, colours = best, None, colours * 2
            continue
        best, most = label, value
        if not there:
            return best
        if held <= PIECE:
            label = _settled_by_one(e, state, x.select("id", "edges", "gains"), total, resolution)
        elif colours > MOST_COLOURS:
            move = F.struct(F.col("g1") - F.col("g0"), "id").alias("move")
            touched = x.where("gains").select(F.explode(F.array("now", "to")).alias("c"), move).groupBy("c").agg(F.max("move").alias("first")).select("c", F.col("first.id").alias("winner"))
            picked = x.where("gains").join(touched.select(F.col("c").alias("now"), F.col("winner").alias("w1")), "now").join(touched.select(F.col("c").alias("to"), F.col("winner").alias("w2")), "to")
            picked = picked.where("id = w1 and id = w2").select("id", F.lit(True).alias("moves"))
            label = cut(x.join(picked, "id", "left").select("id", F.when(F.col("moves"), F.col("to")).otherwise(F.col("now")).alias("label")))
        else:
            turn = F.col("gains") & F.col("first") & (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(colours)) == 0)
            label = x.select("id", F.when(turn, F.col("to")).otherwise(F.col("now")).alias("label"))
        r += 1


def rebuilt(src: np.ndarray, dst: np.ndarray, w: np.ndarray, outer: np.ndarray, k: np.ndarray, total: float, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (``src``, sorted) and the least node of the part each comes to lie in; see ``_refined``. Links lie inside the communities ``outer``."""
    nodes, near = _neighbours(src, dst, w)
    first = np.unique(src, return_index=True)[1]
    _, of = np.unique(outer[first], return_inverse=True)
    k = k[first]
    whole = np.bincount(of, k)[of].tolist()
    vol, n, part = k.tolist(), [1] * len(nodes), list(range(len(nodes)))
    k, out = list(vol), [sum(x for _, x in links) for links in near]
    fine = lambda p: out[p] >= resolution * vol[p] * (whole[p] - vol[p]) / total - LEAST
    moved = True
    while moved:
        moved = False
        for v in range(len(nodes)):
            if part[v] != v or n[v] != 1 or not fine(v):
                continue
            links: dict[int, float] = {}
            for u, x in near[v]:
                links[part[u]] = links.get(part[u], 0.0) + x
            gains = {p: round(x - resolution * k[v] * vol[p] / total, 9) for p, x in links.items() if fine(p)}
            best = max(gains.values(), default=0.0)
            if best > LEAST:
                p = min(p for p, g in gains.items() if g == best)
                out[p] += out[v] - 2 * links[p]
                vol[p] += k[v]
                part[v], n[p], n[v], moved = p, n[p] + 1, 0, True
    least: dict[int, int] = {}
    for v, p in enumerate(part):
        least.setdefault(p, v)
    return nodes, nodes[[least[p] for p in part]]


def finished(src: np.ndarray, dst: np.ndarray, w: np.ndarray, start: np.ndarray, total: float, resolution: float, refine: bool) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of ``src`` (sorted) and their communities at the end of all levels, as ``communities`` goes through them; ``start`` has the labels that the nodes begin with."""
    nodes, first = np.unique(src, return_index=True)
    part, label = nodes.copy(), start[first]
    while True:
        names, i = np.unique(src, return_inverse=True)
        k = np.bincount(i, w, len(names))
        j = np.searchsorted(names, dst)
        codes, of = np.unique(label, return_inverse=True)
        volume = np.bincount(of, k, len(codes))
        moved = settled(src, k[i], label[i], dst, label[j], volume[of][j], w, total, resolution)[1]
        current = moved[np.searchsorted(names, part)]
        split = moved
        if refine and (moved != names).any():
            inside = (moved[i] == moved[j]) | (src == dst)
            split = rebuilt(src[inside], dst[inside], w[inside], moved[i][inside], k[i][inside], total, resolution)[1]
        if not (split != names).any():
            return nodes, current
        part = split[np.searchsorted(names, part)]
        up, back = np.unique(split, return_inverse=True)
        label = up
        if refine:
            # parts start in the communities that they were built from, named by the least part
            outer = np.unique(moved, return_inverse=True)[1]
            of_part = np.zeros(len(up), np.int64)
            of_part[back] = outer
            least = np.full(len(names), np.iinfo(np.int64).max)
            np.minimum.at(least, of_part, up)
            label = least[of_part]
        pair, at = np.unique(back[i] * len(up) + back[j], return_inverse=True)
        src, dst, w = up[pair // len(up)], up[pair % len(up)], np.bincount(at, w, len(pair))


def _finished(e: DataFrame, start: DataFrame, total: float, resolution: float, refine: bool) -> DataFrame:
    """id, label of a graph of up to ``PIECE`` edges at the end of all levels: one task's work."""
    rows = e.unionByName(start.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"))).join(start.withColumnRenamed("id", "src"), "src")
    return cut(_by_piece(rows.select("src", "dst", "weight", "label"), F.lit(0), lambda *x: finished(*x, total, resolution, refine)))


def _refined(edges: DataFrame, outer: DataFrame, degree: DataFrame, total: float, resolution: float) -> DataFrame:
    """Each community of ``outer`` built up again from its single nodes, by the rules of ``_refined_by_rounds``; a task rebuilds whole communities, one node after the other, and only those with over ``PIECE`` edges go by rounds."""
    rows, large, piece = _split_by_size(cut(_inside(edges, outer)), outer)
    rows = rows.join(degree.withColumnRenamed("id", "src"), "src").select("src", "dst", "weight", "label", "k")
    out = _by_piece(rows, piece, lambda *x: rebuilt(*x, total, resolution))
    if large is not None:
        out = out.unionByName(_refined_by_rounds(edges, cut(large), degree, total, resolution))
    return cut(out)


def _refined_by_rounds(edges: DataFrame, outer: DataFrame, degree: DataFrame, total: float, resolution: float) -> DataFrame:
    """Each community of ``outer`` built up again from its single nodes.

    Only nodes that are still alone move, only inside their community, and only if they and the part they join are well
    connected with the rest of it: linked by at least what chance would give. Parts that come out disconnected, as when a
    part's first node left while others joined, are parted.
    """
    e = cut(_inside(edges, outer))
    of = cut(outer.withColumnRenamed("label", "outer").join(degree, "id"))
    whole = of.groupBy("outer").agg(F.sum("k").alias("all"))
    of = cut(of.join(whole, "outer"))
    label = of.select("id", F.col("id").alias("label"))
    quiet, r = 0, 0
    while quiet < COLOURS:
        state = label.join(of, "id")
        across = e.join(label.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
        links = across.groupBy(F.col("src").alias("id"), F.col("a").alias("now"), F.col("b").alias("label")).agg(F.sum("weight").alias("w")).where("now <> label")
        out = across.where("a <> b").groupBy(F.col("a").alias("label")).agg(F.sum("weight").alias("out"))
        part = state.groupBy("label").agg(F.sum("k").alias("vol"), F.count("*").alias("n"), F.first("all").alias("all"))
        part = part.join(out, "label", "left")
        fine = F.coalesce("out", F.lit(0.0)) >= resolution * F.col("vol") * (F.col("all") - F.col("vol")) / total - LEAST
        part = cut(part.select("label", "vol", "n", fine.alias("fine")))
        alone = part.where("n = 1 and fine").select(F.col("label").alias("now"), F.col("vol").alias("k"))
        x = links.join(alone, "now").join(part.where("fine").select("label", "vol"), "label")
        gain = F.round(F.col("w") - resolution * F.col("k") * F.col("vol") / total, 9)
        turn = F.pmod(F.xxhash64("id", F.lit(r // COLOURS)), F.lit(COLOURS)) == r % COLOURS
        to = x.where(turn).withColumn("g", gain).where(F.col("g") > LEAST).groupBy("id").agg(F.max_by("label", F.struct("g", F.struct(-F.col("label")))).alias("to"))
        to = cut(to)
        quiet = 0 if to.limit(1).count() else quiet + 1
        if not quiet:
            label = cut(label.join(to, "id", "left").select("id", F.coalesce("to", "label").alias("label")))
        r += 1
    return connected_parts(e, label)


def communities(edges: DataFrame, nodes: DataFrame, id_col: str, resolution: float = 1.0, refine: bool = False) -> DataFrame:
    """id, community_id (long, from 0 on, in the order of the communities' least ids); ids are of any type that has an order.

    Louvain: local moves, then the graph of the communities, again until none merges. With ``refine`` (as Leiden does) each
    community is first built up again from single nodes, and those parts are what is aggregated; its communities are
    connected. Isolated nodes stay alone. Edges are symmetric.
    """
    with iteration(nodes.sparkSession) as kept:
        names = numbered_ids(nodes, id_col)
        a, b = (names.select(F.col("id").alias(end), F.col("no").alias(f"_{end}")) for end in ("src", "dst"))
        e = cut(edges.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.col("weight").cast("double").alias("weight")))
        first = e
        current = names.select(F.col("no").alias("id"), F.col("no").alias("label"))
        total = e.agg(F.sum("weight")).first()[0]
        part, start = current, None
        while total:
            level = part.select(F.col("label").alias("id")).distinct()
            degree = cut(level.join(e.groupBy("src").agg(F.sum("weight").alias("k")), F.col("id") == F.col("src"), "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k")))
            begin = degree.select("id", F.col("id").alias("label")) if start is None else start
            if e.limit(PIECE + 1).count() <= PIECE:
                moved = _finished(e, begin, total, resolution, refine)
                current = cut(part.join(moved.withColumnRenamed("label", "m"), F.col("label") == moved["id"]).select(part["id"], F.col("m").alias("label")))
                break
            moved = _moved(e, begin, degree, total, resolution)
            merged = moved.where("id <> label").limit(1).count()
            current = cut(part.join(moved.withColumnRenamed("label", "m"), F.col("label") == moved["id"]).select(part["id"], F.col("m").alias("label")))
            split = _refined(e, moved, degree, total, resolution) if refine and merged else moved
            if not split.where("id <> label").limit(1).count():
                break
            if refine:
                # parts start in the communities that they were built from
                start = cut(split.join(moved.withColumnRenamed("label", "outer"), "id").groupBy(F.col("label").alias("id")).agg(F.min("outer").alias("outer")))
                start = cut(start.join(start.groupBy("outer").agg(F.min("id").alias("label")), "outer").select("id", "label"))
            part = cut(part.join(split.withColumnRenamed("label", "m"), F.col("label") == split["id"]).select(part["id"], F.col("m").alias("label")))
            e = cut(_between(e, split))
        if refine and total:
            current = connected_parts(first, current)
        order = numbered(current.groupBy("label").agg(F.min("id").alias("least")), ["least"], "community_id", 0)
        out = current.join(order, "label").select(F.col("id").alias("no"), "community_id").join(names, "no")
        return kept(out.select(F.col("id").alias(id_col), "community_id"))
