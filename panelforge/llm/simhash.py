"""Operator 5: SimHash fingerprints, and BK-trees that link those within a radius.

Fingerprints within the radius agree on some blocks of bits (of radius + c blocks at least c are untouched), so each is
dealt to one shard for every choice of c blocks, and a shard's BK-tree is built and searched where the shard lies. The
whole corpus's trees have no size bound, so nothing is broadcast: the queries go to the trees that can hold an answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sliced, table
from .components import components, min_labels
from .groups import key_runs

SEED, WORDS, RADIUS = 42, 4, 4
#: Points of a shard beyond which it is dealt anew by further blocks; points that ask a tree at once, and pairs of them and nodes.
SHARD, ASKED, PAIRS = 20_000, 1024, 1 << 20


def hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of each word shingle of an UTF-8 text: ASCII letters lower-cased, words split at ASCII white space."""
    found = text.lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)] if found else []
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], repeat(SEED)))


def majority(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the 64 bits set in over half of its hashes; no hash gives zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    starts = (np.cumsum(counts) - counts)[full]
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    packed = np.packbits(2 * sums > counts[full][:, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(packed).view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed long): one row for each row of ``docs``; null text counts as empty and gives zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [hashes(t, words) if t else [] for t in batch.column(2).to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            values = np.fromiter((h for x in found for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(majority(values, counts).view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


class BKTrees:
    """BK-trees over 64-bit points, one for each shard: a node's children are keyed by their Hamming distance to it.

    A shard's points lie side by side and ``first`` has where each begins; its first point is the root. ``edge`` is each node's distance to its parent, ``child`` lists all nodes by parent and edge, so that the children of
    a node within some distances lie side by side; ``levels`` are the nodes by depth.
    """

    def __init__(self, points: np.ndarray, first: np.ndarray):
        n = len(points)
        self.points, self.parent, self.edge = points, np.full(n, -1), np.zeros(n, np.int64)
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        self.levels = [first]
        waiting = np.flatnonzero(self.root != np.arange(n))
        at = self.root[waiting]
        while len(waiting):
            # the first point that comes to a node at a distance becomes its child there, the others go on to that child
            far = np.bitwise_count(points[waiting] ^ points[at]).astype(np.int64)
            _, one, group = np.unique(at * 65 + far, return_index=True, return_inverse=True)
            new = waiting[one]
            self.parent[new], self.edge[new] = at[one], far[one]
            self.levels.append(new)
            rest = np.ones(len(waiting), bool)
            rest[one] = False
            waiting, at = waiting[rest], new[group][rest]
        self.child = np.argsort(self.parent * 65 + self.edge, kind="stable")[len(first) :]
        self.key = (self.parent * 65 + self.edge)[self.child]

    def uniform(self, label: np.ndarray) -> np.ndarray:
        """The label that a node and all nodes below it have, or -1."""
        low, high = label.copy(), label.copy()
        for level in self.levels[:0:-1]:
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return np.where(low == high, low, -1)

    def search(self, asked: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of ``asked``, a node of its shard) within ``radius``, but for nodes below which all points have the asked one's label already."""
        known = self.uniform(label)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(asked, self.root[asked])]
        while todo:
            q, node = todo.pop()
            if len(q) > PAIRS:
                todo += [(q[PAIRS:], node[PAIRS:])]
                q, node = q[:PAIRS], node[:PAIRS]
            open_ = known[node] != label[q]
            q, node = q[open_], node[open_]
            far = np.bitwise_count(self.points[q] ^ self.points[node]).astype(np.int64)
            near = (far <= radius) & (q != node)
            found.append((q[near], node[near]))
            of, child = self._below(node, far, radius)
            if len(of):
                todo.append((q[of], child))
        return tuple(np.concatenate(x) for x in zip(*found))


    def within(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (of ``values``, a point) within ``radius``; there is one shard."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(np.arange(len(values)), np.full(len(values), self.levels[0][0]))]
        while todo:
            q, node = todo.pop()
            if len(q) > PAIRS:
                todo += [(q[PAIRS:], node[PAIRS:])]
                q, node = q[:PAIRS], node[:PAIRS]
            far = np.bitwise_count(values[q] ^ self.points[node]).astype(np.int64)
            found.append((q[far <= radius], node[far <= radius]))
            of, child = self._below(node, far, radius)
            if len(of):
                todo.append((q[of], child))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _below(self, node: np.ndarray, far: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of a node and a point at distance ``far`` the children that may lead to points within ``radius``: of which pair, and the child."""
        # only edges within the radius of the point's own distance can lead to another point within the radius
        low = np.searchsorted(self.key, node * 65 + np.maximum(far - radius, 0))
        n = np.searchsorted(self.key, node * 65 + np.minimum(far + radius, 64), side="right") - low
        of = np.repeat(np.arange(len(node)), n)
        return of, self.child[low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]


def tree_links(points: np.ndarray, first: np.ndarray | None = None, radius: int = RADIUS) -> np.ndarray:
    """For each of ``points`` the least index it reaches in its shard through distances of at most ``radius``: all ask their shard's BK-tree."""
    label = np.arange(len(points))
    if not len(points):
        return label
    trees = BKTrees(points, np.zeros(1, np.int64) if first is None else first)
    for low in range(0, len(points), ASKED):
        a, b = trees.search(np.arange(low, min(len(points), low + ASKED)), radius, label)
        p, q = label[a], label[b]
        if (differ := p != q).any():
            nodes, least = min_labels(p[differ], q[differ])
            to = np.arange(len(points))
            to[nodes] = least
            label = to[label]
    return label


def _choices(n: int, radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Bounds of the blocks of bits and which blocks make a key, so that a shard has some thousand points on average."""
    kept = 1
    while kept < 4 and n >> (64 * kept // (radius + kept)) > 2048:
        kept += 1
    blocks = radius + kept
    return [64 * i // blocks for i in range(blocks + 1)], list(combinations(range(blocks), kept))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b that join all distinct fingerprints ``fp`` within ``radius`` of each other: for each shard and component a star, not all pairs."""
    bounds, chosen = _choices(distinct.count(), radius)

    def block(value: F.Column, low: int, high: int) -> F.Column:
        return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1))

    def key(blocks: tuple[int, ...]) -> F.Column:
        out = F.lit(0).cast("long")
        for i in blocks:
            out = F.shiftleft(out, bounds[i + 1] - bounds[i]).bitwiseOR(block(F.col("fp"), bounds[i], bounds[i + 1]))
        return out

    dealt = distinct.select("fp", F.posexplode(F.array(*[key(c) for c in chosen])).alias("t", "k"))
    large = dealt.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    # within a large shard the other bits differ in at most radius places too: deal it by the blocks that its key leaves out
    spread = F.array(*[F.array(*[F.struct(F.lit(j).alias("j"), block(F.col("fp"), low, high).alias("s")) for j, (low, high) in enumerate(_rest(bounds, c, radius))]) for c in chosen])
    dealt = dealt.join(large, ["t", "k"], "left").select("t", "k", "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("s")))).otherwise(F.element_at(spread, F.col("t") + 1))).alias("x")).select("t", "k", "x.j", "x.s", "fp")
    keys = ["t", "k", "j", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in key_runs(batches, 4):
            points = batch.column(4).to_numpy().view(np.uint64)
            label = tree_links(points, at[:-1], radius)
            keep = label != np.arange(len(points))
            yield pa.RecordBatch.from_arrays([pa.array(points[keep].view(np.int64)), pa.array(points[label[keep]].view(np.int64))], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _rest(bounds: list[int], chosen: tuple[int, ...], radius: int) -> list[tuple[int, int]]:
    """Radius + 1 or more pieces of the bits outside the chosen blocks; a piece lies in one block."""
    pieces = [(bounds[i], bounds[i + 1]) for i in range(len(bounds) - 1) if i not in chosen]
    low, high = max(pieces, key=lambda p: p[1] - p[0])
    middle = (low + high) // 2
    return [p for p in pieces if p != (low, high)] + [(low, middle), (middle, high)] if len(pieces) <= radius else pieces


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable, itself included), one row for each row of ``docs``.

    Documents with one fingerprint are linked, those without a word (null and empty texts) by the fingerprint zero like
    any other. Repeated rows stay; a null id stays null and is never a component's id while another is there. An empty
    table gives no rows.
    """
    each = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    joined = components(fingerprint_links(classes.select("fp"), radius), "fingerprint-links")
    labelled = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("label"))
    # written, so that both sides of the join are plain shuffles, which Spark splits where one component is very large
    labelled = materialize(labelled, "fingerprint-labels")
    least = materialize(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "fingerprint-least")
    of = materialize(labelled.join(least, "label").select("fp", "label", "component_id"), "fingerprint-components")
    return each.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id", "label")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all their columns, of which each group of near duplicates keeps one: that with the smallest id.

    Rows without an id are their groups' only when no other row is. Of rows with the same id and text one stays.
    """
    found = near_duplicates(docs, id_col, text_col, radius, words)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label", "doc_id").agg(F.min("text_hash").alias("h"))
    # a repeated id is told apart by its text's hash; ids and hashes are plain columns so that one shuffle serves both steps
    none = F.lit(-(2**63))
    keep = materialize(first.select(F.coalesce("doc_id", none).alias("i"), "h"), "kept")
    names = [F.col(f"`{c}`") for c in docs.columns]
    mine = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(id_col).cast("long"), none).alias("i"), F.xxhash64(F.col(text_col).cast("binary")).alias("h"))
    return mine.join(keep, ["i", "h"]).dropDuplicates(["i", "h"]).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles of all ``documents``, radius 4."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
