"""Operator 5's fingerprints at a similarity: near copies by five-word shingles, linked by their exact similarity only.

At a similarity of 0.8 SimHash fingerprints differ in some 10 bits and up to 20; blocks of bits that are equal up to such a
radius are so short that their shards are large shares of the corpus. Here shards come from the smallest hashes of a
text's shingle set, dealt into bands: two texts of similarity s share a shard with the chance 1 - (1 - s**ROWS)**BANDS,
0.9994 at 0.8 and more above. Each shard has a BK-tree, as operator 5's have, which all its fingerprints ask for those
within the radius; the texts that it finds are compared by their shingle sets, as products of incidence matrices. A large
shard becomes pairs of blocks, the one's tree asked by the other, each of them a task's work of bounded size. A shard gives
stars, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced, temporary
from .components import components, min_labels
from .groups import key_runs
from .simhash import ASKED, BKTrees, majority
from .words import mix, spaced

WORDS, LEAST, RADIUS = 5, 0.8, 20
BANDS, ROWS = 14, 4
#: Texts of a shard that are compared in one piece, and cells of an incidence matrix that is held at once.
BLOCK, CELLS = 2048, 4_000_000
#: Ids that are broadcast at most (8 bytes each).
FEW = 500_000
_SALT = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_PLACE = np.random.default_rng(55).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's shingles of ``words`` words (of all its words where it has fewer), and where each text's begin (n + 1)."""
    w = spaced(column)
    n = np.diff(w.first)
    many = np.where(n >= words, n - words + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), many)
    start = np.arange(first[-1]) - first[row] + w.first[row]
    out = np.zeros(len(start), np.uint64)
    for k in range(words):
        inside = start + k < w.first[row + 1]
        out[inside] += mix(w.hash[start[inside] + k] ^ _PLACE[-1]) * _PLACE[k]
    return mix(out), first


def band_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text (its shingle hashes follow each other in ``values``) a key for each band; no shingle gives the same keys to all such texts."""
    out = np.zeros((len(first) - 1, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    starts = first[:-1][full]
    for i in range(BANDS):
        key = np.full(len(full), _SALT[i], np.uint64)
        for salt in _SALT[i * ROWS : (i + 1) * ROWS]:
            key = mix(key ^ np.minimum.reduceat(mix(values ^ salt), starts))
        out[full, i] = key
    return out


def alike(values: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which of the sets ``left`` and ``right`` (rows of ``values`` by ``first``) have a Jaccard similarity of at least ``least``; two empty sets are equal."""
    n = np.diff(first)
    names, at = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(len(n)), n)
    # what only one set has is in no intersection
    common = np.bincount(at, minlength=len(names)) > 1
    column = np.cumsum(common) - 1
    keep = common[at]
    row, at = row[keep], column[at[keep]]
    width = max(1, CELLS // max(1, len(n)))
    inter = np.zeros((len(left), len(right)))
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(common.sum()), width):
        a, b = np.searchsorted(at, [low, low + width])
        x = np.zeros((len(n), min(width, int(common.sum()) - low)), np.float32)
        x[row[a:b], at[a:b] - low] = 1
        inter += x[left] @ x[right].T
    union = n[left][:, None] + n[right][None, :] - inter
    return np.where(union > 0, inter / np.maximum(union, 1), 1.0) >= least


def tree_pairs(points: np.ndarray, asked: np.ndarray, radius: int) -> np.ndarray:
    """Which of ``asked`` (rows) and ``points`` (columns) are within ``radius``, by a BK-tree of the points' distinct values."""
    values, at = np.unique(points, return_inverse=True)
    asking, of = np.unique(asked, return_inverse=True)
    near = np.zeros((len(asking), len(values)), bool)
    tree = BKTrees(values, np.zeros(1, np.int64))
    for low in range(0, len(asking), ASKED):
        q, node = tree.within(asking[low : low + ASKED], radius)
        near[low + q, node] = True
    return near[of][:, at]


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node, shingles: the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values, first = shingles(batch.column(1), words)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((values, row))
            row, values = row[order], values[order]
            new = np.append(True, (row[1:] != row[:-1]) | (values[1:] != values[:-1])) if len(row) else np.zeros(0, bool)
            ends = np.searchsorted(row[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values[new].view(np.int64)))], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _shards(texts: DataFrame, words: int) -> DataFrame:
    """node, fp, keys: each text's fingerprint and its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values, first = shingles(batch.column(1), words)
            keys = band_keys(values, first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(majority(values, np.diff(first)).view(np.int64)), lists], ["node", "fp", "keys"])

    return texts.select("node", "text").mapInArrow(run, "node long, fp long, keys array<long>")


def links(texts: DataFrame, words: int = WORDS, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """Links a, b of ``texts`` (node, text as bytes; no two rows of one node) that join all found pairs of at least that similarity."""
    keyed = materialize(_shards(texts, words), "shards").select("node", "fp", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(shared, "key").select("key", "n", "node", "fp"), "members")
    # only texts that share a shard are looked at again; their ids are broadcast while they are few
    needed = materialize(members.select("node").distinct(), "near-nodes")
    sets = _sets(texts.join(F.broadcast(needed) if needed.count() <= FEW else needed, "node", "left_semi"), words)
    g = F.ceil(F.col("n") / BLOCK)
    mine = F.pmod(F.xxhash64("node"), g)
    placed = members.select("key", "node", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), g - 1)).alias("other"))
    placed = placed.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "fp")
    placed = placed.join(materialize(sets, "shingle-sets"), "node").select("key", "lo", "hi", "mine", "node", "fp", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in key_runs(batches, 3):
            lo, hi, mine, node = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            fp = batch.column(5).to_numpy().view(np.uint64)
            bounds = batch.column(6).offsets.to_numpy()
            values = batch.column(6).values.to_numpy()
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
                left, right = (np.flatnonzero(mine[low:high] == x[low]) for x in (lo, hi))
                near = tree_pairs(fp[low:high][right], fp[low:high][left], radius)
                near &= left[:, None] != right[None, :]
                # only texts with another one within the radius go into the product
                r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(r):
                    continue
                used = np.unique(np.concatenate([left[r], right[c]]))
                sizes = bounds[low + used + 1] - bounds[low + used]
                first = np.concatenate([[0], np.cumsum(sizes)])
                place = np.arange(first[-1]) + np.repeat(bounds[low + used] - first[:-1], sizes)
                hit = alike(values[place], first, np.searchsorted(used, left[r]), np.searchsorted(used, right[c]), least) & near[np.ix_(r, c)]
                i, j = np.nonzero(hit)
                if len(i):
                    nodes, least_of = min_labels(low + left[r][i], low + right[c][j])
                    out.append((node[nodes], node[least_of]))
            a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]).filter(pa.array(a != b))

    keys = ["key", "lo", "hi"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all their columns, of which each group of near copies keeps one: that with the smallest id.

    Rows without an id are their groups' only when no other row is. Of rows with the same id and text one stays. Null
    and empty texts and those without a word are one group.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    none = F.lit(-(2**63))
    i = F.col(id_col).cast("long")
    hashed = [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2")]
    with temporary(docs.sparkSession):
        # equal texts are one node, whose number is fixed by writing it
        each = docs.select(i.alias("id"), *hashed, text.alias("text"))
        classes = each.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.first("text").alias("text"))
        classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "first", "text"), "distinct-texts")
        of = components(links(classes.select("node", "text"), words, least, radius), "near-copies")
        labelled = classes.select("node", "k1", "k2", "first").join(of, "node", "left").select("k1", "k2", "first", F.coalesce("component", "node").alias("label"))
        # the group's least id, or one of its texts if none has an id
        least_of = labelled.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("o"), "first", "k1", "k2")).alias("m"))
        keep = materialize(least_of.select(F.coalesce("m.first", none).alias("i"), "m.k1", "m.k2"), "kept", keep=True)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mine = docs.select(row.alias("row"), F.coalesce(i, none).alias("i"), *hashed)
    return mine.join(keep, ["i", "k1", "k2"]).dropDuplicates(["i", "k1", "k2"]).select("row.*")
