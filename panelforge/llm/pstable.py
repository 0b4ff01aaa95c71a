"""Operator 3: Euclidean p-stable hashing of normalised vectors, with exact cosines inside the buckets.

For unit vectors cosine c means distance sqrt(2 - 2c). A hash is floor((x . a + b) / width) with normal a; two vectors at
distance d share it with a probability p(d) that falls with d. ``k`` hashes make a key, ``tables`` keys a vector. Both
follow from the number of vectors: a bucket holds about ``fill`` unrelated vectors, and a pair at the threshold itself
is missed by all tables with a probability of at most ``miss`` (closer pairs far less often).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, temporary
from .components import components, min_labels
from .groups import key_runs

#: Rows of a bucket that are compared in one piece; a larger bucket is dealt out as pairs of blocks.
BLOCK = 4096


def shared(distance: float, width: float) -> float:
    """Probability that one hash of two vectors at ``distance`` is the same."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


class Hashing:
    """Random projections for a corpus of ``n`` vectors; the same for the same arguments anywhere."""

    def __init__(self, n: int, threshold: float, width: float = 2.5, fill: float = 64, miss: float = 0.03, seed: int = 17):
        near, unrelated = shared(math.sqrt(2 - 2 * threshold), width), shared(math.sqrt(2), width)
        self.k = max(6, round(math.log(max(n, 2) / fill) / -math.log(unrelated)))
        self.tables = max(4, math.ceil(math.log(miss) / math.log1p(-(near**self.k))))
        self.width, self.seed = width, seed
        self._made: dict[int, tuple] = {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """int64 keys, one row a vector and one column a table."""
        dim = unit.shape[1]
        if dim not in self._made:
            rng = np.random.default_rng([self.seed, dim])
            a = rng.standard_normal((dim, self.k * self.tables)) / self.width
            b = rng.random(self.k * self.tables)
            odd = rng.integers(0, 2**63, self.k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            salt = rng.integers(0, 2**63, self.tables, dtype=np.uint64)
            self._made[dim] = a, b, odd, salt
        a, b, odd, salt = self._made[dim]
        cells = np.floor(unit @ a + b).astype(np.int64).view(np.uint64).reshape(len(unit), self.tables, self.k)
        mixed = (cells * odd).sum(axis=2, dtype=np.uint64) + salt
        mixed ^= mixed >> np.uint64(31)
        return (mixed * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; all lists of the column have one length and a component other than zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # the squares of very large or small components would leave the range of doubles; a power of two changes no digit
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 0.03) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of unlike
    lengths or rows without an id (n_links 0; component_id null for the latter, kept false). Rows with equal vectors are
    all linked with each other; they are hashed once, with their number, so no pair of them is formed. Rows that repeat
    an id are vectors of their own, with links and a component of their own. An empty table gives no rows.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    with temporary(vectors.sparkSession):
        each = rows.select("vec_id", F.when(fine, v).alias("v"), F.when(fine, F.sha2(v.cast("string"), 256)).alias("sig"))
        classes = each.where("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
        # a class's number is fixed by writing it
        classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "sig", "least", "copies", "v", F.size("v").alias("dim")), "vector-classes")
        links = materialize(_class_links(classes, Hashing(classes.count(), threshold, miss=miss), threshold), "vector-links")
        counts = links.groupBy("a").agg(F.sum("n").alias("n"))
        joined = components(links.where("a <> b").select("a", "b").distinct(), "vector-components")
        of = classes.select("node", "sig", "least", "copies").join(counts, F.col("node") == F.col("a"), "left").drop("a").join(joined, "node", "left")
        of = materialize(of.select("sig", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("label")), "vector-labels")
        # a component of many classes is one group of an aggregation and splits in the join
        component = materialize(of.groupBy("label").agg(F.min("least").alias("c")), "least-vectors")
        of = materialize(of.join(component, "label").select("sig", "n", "c"), "linked-vectors", keep=True)
    done = each.select("vec_id", "sig").join(of, "sig", "left")
    return done.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def _class_links(classes: DataFrame, hashing: Hashing, threshold: float) -> DataFrame:
    """a, n (copies that a is linked with, found first in this bucket), b (a star's centre): what each bucket shows of ``classes``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                key = hashing.keys(_matrix(part.column(2)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * hashing.tables), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["node", "copies", "v", "keys"])

    kind = dict(classes.dtypes)["v"]
    keyed = materialize(classes.select("node", "copies", "v", "dim").mapInArrow(keys, f"node long, copies long, v {kind}, keys array<long>"), "vector-keys")
    dealt = keyed.select("node", F.posexplode("keys").alias("t", "key"))
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # a bucket of more than BLOCK vectors becomes all pairs of its blocks, each of them a task's work of bounded size
    g = F.ceil(F.col("n") / BLOCK)
    mine = F.pmod(F.xxhash64("node"), g)
    placed = dealt.join(sizes, ["t", "key"]).select("t", "key", "node", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), g - 1)).alias("other"))
    placed = placed.select("t", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node")
    # a vector's keys go with it, so that all buckets see the same ones: computed again, a product on a cell's edge may fall elsewhere
    placed = placed.join(keyed, "node").select("t", "key", "lo", "hi", "mine", "node", "copies", "v", "keys")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in key_runs(batches, 4):
            lo, hi, mine, node, copies = (batch.column(i).to_numpy() for i in (2, 3, 4, 5, 6))
            tables = batch.column(0).to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            sizes = pc.list_value_length(batch.column(7)).to_numpy()
            every = batch.column(8).flatten().to_numpy().reshape(batch.num_rows, -1)
            for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
                # keys of vectors of unlike lengths are equal only by chance
                for dim in np.unique(sizes[low:high]).tolist():
                    of = low + np.flatnonzero(sizes[low:high] == dim)
                    if len(of) > 1:
                        unit = _matrix(batch.column(7).take(pa.array(of)))
                        left, right = np.flatnonzero(mine[of] == lo[low]), np.flatnonzero(mine[of] == hi[low])
                        out += _linked(unit, left, right, node[of], copies[of], every[of, : int(tables[low])], threshold)
            a, n, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(b)], ["a", "n", "b"])

    order = ["t", "key", "lo", "hi"]
    return placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, n long, b long")


def _linked(unit: np.ndarray, left: np.ndarray, right: np.ndarray, node: np.ndarray, copies: np.ndarray, earlier: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links between ``left`` and ``right`` (the same rows, or two blocks) that no earlier table shows (``earlier`` has their keys there): id, linked rows, a star's centre."""
    same = len(left) == len(right) and (left == right).all()
    total = np.zeros(len(unit), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, len(left), 512):
        rows = left[low : low + 512]
        hit = unit[rows] @ unit[right].T >= threshold
        if same:
            hit[np.arange(len(rows)), low + np.arange(len(rows))] = False
        if not hit.any():
            continue
        r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        kr, kc = earlier[rows[r]], earlier[right[c]]
        new = hit[np.ix_(r, c)]
        for before in range(earlier.shape[1]):
            new &= kr[:, before][:, None] != kc[:, before][None, :]
        total[rows[r]] += new @ copies[right[c]]
        if not same:
            total[right[c]] += copies[rows[r]] @ new
        i, j = np.nonzero(new)
        if len(i):
            nodes, least = min_labels(rows[r][i], right[c][j])
            ends.append((nodes, least))
    if not ends:
        return []
    nodes, least = min_labels(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
    return [(node[nodes], total[nodes], node[least])]


def recall(vectors: DataFrame, found: DataFrame, threshold: float = 0.9, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2000) -> float:
    """Share of the links of all rows whose id is divisible by ``every`` that n_links shows, by exact products with all rows in blocks of ``block`` queries."""
    v = F.col(vector_col)
    clean = vectors.where(v.isNotNull() & (F.size(v) > 0)).select(F.col(id_col).alias("i"), v.alias("v"))
    asked = clean.where(F.col("i") % every == 0)
    want = got = 0
    n = asked.count()
    parts = asked.withColumn("p", F.pmod(F.xxhash64("i"), F.lit(max(1, -(-n // block)))))
    for p in range(max(1, -(-n // block))):
        q = parts.where(F.col("p") == p).select("i", "v").toPandas()
        if not len(q):
            continue
        ids, unit = q["i"].to_numpy(), np.array(q["v"].tolist(), np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)

        def count(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, unit: np.ndarray = unit) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = _matrix(batch.column(1)) @ unit.T >= threshold
                hit &= batch.column(0).to_numpy()[:, None] != ids[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.sum(axis=0))], ["i", "n"])

        true = clean.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
        both = true.join(found.select(F.col("vec_id").alias("i"), "n_links"), "i").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
        want, got = want + (both[0] or 0), got + (both[1] or 0)
    return got / want if want else 1.0


def op3_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` at cosine 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
