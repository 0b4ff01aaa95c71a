"""Operator 13: embedding whitening from an exact scatter matrix, by residue numbers.

Vectors are put on an integer grid. Their second moments would leave the range of doubles' whole numbers, so each task
multiplies residues instead: for each of some primes a product of small whole numbers that doubles hold exactly. The
tasks' residues are added up, and Chinese remaindering makes of them the moments as whole numbers of any size. The
covariance is then exact until it is rounded once, and its eigenvectors come from double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, temporary

#: The grid: steps to one, and what is added to a coordinate's step.
STEPS, OFFSET = 64, 1_000_000
#: Residues lie within half a prime of zero, and this many products of two of them add up to less than 2^53.
LIMIT, ROWS = 1 << 21, 4096
#: Entries of greater magnitude have no step that a long can hold.
REACH = float(1 << 56)


def primes(product: int) -> list[int]:
    """The greatest primes below ``LIMIT``, so many that their product is greater than ``product``."""
    found, total, n = [], 1, LIMIT - 1
    while total <= product:
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
            total *= n
        n -= 2
    return found


def residue(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p as doubles, from -p/2 to p/2."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def rebuilt(residues: list[int], p: list[int]) -> int:
    """The whole number of least magnitude with these residues (Chinese remaindering, one prime after the other)."""
    value, product = 0, 1
    for r, q in zip(residues, p):
        value += product * ((r - value) * pow(product, -1, q) % q)
        product *= q
    return value - product if value > product // 2 else value


def _grid(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batches: Iterable[pa.RecordBatch], lists: int, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of vectors of one length (at most ``rows`` of them) and the vectors as a matrix."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(lists)).to_numpy()
        for dim in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == dim))
            for low in range(0, part.num_rows, rows):
                piece = part.slice(low, rows)
                yield piece, _grid(piece.column(lists))


@dataclass(frozen=True)
class Whitening:
    """Of the vectors of one length: their number n, mean = whole + rest / n, and the components with their eigenvalues."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; what a double can't hold is lost only here."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates along the components; NaN for those along which the vectors don't vary."""
        rank = self.values > self.values[0] * len(self.whole) * np.finfo(float).eps if len(self.values) else np.zeros(0, bool)
        scale = np.where(rank, np.sqrt(np.where(rank, self.values, 1.0)), np.nan)
        return self.centred(x) @ self.vectors / scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions, exactly; None where a long can't hold it."""
        d = x - self.whole
        most = int(np.abs(d).max(initial=0)) * self.n + self.n
        if most**2 * max(1, d.shape[1]) < 2**63:
            y = self.n * d - self.rest
            return (y * y).sum(axis=1).tolist()
        rest = self.rest.tolist()
        sums = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest)) for row in d.tolist()]
        return [s if s < 2**63 else None for s in sums]


def whitening(moments: list[list[int]], components: int) -> Whitening:
    """From the exact moments of (1, x): the count and sums are its first row, the second moments the rest."""
    n, sums = moments[0][0], moments[0][1:]
    d = len(sums)
    covariance = np.array([[(n * moments[i + 1][j + 1] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d)
    trace = sum(n * moments[i + 1][i + 1] - sums[i] ** 2 for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    whole = np.array([s // n for s in sums], np.int64)
    return Whitening(n, whole, np.array([s % n for s in sums], np.int64), np.maximum(values[order], 0.0), np.ascontiguousarray(vectors[:, order]), trace)


def grid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, x: each vector on the grid. Vectors go that are NULL or empty or hold NULL or non-finite entries, or such as have no step in a long."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda c: c.cast("double")).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= REACH))
    x = F.transform("v", lambda c: F.floor(c * STEPS).cast("long") + OFFSET)
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad).select("vec_id", F.size("v").alias("dim"), x.alias("x"))


def moments(distinct: DataFrame) -> dict[int, list[list[int]]]:
    """For each length the exact sums of the products of (1, x) with itself, over the rows of ``distinct`` (dim, x).

    What comes to the driver are the matrices: squares of the lengths, whatever the number of rows.
    """
    spread = F.array_max(F.transform("x", F.abs))
    sizes = {r.dim: primes(2 * max(r.n, 1) * max(r.most, 1) ** 2) for r in distinct.groupBy("dim").agg(F.count("*").alias("n"), F.max(spread).alias("most")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for _, x in _by_length(batches, 1):
            dim = x.shape[1]
            for p in sizes[dim]:
                r = np.concatenate([np.ones((len(x), 1)), residue(x, p)], axis=1)
                sums[dim, p] = (sums.get((dim, p), 0) + (r.T @ r).astype(np.int64)) % p
        for (dim, p), s in sums.items():
            i, j = np.triu_indices(len(s))
            n = len(i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, p, np.int64)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["dim", "p", "i", "j", "r"])

    # a task sends each sum once, so there is nothing to add up before the shuffle
    reduced = distinct.select("dim", "x").mapInArrow(run, "dim int, p long, i int, j int, r long").groupBy("dim", "p", "i", "j").agg((F.sum("r") % F.col("p")).alias("r"))
    out: dict[int, list[list[int]]] = {d: [[0] * (d + 1) for _ in range(d + 1)] for d in sizes}
    found: dict[tuple[int, int, int], dict[int, int]] = {}
    for t in reduced.toArrow().to_batches():
        for dim, p, i, j, r in zip(*(t.column(c).to_pylist() for c in range(5))):
            found.setdefault((dim, i, j), {})[p] = r
    for (dim, i, j), r in found.items():
        out[dim][i][j] = out[dim][j][i] = rebuilt([r[p] for p in sizes[dim]], sizes[dim])
    return out


def identity_errors(distinct: DataFrame, fits: dict[int, Whitening]) -> dict[int, float | None]:
    """Largest entry of the covariance of the whitened fit vectors, less the identity; each task centres its vectors before it multiplies. None if there is no component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for _, x in _by_length(batches, 1):
            w = fits[x.shape[1]].whitened(x)
            w = w[:, ~np.isnan(w).any(axis=0)]
            part = len(w), w.mean(axis=0), (w - w.mean(axis=0)).T @ (w - w.mean(axis=0))
            held[x.shape[1]] = merged(held[x.shape[1]], part) if x.shape[1] in held else part
        for dim, (n, mean, square) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([square.ravel().tolist()], pa.list_(pa.float64()))], ["dim", "n", "mean", "square"])

    def joined(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        total = None
        for row in parts.to_pylist():
            mean = np.array(row["mean"])
            part = row["n"], mean, np.array(row["square"]).reshape(len(mean), len(mean))
            total = part if total is None else merged(total, part)
        n, mean, square = total
        error = float(np.abs(square / n - np.eye(len(mean))).max()) if len(mean) else None
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([error], pa.float64())], ["dim", "error"])

    # a row a task
    parts = distinct.select("dim", "x").mapInArrow(run, "dim int, n long, mean array<double>, square array<double>")
    return {r.dim: r.error for r in parts.groupBy("dim").applyInArrow(joined, "dim int, error double").collect()}


def merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred products of two sets of rows taken together."""
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and each of its first components.

    Rows are dropped whose vector is NULL or empty or holds NULL or non-finite entries (or entries beyond 2^56, which have
    no place on the grid). The fit is over the distinct grid vectors, so copies count once; every row has its own result,
    repeated rows and rows without an id too. Vectors of each length are a space of their own. Components along which the
    vectors don't vary have NULL for ``whitened``; ``explained`` is NULL if nothing varies, ``deviation`` where it is beyond
    a long, ``identity_error`` where no component varies. A table without vectors gives no rows. To the driver and to the
    tasks go matrices whose size follows from the lengths, not from the number of rows.
    """
    spark = vectors.sparkSession
    rows = grid_vectors(vectors, id_col, vector_col)
    with temporary(spark):
        distinct = materialize(rows.select("dim", "x").distinct(), "grid")
        with small_batches(spark):
            fits = {dim: whitening(m, components) for dim, m in moments(distinct).items()}
            errors = identity_errors(distinct, fits)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _by_length(batches, 1, 1024):
            dim = x.shape[1]
            fit, k = fits[dim], len(fits[dim].values)
            w = fit.whitened(x)
            explained = fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [piece.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, fit.n, np.int64)), pa.array(fit.deviation(x), pa.int64()).take(each)]
            columns += [pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(explained, len(x)), from_pandas=True), pa.array([errors.get(dim)] * (len(x) * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``, first 16 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
