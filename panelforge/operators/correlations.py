"""Correlations of all pairs of series over the dates both have, by products of value and presence matrices.

A block holds some entities' series side by side, with a zero and a mark where a date is missing. The sums that a pair's
correlation needs (numbers of common dates, sums, squares and products over them) are entries of five matrix products of
two blocks, so no row is made for a pair and a date. Blocks lie in groups, and a task takes two groups (or one with
itself): each pair of series is computed once, for both of them, and the k best of each are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .neighbours import Best
from .numbering import numbered_ids

#: Numbers in a block, and of a group (which a task holds) at most.
BLOCK_CELLS, GROUP_CELLS = 1 << 17, 12 << 20
#: Where a variance is below this share of the mean square its digits cancel out: such pairs are computed again from centred values.
CANCELS = 1e-4


def masked_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of ``x`` against rows of ``y``; NaN marks a missing date. 0 where a series is constant over the common dates, -inf with fewer than two."""
    a, b = ~np.isnan(x), ~np.isnan(y)
    # of each series its mean goes first: that changes no correlation and keeps the sums small
    u = np.where(a, x - np.nanmean(np.where(a.any(axis=1)[:, None], x, 0), axis=1, keepdims=True), 0.0)
    v = np.where(b, y - np.nanmean(np.where(b.any(axis=1)[:, None], y, 0), axis=1, keepdims=True), 0.0)
    a, b = a.astype(np.float64), b.astype(np.float64)
    n, su, sv = a @ b.T, u @ b.T, a @ v.T
    suu, svv, suv = (u * u) @ b.T, a @ (v * v).T, u @ v.T
    vu, vv = n * suu - su * su, n * svv - sv * sv
    doubtful = (vu <= CANCELS * n * suu) | (vv <= CANCELS * n * svv)
    r = np.where(doubtful, 0.0, (n * suv - su * sv) / np.sqrt(np.where(doubtful, 1.0, vu * vv)))
    i, j = np.nonzero(doubtful & (n > 1))
    step = max(1, (1 << 20) // max(1, x.shape[1]))
    for low in range(0, len(i), step):
        p, q = i[low : low + step], j[low : low + step]
        r[p, q] = centred_correlation(x[p], y[q])
    return np.where(n > 1, np.clip(r, -1.0, 1.0), -np.inf)


def centred_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row of ``x`` with the same row of ``y`` over their common dates (one at least); 0 only where all of a series' values there are equal."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = both.sum(axis=1)

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.where(both, v, -np.inf).max(axis=1) == np.where(both, v, np.inf).min(axis=1)
        d = np.where(both, v, 0.0)
        d = np.where(both, d - (d.sum(axis=1) / n)[:, None], 0.0)
        # the mean's own rounding goes too
        return np.where(both, d - (d.sum(axis=1) / n)[:, None], 0.0), flat

    (u, fu), (v, fv) = parts(x), parts(y)
    size = np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))
    flat = fu | fv | (size == 0)
    return np.where(flat, 0.0, (u * v).sum(axis=1) / np.where(flat, 1.0, size))


def correlated(long: DataFrame, id_col: str, at: str, value: str, k: int, min_corr: float | None = None, signed: bool = True) -> DataFrame:
    """src, dst, weight, rank: see ``graphs.correlation_edges``. One value an entity and date; dates number what a task can hold of one series."""
    kind = dict(long.dtypes)[id_col]
    x = cut(long.where(F.col(value).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(at).alias("t"), F.col(value).cast("double").alias("x")))
    spark = long.sparkSession
    names = numbered_ids(x, "id")
    dates = cut(numbered_ids(x.select("t"), "t"))
    n, width = names.count(), max(1, dates.count())
    rows = max(8, min(1024, BLOCK_CELLS // width, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, -(-n // rows))
    # a group goes to as many tasks as there are groups: few, but enough pairs of them for all cores
    groups = min(blocks, max(-(-blocks * rows * width // GROUP_CELLS), int(np.ceil(np.sqrt(6 * spark.sparkContext.defaultParallelism)))))
    cells = x.join(names, "id").join(dates.select(F.col("id").alias("t"), F.col("no").cast("int").alias("place")), "t").select("no", "place", "x")
    series = cells.groupBy("no").agg(F.collect_list(F.struct("place", "x")).alias("s")).select("no", F.transform("s", lambda s: s["place"]).alias("place"), F.transform("s", lambda s: s["x"]).alias("x"))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("no").combine_chunks()
        no = t.column("no").to_numpy()
        place, v = (t.column(c).combine_chunks() for c in ("place", "x"))
        m = np.full((len(no), width), np.nan)
        m[np.repeat(np.arange(len(no)), np.diff(place.offsets.to_numpy())), place.flatten().to_numpy()] = v.flatten().to_numpy()
        block = key[0].as_py()
        return pa.table([pa.array([block], pa.int64()), pa.ListArray.from_arrays([0, len(no)], pa.array(no)), pa.ListArray.from_arrays([0, m.size], pa.array(m.ravel()))], names=["block", "no", "x"])

    parts = cut(series.withColumn("block", F.pmod("no", F.lit(blocks))).groupBy("block").applyInArrow(pack, "block long, no array<long>, x array<double>"))
    of = F.col("block") % groups
    tile = lambda low, high: (low * groups + high).alias("tile")
    own = parts.select("*", of.alias("group"), F.explode(F.sequence(of, F.lit(groups - 1).cast("long"))).alias("other")).select(tile(F.col("group"), F.col("other")), F.lit(0).alias("side"), "block", "no", "x")
    theirs = parts.select("*", of.alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), of)).alias("other")).select(tile(F.col("other"), F.col("group")), F.lit(1).alias("side"), "block", "no", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, no, best = None, [], None, None

        def told(no: np.ndarray, best: Best) -> pa.RecordBatch:
            r, c = np.nonzero(best.weight > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(no[r]), pa.array(best.to[r, c]), pa.array(best.value[r, c] + 0.0)], ["src", "dst", "weight"])

        for batch in batches:
            for i in range(batch.num_rows):
                to, side = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = batch.column(3)[i].values.to_numpy()
                y = batch.column(4)[i].values.to_numpy().reshape(len(ids), -1)
                if to != group:
                    if best is not None:
                        yield told(no, best)
                    group, held, best = to, [], None
                if side == 0:
                    held.append((ids, y))
                    continue
                if best is None:
                    no, mine = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    best = Best(len(no), k, None)
                back = None if group // groups == group % groups else Best(len(ids), k, None)
                for low in range(0, len(no), 256):
                    weight = np.round(masked_correlation(mine[low : low + 256], y), 9)
                    score = weight if signed else np.where(weight > -np.inf, np.abs(weight), weight)
                    if min_corr is not None:
                        score = np.where(weight >= min_corr, score, -np.inf)
                    if back is not None:
                        back.add(0, ids, score.T.copy(), no[low : low + 256], weight.T)
                    best.add(low, no[low : low + 256], score, ids, weight)
                if back is not None:
                    yield told(ids, back)
        if best is not None:
            yield told(no, best)

    tiles = groups * (groups + 1) // 2
    found = own.unionByName(theirs).repartition(max(1, min(4096, 2 * tiles)), "tile").sortWithinPartitions("tile", "side", "block").mapInArrow(compare, "src long, dst long, weight double")
    order = Window.partitionBy("src").orderBy(F.desc("weight" if signed else F.abs("weight")), "dst")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    a, b = (names.select(F.col("no").alias(end), F.col("id").alias(f"_{end}")) for end in ("src", "dst"))
    return found.join(a, "src").join(b, "dst").select(F.col("_src").cast(kind).alias("src"), F.col("_dst").cast(kind).alias("dst"), "weight", "rank")
