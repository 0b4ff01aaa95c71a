"""Per-entity time series: one shuffle on the entity serves all windows of a function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def _series(by: str, at: str):
    return Window.partitionBy(by).orderBy(at)


def returns(df: DataFrame, by: str, at: str, close: str = "close", periods: Sequence[int] = (1, 5, 20, 60, 120, 252)) -> DataFrame:
    """Adds ret_k = close / close k rows ago - 1 and reversal_k = -ret_k; NULL where either close is missing."""
    w = _series(by, at)
    c = F.col(close)
    df = df.withColumns({f"ret_{k}": c / F.nullif(F.lag(c, k).over(w), F.lit(0.0)) - 1 for k in periods})
    return df.withColumns({f"reversal_{k}": -F.col(f"ret_{k}") for k in periods})


def realized_vol(df: DataFrame, by: str, at: str, ret: str = "ret_1", windows: Sequence[int] = (20, 60)) -> DataFrame:
    """Sample deviation of returns over w rows, by year; NULL with fewer than max(w / 2, 5) returns."""

    def one(w: int) -> Column:
        frame = _series(by, at).rowsBetween(-(w - 1), 0)
        return F.when(F.count(ret).over(frame) >= max(w // 2, 5), F.stddev_samp(ret).over(frame) * F.lit(YEAR**0.5))

    return df.withColumns({f"realized_vol_{w}": one(w) for w in windows})


def downside_vol(df: DataFrame, by: str, at: str, ret: str = "ret_1", windows: Sequence[int] = (20, 60)) -> DataFrame:
    """As ``realized_vol`` over the w latest rows with a negative return; NULL on other rows. The sign joins the partition key, so nothing is joined back."""
    falls = F.coalesce(F.col(ret) < 0, F.lit(False))
    df = df.withColumn("_falls", falls)

    def one(w: int) -> Column:
        frame = Window.partitionBy(by, "_falls").orderBy(at).rowsBetween(-(w - 1), 0)
        return F.when(F.col("_falls") & (F.count(ret).over(frame) >= max(w // 2, 5)), F.stddev_samp(ret).over(frame) * F.lit(YEAR**0.5))

    return df.withColumns({f"downside_vol_{w}": one(w) for w in windows}).drop("_falls")


def max_drawdown(df: DataFrame, by: str, at: str, close: str = "close", windows: Sequence[int] = (20, 60)) -> DataFrame:
    """Least of close / rolling peak - 1 over w rows."""
    for w in windows:
        frame = _series(by, at).rowsBetween(-(w - 1), 0)
        df = df.withColumn("_fall", F.col(close) / F.max(close).over(frame) - 1)
        df = df.withColumn(f"max_drawdown_{w}", F.min("_fall").over(frame)).drop("_fall")
    return df


def price_range(df: DataFrame, by: str, at: str, high: str = "high", low: str = "low", close: str = "close", w: int = 20) -> DataFrame:
    """(highest - lowest) / close over w full rows."""
    frame = _series(by, at).rowsBetween(-(w - 1), 0)
    full = (F.count(high).over(frame) == w) & (F.count(low).over(frame) == w)
    return df.withColumn(f"range_{w}", F.when(full, (F.max(high).over(frame) - F.min(low).over(frame)) / F.col(close)))


def return_features(df: DataFrame, by: str, at: str, close: str = "close", high: str = "high", low: str = "low") -> DataFrame:
    """All of the above and log_close. What goes by the sign comes last, as it sorts the rows again: a task holds two orders of its rows and not three."""
    df = returns(df, by, at, close)
    df = realized_vol(df.withColumn("log_close", F.when(F.col(close) > 0, F.ln(close))), by, at)
    names = df.columns
    df = downside_vol(price_range(max_drawdown(df, by, at, close), by, at, high, low, close), by, at)
    falls = [c for c in df.columns if c.startswith("downside_vol_") and c not in names]
    return df.select(*names, *falls, *[c for c in df.columns if c not in names and c not in falls])


def moving_average(df: DataFrame, by: str, at: str, value: str, w: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(_series(by, at).rowsBetween(-(w - 1), 0)))


def momentum_volume(df: DataFrame, by: str, at: str, close: str = "close", vol: str = "vol") -> DataFrame:
    """Returns over 1, 5 and 20 rows and volume against its 20-row mean."""
    w = _series(by, at)
    c = F.col(close)
    out = {f"ret_{k}": c / F.nullif(F.lag(c, k).over(w), F.lit(0.0)) - 1 for k in (1, 5, 20)}
    out["volume_ratio"] = F.col(vol) / F.nullif(F.avg(vol).over(w.rowsBetween(-19, 0)), F.lit(0.0))
    return df.withColumns(out)


def bars(df: DataFrame, by: str, at: str, unit: str = "week", opened: str = "open", high: str = "high", low: str = "low", close: str = "close", vol: str = "vol") -> DataFrame:
    """OHLCV bars by calendar unit, in one aggregation."""
    return df.groupBy(by, F.date_trunc(unit, at).cast("date").alias("bar")).agg(
        F.min_by(opened, at).alias("open"), F.max(high).alias("high"), F.min(low).alias("low"), F.max_by(close, at).alias("close"), F.sum(vol).alias("vol"), F.count("*").alias("n_rows")
    )


def market_return(df: DataFrame, at: str, ret: str = "ret_1") -> DataFrame:
    """Equal-weighted mean return of each date: one row a date."""
    return df.groupBy(at).agg(F.avg(ret).alias("market"))


def with_market(df: DataFrame, at: str, ret: str = "ret_1") -> DataFrame:
    """Adds the equal-weighted mean return of the row's date. Dates are few, so their means are broadcast and rows stay where they are."""
    means = market_return(df, at, ret).withColumnRenamed(at, "_at")
    return df.join(F.broadcast(means), F.col(at).eqNullSafe(F.col("_at")), "left").drop("_at")


def _moments(over, x: Column, y: Column) -> Column:
    """Count, means, and sums of squares of x and of products about the means."""
    n = F.count(x).over(over)
    return F.struct(n.alias("n"), F.avg(x).over(over).alias("x"), F.avg(y).over(over).alias("y"), (F.var_pop(x).over(over) * n).alias("xx"), (F.covar_pop(x, y).over(over) * n).alias("xy"))


def beta(df: DataFrame, market: DataFrame | None, by: str, at: str, ret: str = "ret_1", window: int = YEAR) -> DataFrame:
    """Rolling covariance with the market over its rolling variance, both over the same rows; 0 where the variance is 0. Without ``market`` it is the mean of all rows of a date.

    A sliding frame would go over ``window`` rows for each row. A series is cut into blocks of ``window`` rows instead, so
    a row's window is the end of the block before and the start of its own: moments of both are running ones, and two
    are put together about their common mean, so nothing is subtracted and no value outside the window counts.
    """
    names = [*df.columns, "market"]
    x = with_market(df, at, ret) if market is None else df.join(market, at, "left")
    both = F.col(ret).isNotNull() & F.col("market").isNotNull()
    x = x.withColumn("_i", F.row_number().over(_series(by, at)) - 1).withColumns({"_block": F.floor(F.col("_i") / window), "_m": F.when(both, F.col("market")), "_r": F.when(both, F.col(ret))})
    block, m, r = Window.partitionBy(by, "_block"), F.col("_m"), F.col("_r")
    running = (Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_end", _moments(block.orderBy(F.desc("_i")).rowsBetween(*running), m, r))
    x = x.withColumn("_start", _moments(block.orderBy("_i").rowsBetween(*running), m, r))
    # a block's last row has its whole window in the block
    before = F.lag("_end", window - 1).over(Window.partitionBy(by).orderBy("_block", "_i"))
    x = x.withColumn("_end", F.when(F.col("_i") % window != window - 1, before))
    a, b = F.col("_end"), F.col("_start")
    shift = a["n"] * b["n"] / F.nullif(a["n"] + b["n"], F.lit(0)) * (b["x"] - a["x"])
    one = F.when(a["n"] > 0, a).otherwise(b)
    two = (a["n"] > 0) & (b["n"] > 0)
    xx = F.when(two, a["xx"] + b["xx"] + shift * (b["x"] - a["x"])).otherwise(one["xx"])
    xy = F.when(two, a["xy"] + b["xy"] + shift * (b["y"] - a["y"])).otherwise(one["xy"])
    return x.withColumn("beta", F.when(xx == 0, 0.0).otherwise(xy / xx)).select(*names, "beta")


def latest_price_features(df: DataFrame, by: str, at: str, close: str = "close", vol: str = "vol", amount: str = "amount", windows: Sequence[int] = (5, 20, 60, 120, 252)) -> DataFrame:
    """One row an entity at its last date: returns over w rows (since the first row if there are fewer, 0 with one), population volatility by year, momentum, reversal and mean activity."""
    every = Window.partitionBy(by).orderBy(at)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = F.col(close)
    x = df.withColumns({"_n": F.count("*").over(whole), "_i": F.row_number().over(every), "_first": F.first(c).over(whole), "_ret": F.coalesce(c / F.nullif(F.lag(c).over(every), F.lit(0.0)) - 1, F.lit(0.0))})
    cols = {f"ret_{w}": F.when(F.col("_n") > w, c / F.nullif(F.lag(c, w).over(every), F.lit(0.0)) - 1).when(F.col("_n") == w, 0.0).otherwise(c / F.nullif(F.col("_first"), F.lit(0.0)) - 1) for w in windows}
    cols |= {f"vol_{w}": F.stddev_pop("_ret").over(every.rowsBetween(-(w - 1), 0)) * F.lit(YEAR**0.5) for w in (20, 60)}
    cols |= {"mean_vol_20": F.avg(vol).over(every.rowsBetween(-19, 0)), "mean_amount_20": F.avg(amount).over(every.rowsBetween(-19, 0))}
    x = x.withColumns(cols).where("_i = _n")
    x = x.withColumns({"momentum": F.col("ret_252") - F.col("ret_20"), "reversal": -F.col("ret_20")})
    return x.select(by, at, *[f"ret_{w}" for w in windows], "vol_20", "vol_60", "momentum", "reversal", "mean_vol_20", "mean_amount_20")


def returns_matrix(df: DataFrame, by: str, at: str, close: str = "close", dates: int = 60) -> DataFrame:
    """Long (entity, date, ret) over the last ``dates`` dates of the market; missing cells are 0. Dates are few, so their list is broadcast."""
    w = _series(by, at)
    r = df.select(by, at, (F.col(close) / F.nullif(F.lag(close).over(w), F.lit(0.0)) - 1).alias("ret"))
    last = df.select(at).distinct().orderBy(F.desc(at)).limit(dates)
    cells = df.select(by).distinct().join(F.broadcast(last))
    return cells.join(r, [by, at], "left").select(by, at, F.coalesce("ret", F.lit(0.0)).alias("ret"))
