"""Time series: returns, volatility, drawdown, bars, beta, price features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog_queries import query
from ..operators import relational as rel
from ..operators import timeseries as ts
from .base import ENTITIES, PANEL, entities, load, panel, r, rounded, with_

RET = "ret as (select *, close / nullif(lag(close, 1) over (partition by ent order by day), 0) - 1 as ret_1 from panel)"


def _sql(columns: str, *parts: str, source: str = "ret", where: str = "") -> str:
    return with_(PANEL, RET, *parts) + f"select ent, cast(day as varchar) as day, {columns} from {source} {where}"


def _rets(periods=(1, 5, 20, 60, 120, 252)) -> str:
    return ", ".join(f"round(close / nullif(lag(close, {k}) over (partition by ent order by day), 0) - 1, 6) + 0.0 as ret_{k}, round(-(close / nullif(lag(close, {k}) over (partition by ent order by day), 0) - 1), 6) + 0.0 as reversal_{k}" for k in periods)


@query("w1_returns", _sql(_rets()))
def w1_returns(spark, d):
    x = ts.returns(panel(spark, d), "ent", "day")
    return rounded(x.select("ent", "day", *[f"{n}_{k}" for k in (1, 5, 20, 60, 120, 252) for n in ("ret", "reversal")]))


def _vol(w: int, over: str = "partition by ent order by day") -> str:
    frame = f"({over} rows between {w - 1} preceding and current row)"
    return f"case when count(ret_1) over {frame} >= {max(w // 2, 5)} then stddev_samp(ret_1) over {frame} * sqrt(252.0) end"


@query("w2_realized_vol", _sql(", ".join(f"round({_vol(w)}, 6) + 0.0 as realized_vol_{w}" for w in (20, 60))))
def w2_realized_vol(spark, d):
    x = ts.realized_vol(ts.returns(panel(spark, d), "ent", "day", periods=[1]), "ent", "day")
    return rounded(x.select("ent", "day", "realized_vol_20", "realized_vol_60"))


@query("w3_downside_vol", _sql(", ".join(f"round(case when falls then {_vol(w, 'partition by ent, falls order by day')} end, 6) + 0.0 as downside_vol_{w}" for w in (20, 60)), "f as (select *, coalesce(ret_1 < 0, false) as falls from ret)", source="f"))
def w3_downside_vol(spark, d):
    x = ts.downside_vol(ts.returns(panel(spark, d), "ent", "day", periods=[1]), "ent", "day")
    return rounded(x.select("ent", "day", "downside_vol_20", "downside_vol_60"))


@query(
    "w4_max_drawdown",
    _sql(
        "round(min(f) over (partition by ent order by day rows between 19 preceding and current row), 6) + 0.0 as max_drawdown_20",
        "f as (select *, close / max(close) over (partition by ent order by day rows between 19 preceding and current row) - 1 as f from panel)",
        source="f",
    ),
)
def w4_max_drawdown(spark, d):
    return rounded(ts.max_drawdown(panel(spark, d), "ent", "day", windows=[20]).select("ent", "day", "max_drawdown_20"))


@query("w5_price_range", _sql("round(case when count(high) over w = 20 then (max(high) over w - min(low) over w) / close end, 6) + 0.0 as range_20", source="panel", where="window w as (partition by ent order by day rows between 19 preceding and current row)"))
def w5_price_range(spark, d):
    return rounded(ts.price_range(panel(spark, d), "ent", "day").select("ent", "day", "range_20"))


@query("w6_log_close", _sql("round(ln(close), 6) + 0.0 as log_close", source="panel"))
def w6_log_close(spark, d):
    return rounded(panel(spark, d).select("ent", "day", F.ln("close").alias("log_close")))


LATEST = """x as (select *, count(*) over (partition by ent) as n, row_number() over (partition by ent order by day) as i,
    first_value(close) over (partition by ent order by day) as f, coalesce(close / nullif(lag(close) over (partition by ent order by day), 0) - 1, 0.0) as rr from panel),
  y as (select *, {rets},
    stddev_pop(rr) over (partition by ent order by day rows between 19 preceding and current row) * sqrt(252.0) as vol_20,
    stddev_pop(rr) over (partition by ent order by day rows between 59 preceding and current row) * sqrt(252.0) as vol_60,
    avg(vol) over (partition by ent order by day rows between 19 preceding and current row) as mean_vol_20,
    avg(amount) over (partition by ent order by day rows between 19 preceding and current row) as mean_amount_20 from x)"""


@query(
    "b7_latest_price_features",
    with_(PANEL, LATEST.format(rets=", ".join(f"case when n > {w} then close / nullif(lag(close, {w}) over (partition by ent order by day), 0) - 1 when n = {w} then 0.0 else close / nullif(f, 0) - 1 end as ret_{w}" for w in (5, 20, 60, 120, 252))))
    + "select ent, cast(day as varchar) as day, "
    + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ("ret_5", "ret_20", "ret_60", "ret_120", "ret_252", "vol_20", "vol_60", "mean_vol_20"))
    + ", round(ret_252 - ret_20, 6) + 0.0 as momentum, round(-ret_20, 6) + 0.0 as reversal, round(mean_amount_20, 6) + 0.0 as mean_amount_20 from y where i = n",
)
def b7_latest_price_features(spark, d):
    return rounded(ts.latest_price_features(panel(spark, d), "ent", "day"))


@query(
    "w8_returns_matrix",
    with_(PANEL, "r as (select ent, day, close / nullif(lag(close) over (partition by ent order by day), 0) - 1 as ret from panel)", "t as (select distinct day from panel order by day desc limit 60)", "e as (select distinct ent from panel)")
    + "select e.ent, cast(t.day as varchar) as day, round(coalesce(r.ret, 0), 6) + 0.0 as ret from e cross join t left join r on r.ent = e.ent and r.day = t.day",
)
def w8_returns_matrix(spark, d):
    return rounded(ts.returns_matrix(panel(spark, d), "ent", "day", dates=60))


@query("w12_moving_average", _sql("round(avg(close) over (partition by ent order by day rows between 19 preceding and current row), 6) + 0.0 as ma_20", source="panel"))
def w12_moving_average(spark, d):
    return rounded(ts.moving_average(panel(spark, d), "ent", "day", "close", 20, "ma_20").select("ent", "day", "ma_20"))


@query("w13_momentum_volume", _sql(", ".join(f"round(close / nullif(lag(close, {k}) over (partition by ent order by day), 0) - 1, 6) + 0.0 as ret_{k}" for k in (1, 5, 20)) + ", round(vol / nullif(avg(vol) over (partition by ent order by day rows between 19 preceding and current row), 0), 6) + 0.0 as volume_ratio", source="panel"))
def w13_momentum_volume(spark, d):
    return rounded(ts.momentum_volume(panel(spark, d), "ent", "day").select("ent", "day", "ret_1", "ret_5", "ret_20", "volume_ratio"))


FACTORS = """f as (select ent, day, close / nullif(lag(close, 20) over (partition by ent order by day), 0) - 1 as momentum, vol / nullif(avg(vol) over (partition by ent order by day rows between 19 preceding and current row), 0) as activity,
    (high - low) / close as spread from panel),
  s as (select *, 0.5 * momentum + 0.3 * activity - 0.2 * spread as raw, round(0.5 * momentum + 0.3 * activity - 0.2 * spread, 9) as score from f where momentum is not null)"""


@query(
    "w14_composite_score",
    with_(PANEL, FACTORS)
    + """select ent, cast(day as varchar) as day, round(raw, 6) + 0.0 as score, row_number() over (partition by day order by score desc, ent) as rank_score,
  row_number() over (partition by day order by round(momentum, 9) desc, ent) as rank_momentum, row_number() over (partition by day order by round(activity, 9) desc, ent) as rank_activity from s""",
)
def w14_composite_score(spark, d):
    """Weighted score and ranks by several orders (of the score to 9 digits): one shuffle by date serves all."""
    return rounded(_ranked(spark, d))


def _ranked(spark, d):
    from pyspark.sql import Window

    x = ts.momentum_volume(panel(spark, d), "ent", "day")
    x = x.select("ent", "day", F.col("ret_20").alias("momentum"), F.col("volume_ratio").alias("activity"), ((F.col("high") - F.col("low")) / F.col("close")).alias("spread")).where("momentum is not null")
    x = x.withColumn("score", 0.5 * F.col("momentum") + 0.3 * F.col("activity") - 0.2 * F.col("spread"))
    w = Window.partitionBy("day")
    rank = lambda c: F.row_number().over(w.orderBy(F.round(c, 9).desc(), "ent"))
    return x.select("ent", "day", "score", rank("score").alias("rank_score"), rank("momentum").alias("rank_momentum"), rank("activity").alias("rank_activity"))


@query("w15_neutral_momentum", with_(PANEL, ENTITIES, FACTORS) + "select s.ent, cast(day as varchar) as day, round(momentum - avg(momentum) over g, 6) + 0.0 as momentum_neutral, round(activity / nullif(avg(activity) over g, 0), 6) + 0.0 as activity_relative from s join entities e on s.ent = e.ent window g as (partition by day, l1)")
def w15_neutral_momentum(spark, d):
    from pyspark.sql import Window

    x = ts.momentum_volume(panel(spark, d), "ent", "day").where("ret_20 is not null").join(F.broadcast(entities(spark, d)), "ent")
    g = Window.partitionBy("day", "l1")
    return rounded(x.select("ent", "day", (F.col("ret_20") - F.avg("ret_20").over(g)).alias("momentum_neutral"), (F.col("volume_ratio") / F.nullif(F.avg("volume_ratio").over(g), F.lit(0.0))).alias("activity_relative")))


@query("w16_portfolio", with_(PANEL, FACTORS) + "select ent, cast(day as varchar) as day, row_number() over (partition by day order by score desc, ent) as rank from s qualify rank <= 20")
def w16_portfolio(spark, d, expression: str = "0.5 * momentum + 0.3 * activity - 0.2 * spread"):
    """The best of each date by a free expression."""
    x = ts.momentum_volume(panel(spark, d), "ent", "day")
    x = x.select("ent", "day", F.col("ret_20").alias("momentum"), F.col("volume_ratio").alias("activity"), ((F.col("high") - F.col("low")) / F.col("close")).alias("spread")).where("momentum is not null")
    top = rel.top_per_group(x.withColumn("_s", F.round(F.expr(expression), 9)), ["day"], [F.desc("_s"), F.col("ent")], 20)
    return rounded(top.select("ent", "day", "rank"))


@query("w17_factors_at_date", with_(PANEL, FACTORS) + "select ent, round(momentum, 6) + 0.0 as momentum, round(activity, 6) + 0.0 as activity, round(raw, 6) + 0.0 as score from s where day = date '1997-06-16'")
def w17_factors_at_date(spark, d):
    """Windows first, the date afterwards."""
    x = ts.momentum_volume(panel(spark, d), "ent", "day").where("ret_20 is not null and day = date '1997-06-16'")
    score = 0.5 * F.col("ret_20") + 0.3 * F.col("volume_ratio") - 0.2 * ((F.col("high") - F.col("low")) / F.col("close"))
    return rounded(x.select("ent", F.col("ret_20").alias("momentum"), F.col("volume_ratio").alias("activity"), score.alias("score")))


@query("w18_flow_ratios", "select l_suppkey as ent, round(sum(case when l_returnflag = 'R' then l_extendedprice else 0 end) / nullif(sum(l_extendedprice), 0), 6) + 0.0 as back_share, round((sum(case when l_quantity >= 40 then l_extendedprice else 0 end) - sum(case when l_quantity < 10 then l_extendedprice else 0 end)) / nullif(sum(l_extendedprice), 0), 6) + 0.0 as large_net from lineitem group by 1")
def w18_flow_ratios(spark, d):
    e, q = F.col("l_extendedprice"), F.col("l_quantity")
    total = F.nullif(F.sum(e), F.lit(0.0))
    return rounded(load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("ent")).agg((F.sum(F.when(F.col("l_returnflag") == "R", e).otherwise(0.0)) / total).alias("back_share"), ((F.sum(F.when(q >= 40, e).otherwise(0.0)) - F.sum(F.when(q < 10, e).otherwise(0.0))) / total).alias("large_net")))


@query("a16_weekly_bars", with_(PANEL) + "select ent, cast(cast(date_trunc('week', day) as date) as varchar) as bar, round(arg_min(open, day), 6) + 0.0 as open, round(max(high), 6) + 0.0 as high, round(min(low), 6) + 0.0 as low, round(arg_max(close, day), 6) + 0.0 as close, sum(vol) as vol, count(*) as n_rows from panel group by 1, 2")
def a16_weekly_bars(spark, d):
    return rounded(ts.bars(panel(spark, d), "ent", "day"))


@query(
    "b10_beta",
    with_(PANEL, RET, "m as (select day, avg(ret_1) as market from ret group by 1)", "x as (select ret.ent, ret.day, case when market is not null then ret_1 end as a, case when ret_1 is not null then market end as b from ret left join m on ret.day = m.day)")
    + "select ent, cast(day as varchar) as day, round(case when var_pop(b) over w = 0 then 0 else covar_pop(a, b) over w / var_pop(b) over w end, 5) + 0.0 as beta from x window w as (partition by ent order by day rows between 251 preceding and current row)",
)
def b10_beta(spark, d):
    """Covariance with the equal-weighted market over its variance, both over the last 252 rows."""
    x = ts.returns(panel(spark, d), "ent", "day", periods=[1])
    return ts.beta(x, None, "ent", "day").select("ent", F.col("day").cast("string").alias("day"), r("beta", 5).alias("beta"))


def _b6() -> str:
    falls = "f as (select *, coalesce(ret_1 < 0, false) as falls from ret)"
    over = "(partition by ent order by day rows between {} preceding and current row)"
    peaks = "p as (select *, " + ", ".join(f"close / max(close) over {over.format(w - 1)} - 1 as fall_{w}" for w in (20, 60)) + " from f)"
    columns = ", ".join(f"round({_vol(w)}, 6) + 0.0 as realized_vol_{w}, round(case when falls then {_vol(w, 'partition by ent, falls order by day')} end, 6) + 0.0 as downside_vol_{w}, round(min(fall_{w}) over {over.format(w - 1)}, 6) + 0.0 as max_drawdown_{w}" for w in (20, 60))
    spread = over.format(19)
    columns += f", round(case when close > 0 then ln(close) end, 6) + 0.0 as log_close, round(case when count(high) over {spread} = 20 then (max(high) over {spread} - min(low) over {spread}) / close end, 6) + 0.0 as range_20"
    return _sql(_rets() + ", " + columns + ", " + ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in ("open", "high", "low", "close", "vol", "amount")), falls, peaks, source="p")


@query("b6_return_features", _b6())
def b6_return_features(spark, d):
    """All return features in one table."""
    return rounded(ts.return_features(panel(spark, d), "ent", "day"))


@query("x_stream_event_bars", "select event_type, cast(date_trunc('hour', ts) as varchar) as bar, count(*) as n, round(sum(value), 4) + 0.0 as total, round(min(value), 6) + 0.0 as low, round(max(value), 6) + 0.0 as high from events group by 1, 2")
def x_stream_event_bars(spark, d):
    """Event-time bars; the same function runs on a stream."""
    from ..streaming.ingest import event_bars

    x = event_bars(load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    return x.select("event_type", F.date_format("bar", "yyyy-MM-dd HH:mm:ss").alias("bar"), "n", r("total", 4).alias("total"), r("low").alias("low"), r("high").alias("high"))
