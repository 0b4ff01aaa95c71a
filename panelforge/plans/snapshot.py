"""Point-in-time snapshots of all entities on all dates, in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import asof_join, membership_join


def stock_snapshot(
    daily: DataFrame,
    basic: DataFrame,
    dimension: DataFrame,
    members: DataFrame,
    events: DataFrame,
    key: str = "ts_code",
    at: str = "trade_date",
    announced: str = "ann_date",
    event_columns: Sequence[str] = ("roe",),
    member_columns: Sequence[str] = ("l1_name",),
    start: str | None = None,
    end: str | None = None,
    include_special: bool = False,
    include_suspended: bool = False,
    mark: str = "ST",
    tie: str | None = None,
) -> DataFrame:
    """Prices with valuation, dimension, membership valid at the date and the latest announced figures, and ``record_key``.

    Names with ``mark`` go unless ``include_special`` (missing names stay); rows without volume go unless
    ``include_suspended``. A date range filters the scans before anything is joined.
    """
    if start is not None:
        daily, basic = (x.where(F.col(at) >= start) for x in (daily, basic))
    if end is not None:
        daily, basic = (x.where(F.col(at) <= end) for x in (daily, basic))
        events = events.where(F.col(announced) <= end)
    x = daily.join(basic.drop(*[c for c in basic.columns if c in daily.columns and c not in (key, at)]), [key, at], "left")
    x = x.join(dimension.drop(*[c for c in dimension.columns if c in x.columns and c != key]), key, "left")
    if not include_special:
        x = x.where(~F.coalesce(F.contains(F.col("name"), F.lit(mark)), F.lit(False)))
    if not include_suspended:
        x = x.where("vol > 0")
    x = membership_join(x, members, key, at, member_columns)
    # what no row can match, and what nobody asks for, isn't shuffled
    events = events.select(*dict.fromkeys([key, announced, *event_columns, *([tie] if tie else [])]))
    x = asof_join(x, events, key, at, announced, event_columns, tie=tie)
    return x.withColumn("record_key", F.concat_ws("_", key, at))
