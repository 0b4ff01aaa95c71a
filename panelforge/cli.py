"""Command line.

``list``, ``query`` and ``explain`` work on the registered queries over ``--data``. ``check`` reads the configured records and
looks at their columns; ``run`` and ``smoke`` run the semantic job on them; ``staged`` and ``research`` run the staged job of a
date over the configured warehouse, ``--until`` a stage, and ``research`` also writes the exports.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import queries  # noqa: F401  (registers the queries)
from .catalog_queries import QUERIES
from .errors import InvalidValue
from .operators import timeseries as ts
from .plans.research import semantic_stages
from .plans.snapshot import stock_snapshot
from .plans.staged import StagedJob, research_exports
from .plans.stages import run_stages
from .sources import io
from .sources.catalog import Warehouse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="panelforge", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name in ("query", "explain"):
        q = commands.add_parser(name)
        q.add_argument("--data", required=True)
        q.add_argument("--query", required=True)
        q.add_argument("--out", default="")
    for name in ("check", "run", "smoke"):
        commands.add_parser(name).add_argument("--config", required=True)
    for name in ("staged", "research"):
        s = commands.add_parser(name)
        s.add_argument("--config", required=True)
        s.add_argument("--trade-date", required=True)
        s.add_argument("--cluster-method", choices=["kmeans", "density", "leiden", "louvain"], default="kmeans")
        s.add_argument("--k-semantic", type=int, default=30)
        s.add_argument("--until", default="")
        s.add_argument("--resume", action="store_true")
    return p


def staged_job(spark: SparkSession, config: dict, date: str, method: str, k_semantic: int) -> StagedJob:
    """The job of a date over the configured warehouse; bars reach as far back as the price features look."""
    paths, settings = config["paths"], config.get("staged", {})
    w = Warehouse(spark, paths["warehouse"])
    snap = stock_snapshot(
        w.table("fact_stock_daily"), w.table("fact_stock_daily_basic"), w.table("fact_stock_basic_snapshot"), w.table("fact_stock_sw_member"), w.table("fact_stock_fina_indicator"),
        event_columns=settings.get("figures", ["roe", "roa", "roic", "grossprofit_margin", "netprofit_margin", "debt_to_assets", "assets_to_eqt", "netprofit_yoy", "or_yoy", "basic_eps_yoy", "ocf_to_profit", "salescash_to_or"]),
        member_columns=["l1_name", "l2_name", "l3_name"], start=date, end=date, tie="end_date",
    )
    bars = w.daily(end=date)
    prices = ts.latest_price_features(bars, "ts_code", "trade_date").withColumnsRenamed({"vol_20": "realized_vol_20d", "vol_60": "realized_vol_60d", "momentum": "momentum_raw", "ret_20": "ret_20d"})
    snap = snap.join(prices.select("ts_code", "realized_vol_20d", "realized_vol_60d", "momentum_raw", "ret_20d"), "ts_code", "left")
    views, missing = {}, []
    if root := paths.get("vectors"):
        found, missing = io.available_views(spark, root, settings.get("views", ["full_text", "profile_text", "product_text", "raw_json"]))
        if found is not None:
            for v in [r[0] for r in found.select("view").distinct().collect()]:
                views[v] = found.where(F.col("view") == v).select(F.regexp_replace("record_id", "_.*", "").alias("ts_code"), "embedding")
    return StagedJob(snap, bars, views, method=method, k_semantic=k_semantic, least_rows=int(settings.get("least_rows", 4001)))


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO)
    if a.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = SparkSession.builder.appName("panelforge").getOrCreate()
    if a.command in ("query", "explain"):
        if a.query not in QUERIES:
            raise InvalidValue(f"unknown query {a.query}")
        df = QUERIES[a.query](spark, a.data)
        if a.command == "explain":
            df.explain("formatted")
        elif a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(50, truncate=False)
        return 0
    config = io.load_config(a.config)
    if a.command in ("check", "run", "smoke"):
        records = io.checked_records(io.read_records(spark, config["paths"]["records"]))
        print(f"check ok | rows={records.count()} cols={len(records.columns)}")
        if a.command != "check":
            s = config.get("semantic", {})
            views = s.get("views", {"text": ["full_text"]})
            stages = semantic_stages(records, "record_id", views, s.get("weights", {}), s.get("anchors", ["biz_form", "customer_side", "chain_level"]), int(s.get("k", 10)), int(s.get("clusters", 10)), int(s.get("text_size", 32)))
            done = run_stages(spark, stages, config["paths"]["output"])
            print(f"{a.command} complete | rows={done['result'].count()}")
        return 0
    root = f"{config['paths']['output'].rstrip('/')}/{a.trade_date}"
    job = staged_job(spark, config, a.trade_date, a.cluster_method, a.k_semantic)
    stages = job.stages()
    if a.until:
        names = [s.name for s in stages]
        if a.until not in names:
            raise InvalidValue(f"no stage {a.until}; stages are {', '.join(names)}")
        stages = stages[: names.index(a.until) + 1]
    done = run_stages(spark, stages, root, resume=a.resume)
    if a.command == "research" and not a.until:
        io.write_tables(research_exports(job, done), f"{root}/exports")
        io.write_report(done["report"].select("report"), f"{root}/exports/report")
    print(f"{a.command} complete | trade_date={a.trade_date} | stages={len(done)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
