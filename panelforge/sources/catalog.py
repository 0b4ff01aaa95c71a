"""Declared tables: names, keys, columns; scans with checked projections and pushed-down filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidValue, MissingArtifact


@dataclass(frozen=True)
class TableSpec:
    """A table's declaration. ``fields`` are (name, SQL type)."""

    name: str
    keys: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]
    dates: tuple[str, ...] = ()
    partitions: tuple[str, ...] = ()
    description: str = ""

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in self.fields))

    @property
    def columns(self) -> list[str]:
        return [n for n, _ in self.fields]


#: Tables, keys, column names and types of the equity warehouse.
TABLES = (
    TableSpec(
        "fact_stock_daily",
        ("ts_code", "trade_date"),
        (
            ("ts_code", "string"),
            ("trade_date", "string"),
            ("open", "float"),
            ("high", "float"),
            ("low", "float"),
            ("close", "float"),
            ("pre_close", "float"),
            ("change", "float"),
            ("pct_chg", "float"),
            ("vol", "float"),
            ("amount", "float"),
        ),
        ("trade_date",),
        ("trade_date",),
        "daily bars",
    ),
    TableSpec(
        "fact_stock_daily_basic",
        ("ts_code", "trade_date"),
        (
            ("ts_code", "string"),
            ("trade_date", "string"),
            ("close", "float"),
            ("turnover_rate", "float"),
            ("turnover_rate_f", "float"),
            ("volume_ratio", "float"),
            ("pe", "float"),
            ("pe_ttm", "float"),
            ("pb", "float"),
            ("ps", "float"),
            ("ps_ttm", "float"),
            ("dv_ratio", "float"),
            ("dv_ttm", "float"),
            ("total_share", "float"),
            ("float_share", "float"),
            ("free_share", "float"),
            ("total_mv", "float"),
            ("circ_mv", "float"),
        ),
        ("trade_date",),
        ("trade_date",),
        "daily valuation",
    ),
    TableSpec(
        "fact_stock_fina_indicator",
        ("ts_code", "ann_date", "end_date"),
        (
            ("ts_code", "string"),
            ("ann_date", "string"),
            ("end_date", "string"),
            ("eps", "double"),
            ("dt_eps", "double"),
            ("profit_dedt", "double"),
            ("gross_margin", "double"),
            ("current_ratio", "double"),
            ("quick_ratio", "double"),
            ("roe", "double"),
            ("roe_waa", "double"),
            ("roa", "double"),
            ("roic", "double"),
            ("debt_to_assets", "double"),
            ("grossprofit_margin", "double"),
            ("netprofit_margin", "double"),
            ("profit_to_gr", "double"),
            ("tr_yoy", "double"),
            ("or_yoy", "double"),
            ("netprofit_yoy", "double"),
            ("dt_netprofit_yoy", "double"),
            ("basic_eps_yoy", "double"),
            ("q_sales_yoy", "double"),
            ("q_profit_yoy", "double"),
            ("ocf_to_or", "double"),
            ("ocf_to_profit", "double"),
            ("salescash_to_or", "double"),
            ("assets_to_eqt", "double"),
            ("ocfps", "double"),
            ("cfps", "double"),
            ("fcff", "double"),
            ("fcfe", "double"),
            ("update_flag", "string"),
        ),
        ("ann_date", "end_date"),
        ("ann_date",),
        "financial indicators, valid from their announcement",
    ),
    TableSpec(
        "fact_stock_sw_member",
        ("ts_code", "in_date"),
        (
            ("l1_code", "string"),
            ("l1_name", "string"),
            ("l2_code", "string"),
            ("l2_name", "string"),
            ("l3_code", "string"),
            ("l3_name", "string"),
            ("ts_code", "string"),
            ("name", "string"),
            ("in_date", "string"),
            ("out_date", "int"),
            ("is_new", "string"),
            ("snapshot_date", "bigint"),
        ),
        ("in_date",),
        (),
        "three-level industry membership",
    ),
    TableSpec(
        "fact_stock_basic_snapshot",
        ("ts_code",),
        (
            ("ts_code", "string"),
            ("symbol", "string"),
            ("name", "string"),
            ("area", "string"),
            ("industry", "string"),
            ("cnspell", "string"),
            ("market", "string"),
            ("list_date", "string"),
            ("act_name", "string"),
            ("act_ent_type", "string"),
        ),
        (),
        (),
        "stock dimension",
    ),
)
CATALOG: dict[str, TableSpec] = {t.name: t for t in TABLES}

Filters = Mapping[str, object]


class Warehouse:
    """Tables of a folder of Parquet datasets, or of the session's catalog where no folder is given."""

    def __init__(self, spark: SparkSession, path: str | None = None, catalog: Mapping[str, TableSpec] | None = None):
        self.spark, self.path, self.catalog = spark, path, dict(CATALOG if catalog is None else catalog)

    def list_tables(self) -> list[str]:
        return sorted(self.catalog)

    def spec(self, name: str) -> TableSpec:
        if name not in self.catalog:
            raise InvalidValue(f"unknown table {name}")
        return self.catalog[name]

    def register(self, spec: TableSpec, df: DataFrame | None = None) -> None:
        """Declare a table; a DataFrame given with it becomes a view of that name."""
        self.catalog[spec.name] = spec
        if df is not None:
            df.createOrReplaceTempView(spec.name)

    def table(self, name: str) -> DataFrame:
        self.spec(name)
        if self.path is None:
            if not self.spark.catalog.tableExists(name):
                raise MissingArtifact(name)
            return self.spark.table(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def fetch(self, name: str, columns: Sequence[str] | None = None, filters: Filters | None = None, low: Filters | None = None, high: Filters | None = None, order_by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        """Projection (checked against the declaration), equality or IN filters, inclusive bounds, order and limit.

        An empty list selects nothing; NULL as a value selects the NULLs. All filters reach the Parquet scan.
        """
        spec = self.spec(name)
        asked = [*(columns or spec.columns), *(filters or {}), *(low or {}), *(high or {}), *order_by]
        if unknown := [c for c in dict.fromkeys(asked) if c not in spec.columns]:
            raise InvalidValue(f"{name} has no columns {', '.join(unknown)}")
        df = self.table(name)
        terms = []
        for c, v in (filters or {}).items():
            terms.append(F.col(c).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(c).isNull() if v is None else F.col(c) == v)
        terms += [F.col(c) >= v for c, v in (low or {}).items()] + [F.col(c) <= v for c, v in (high or {}).items()]
        if terms:
            df = df.where(reduce(lambda a, b: a & b, terms))
        df = df.select(*(columns or [c for c in spec.columns if c in df.columns]))
        if order_by:
            df = df.orderBy(*order_by)
        return df if limit is None else df.limit(limit)

    def daily(self, codes: Sequence[str] | None = None, start: str | None = None, end: str | None = None, date: str | None = None, name: str = "fact_stock_daily", key: str = "ts_code", at: str = "trade_date") -> DataFrame:
        """Price or valuation rows by code and date range, in key order."""
        filters = ({key: list(codes)} if codes is not None else {}) | ({at: date} if date else {})
        return self.fetch(name, filters=filters, low={at: start} if start else None, high={at: end} if end else None, order_by=[key, at])

    def inventory(self) -> DataFrame:
        """table_name and whether its data is there, for every declared table."""
        rows = []
        for name in self.list_tables():
            try:
                self.table(name)
                rows.append((name, True))
            except (MissingArtifact, AnalysisException):
                rows.append((name, False))
        return self.spark.createDataFrame(rows, "table_name string, is_there boolean")

    def valuation(self, codes: Sequence[str] | None = None, start: str | None = None, end: str | None = None, date: str | None = None) -> DataFrame:
        """Daily valuation rows, by the predicates of ``daily``."""
        return self.daily(codes, start, end, date, "fact_stock_daily_basic")

    def indicators(self, codes: Sequence[str] | None = None, announced: str | None = None, period: str | None = None, name: str = "fact_stock_fina_indicator", key: str = "ts_code", at: str = "ann_date", until: str = "end_date") -> DataFrame:
        """Announced figures by code, announcement date and period end, in order of code and announcement."""
        filters = ({key: list(codes)} if codes is not None else {}) | ({at: announced} if announced is not None else {}) | ({until: period} if period is not None else {})
        return self.fetch(name, filters=filters, order_by=[key, at])

    def members(self, codes: Sequence[str] | None = None, name: str = "fact_stock_sw_member", key: str = "ts_code", **levels: str | None) -> DataFrame:
        """Memberships by code and by the value of any level (``l1_name="..."``)."""
        filters = ({key: list(codes)} if codes is not None else {}) | {c: v for c, v in levels.items() if v is not None}
        return self.fetch(name, filters=filters)

    def dimension(self, codes: Sequence[str] | None = None, name: str = "fact_stock_basic_snapshot", key: str = "ts_code") -> DataFrame:
        """The dimension's rows by code, in code order."""
        return self.fetch(name, filters={key: list(codes)} if codes is not None else None, order_by=[key])

    def latest_date(self, name: str = "fact_stock_daily", at: str = "trade_date") -> DataFrame:
        """The greatest date; NULL for an empty table."""
        return self.table(name).agg(F.max(at).alias("latest"))

    def dates(self, start: str, end: str, name: str = "fact_stock_daily", at: str = "trade_date") -> DataFrame:
        return self.table(name).where(F.col(at).between(start, end)).select(at).distinct().orderBy(at)

    def describe(self) -> DataFrame:
        """table, column, type, position of every declared column."""
        rows = [(t.name, n, kind, i) for t in self.catalog.values() for i, (n, kind) in enumerate(t.fields)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")
