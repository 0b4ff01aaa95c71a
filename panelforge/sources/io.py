"""Readers and writers: records, vectors, edge tables, reports, configuration."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidValue, MissingArtifact
from .npy import read_npy, row_ids

log = logging.getLogger("panelforge")

#: Columns that every table of semantic records has.
RECORD_COLUMNS = (
    "record_id",
    "stock_code",
    "stock_name",
    "asof_date",
    "confidence",
    "source_quality_note",
    "profile_text",
    "product_text",
    "model_text",
    "chain_text",
    "theme_text",
    "full_text",
    "biz_form",
    "customer_side",
    "chain_level",
)

#: Columns of JSON text that it may have.
RECORD_JSON_COLUMNS = (
    "business_model_json",
    "industry_chain_position_json",
    "business_logic_json",
    "structural_themes_json",
    "business_scope_keywords_json",
    "core_products_services_json",
    "application_scenarios_json",
    "end_markets_json",
    "customer_types_json",
    "uncertainties_json",
)


def checked_records(df: DataFrame) -> DataFrame:
    """``df`` if it has all columns of semantic records; JSON columns that it lacks are NULL."""
    if missing := [c for c in RECORD_COLUMNS if c not in df.columns]:
        raise InvalidValue(f"records lack {', '.join(missing)}")
    return df.withColumns({c: F.lit(None).cast("string") for c in RECORD_JSON_COLUMNS if c not in df.columns})


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records from CSV or Parquet by the path's ending. CSV columns are strings unless a schema says otherwise."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raise InvalidValue(f"neither .csv nor .parquet: {path}")


def read_vector_view(spark: SparkSession, root: str, view: str) -> DataFrame:
    """record_id, view, embedding from ``<root>/<view>/<view>-all.npy`` and the row_ids of its ``.meta.json``; the vectors are read by ranges of rows."""
    at = f"{root}/{view}/{view}-all"
    vectors = read_npy(spark, f"{at}.npy", "pos long, embedding array<float>")
    return vectors.join(row_ids(spark, f"{at}.meta.json").drop("file"), "pos").select("record_id", F.lit(view).alias("view"), "embedding")


def read_vector_views(spark: SparkSession, root: str, views: Sequence[str]) -> DataFrame:
    """The union of several views."""
    if not views:
        raise MissingArtifact("no view is named")
    out = None
    for v in dict.fromkeys(views):
        out = read_vector_view(spark, root, v) if out is None else out.unionByName(read_vector_view(spark, root, v))
    return out


def read_record_metadata(spark: SparkSession, path: str, view: str) -> DataFrame:
    """record_id and stock_code of JSON-lines records that have a vector of ``view``."""
    schema = "record_id string, stock_code string, vector_paths map<string,string>"
    return spark.read.schema(schema).json(path).where(F.col("vector_paths")[view].isNotNull()).select("record_id", "stock_code")


def padded_ids(ids: DataFrame, positions: DataFrame, pos: str = "pos", id_col: str = "record_id") -> DataFrame:
    """Each of ``positions`` with its id; those beyond the ids that there are get ``row_<pos>``."""
    return positions.select(pos).join(ids.select(pos, id_col), pos, "left").select(pos, F.coalesce(id_col, F.concat(F.lit("row_"), F.col(pos).cast("string"))).alias(id_col))


def write_table(df: DataFrame, path: str, parquet: bool = True, csv: bool = False) -> None:
    """Parquet and/or CSV with a header below ``path``."""
    if parquet:
        df.write.mode("overwrite").parquet(f"{path}.parquet", compression="zstd")
    if csv:
        df.write.mode("overwrite").option("header", True).option("escape", "\"").csv(f"{path}.csv")


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder a value of ``by``; rows of a value are brought together first, so that files are few."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path, compression="zstd")


def write_layers(layers: Mapping[str, DataFrame], path: str) -> None:
    """All graph layers as one edge table partitioned by layer."""
    out = None
    for name, edges in layers.items():
        e = edges.select("src", "dst", "weight", F.lit(name).alias("layer"))
        out = e if out is None else out.unionByName(e)
    if out is not None:
        write_partitioned(out, path, "layer")


def read_layers(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    edges = spark.read.parquet(path)
    return {r[0]: edges.where(F.col("layer") == r[0]).drop("layer") for r in edges.select("layer").distinct().orderBy("layer").collect()}


def write_report(report: DataFrame, path: str) -> None:
    """A report (one row, one JSON column) as one JSON text file below ``path``, wherever that is."""
    report.coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_tables(tables: Mapping[str, DataFrame], root: str) -> list[str]:
    """Each table as Parquet in its folder below ``root``; the paths."""
    paths = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}", compression="zstd")
        paths.append(f"{root}/{name}")
    return paths


def available_views(spark: SparkSession, root: str, views: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """The union of the views that are there, and the names of those that aren't (each is logged); None if none is."""
    there, missing = [], []
    for v in dict.fromkeys(views):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{v}/{v}-all.npy")
        (there if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else missing).append(v)
    for v in missing:
        log.warning("view %s isn't in %s", v, root)
    return (read_vector_views(spark, root, there) if there else None), missing


def load_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def save_config(config: Mapping, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(dict(config), f, allow_unicode=True, sort_keys=False)
