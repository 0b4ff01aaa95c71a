"""Incremental loads: files to a keyed table, and bars over event time."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..sources.shared import cut, iteration


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of both, the latest by ``order`` for each key (the batch's on ties)."""
    x = current.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_b"))
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_b")


def incremental_load(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], order: str) -> StreamingQuery:
    """Loads what the source folder has gained since the last run. The stream's checkpoint is the high-water mark. Each batch writes the whole target anew as ``<target>/v<batch>``; the version of the last batch is the table."""

    def merge(batch: DataFrame, number: int) -> None:
        version = f"{target}/v{number}"
        latest = f"{target}/v{number - 1}"
        merged = batch if number == 0 else upsert(spark.read.parquet(latest), batch, keys, order)
        if number == 0:
            merged = upsert(batch.limit(0), batch, keys, order)
        merged.write.mode("overwrite").parquet(version, compression="zstd")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    """The file system of ``path`` and ``path`` as it names it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folders ``v<number>`` in ``folder``, in order."""
    fs, where = _folder(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())


def _committed(spark: SparkSession, target: str, before: int | None = None) -> list[int]:
    """Versions (of batches before ``before``) whose pointer is written to its end."""
    done = []
    for v in _versions(spark, f"{target}/pointers"):
        fs, where = _folder(spark, f"{target}/pointers/v{v}/_SUCCESS")
        if fs.exists(where) and (before is None or v < before):
            done.append(v)
    return done


def _pointer(spark: SparkSession, target: str, version: int) -> dict[int, int]:
    """bucket to the version whose folder holds it; as many entries as the table has buckets."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{target}/pointers/v{version}").where("bucket >= 0").collect()}


def current_version(spark: SparkSession, target: str) -> int | None:
    """The last batch that ``target`` holds whole; None before the first."""
    return max(_committed(spark, target), default=None)


def _buckets(spark: SparkSession, target: str, schema: StructType, where: dict[int, int]) -> DataFrame:
    """Rows of the buckets in ``where``."""
    paths = [f"{target}/data/v{v}/_bucket={b}" for b, v in sorted(where.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def loaded(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The table that ``merge_load`` keeps in ``target``: the last version, or one of the last two by its number."""
    version = current_version(spark, target) if version is None else version
    if version is None:
        raise ValueError(f"{target} holds no version yet")
    schema = spark.read.parquet(f"{target}/pointers/v{version}").where("bucket = -1").first()["told"]
    return _buckets(spark, target, StructType.fromJson(json.loads(schema)), _pointer(spark, target, version))


def latest_rows(rows: DataFrame, keys: Sequence[str], order: str, prefer: str) -> DataFrame:
    """The row of each key that is greatest by ``order`` (a NULL is least), then by ``prefer``, then by its own text. Combined before the shuffle, so a key with many rows is no task's work."""
    rest = [c for c in rows.columns if c not in (*keys, prefer)]
    whole = F.struct(*rest)
    best = rows.groupBy(*keys).agg(F.max_by(whole, F.struct(order, prefer, F.to_json(whole))).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def merge_load(spark: SparkSession, source: str, schema: str | StructType, target: str, checkpoint: str, keys: Sequence[str], order: str, buckets: int = 64) -> StreamingQuery:
    """As ``incremental_load``, but a batch rewrites only the buckets of keys that it touches.

    Keys are dealt to ``buckets`` by their hash. A batch writes its buckets as ``data/v<batch>``, then, last, a pointer
    that names for each bucket the version holding it; readers (``loaded``) go by the last whole pointer, so they see
    all of a batch or nothing of it, and a batch that is run again after a failure writes the same folders anew. Data to
    which neither of the last two pointers lead is deleted. Keys that are NULL are a key; of rows with one key the latest by
    ``order`` stays, the batch's on ties; a batch without rows changes no bucket. ``buckets`` is fixed with the first batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        kind = StructType([StructField(f.name, f.dataType) for f in batch.schema])
        before = _committed(spark, target, number)
        state = _pointer(spark, target, before[-1]) if before else {}
        with iteration(spark):
            dealt = cut(latest_rows(batch.withColumn("_new", F.lit(1)), keys, order, "_new").withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
            touched = [r[0] for r in dealt.select("_bucket").distinct().collect()]
            if touched:
                kept = _buckets(spark, target, kind, {b: state[b] for b in touched if b in state})
                kept = kept.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
                both = kept.withColumn("_new", F.lit(0)).unionByName(dealt.withColumn("_new", F.lit(1)))
                merged = latest_rows(both, ["_bucket", *keys], order, "_new").select("_bucket", *batch.columns)
                merged.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/data/v{number}", compression="zstd")
        state |= dict.fromkeys(touched, number)
        told = [(b, v, None) for b, v in state.items()] + [(-1, number, kind.json())]
        spark.createDataFrame(told, "bucket int, version long, told string").coalesce(1).write.mode("overwrite").parquet(f"{target}/pointers/v{number}")
        used = set(state.values()) | (set(_pointer(spark, target, before[-1]).values()) if before else set())
        for v in set(_versions(spark, f"{target}/data")) - used:
            fs, where = _folder(spark, f"{target}/data/v{v}")
            fs.delete(where, True)
        for v in before[:-1]:
            fs, where = _folder(spark, f"{target}/pointers/v{v}")
            fs.delete(where, True)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_bars(events: DataFrame, at: str, by: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count, sum, least and greatest value by key and event-time window; rows later than ``late`` behind the watermark are left out. Works on streams and tables."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high")).select(by, F.col("w.start").alias("bar"), "n", "total", "low", "high")
