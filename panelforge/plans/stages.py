"""Staged jobs: named DataFrame builders with expectations, stored as Parquet so that a run can resume.

Each output has a manifest beside it: a fingerprint of the stage's parameters, of the rows of its inputs and of the
fingerprints of the stages it needs, its number of rows, its schema and the values that were checked. A run that resumes
takes an output only if its manifest has the fingerprint that the run itself would write.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidValue, MissingArtifact
from ..functions.scalars import norm

log = logging.getLogger("panelforge")
Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Expectation:
    """A condition over one aggregated row of a stage's output."""

    name: str
    value: Callable[[], F.Column]
    holds: Callable[[object], bool]
    #: Columns that the output must have.
    columns: tuple[str, ...] = ()


def has_columns(*names: str) -> Expectation:
    return Expectation(f"columns {', '.join(names)}", lambda: F.lit(True), bool, names)


def never_null(column: str) -> Expectation:
    return Expectation(f"{column} never missing", lambda: F.count_if(F.col(column).isNull()), lambda v: v == 0)


def least_at_least(column: str, bound: float) -> Expectation:
    return Expectation(f"{column} at least {bound}", lambda: F.min(column), lambda v: v is None or v >= bound)


def unit_length(column: str, tolerance: float = 1e-4) -> Expectation:
    return Expectation(f"{column} of length 1", lambda: F.max(F.abs(norm(F.col(column)) - 1)), lambda v: v is not None and v <= tolerance)


def values_of(column: str, *names: str) -> Expectation:
    """Each of ``names`` occurs in the column."""
    return Expectation(f"{column} holds {', '.join(names)}", lambda: F.collect_set(F.when(F.col(column).isin(*names), F.col(column))), lambda v: len(v) == len(names))


def mean_sum_above(column: str, per: str, bound: float) -> Expectation:
    """The sum of the column over the number of distinct values of ``per``."""
    return Expectation(f"sum of {column} for each {per} above {bound}", lambda: F.sum(column) / F.countDistinct(per), lambda v: v is not None and v > bound)


def at_least_rows(n: int) -> Expectation:
    return Expectation(f"at least {n} rows", lambda: F.count("*"), lambda v: v >= n)


def null_share_below(column: str, share: float) -> Expectation:
    return Expectation(f"{column} missing in under {share}", lambda: F.avg(F.col(column).isNull().cast("double")), lambda v: v is None or v < share)


def distinct_at_least(column: str, n: int) -> Expectation:
    return Expectation(f"{n} or more values of {column}", lambda: F.countDistinct(column), lambda v: v >= n)


def mean_above(column: str, bound: float) -> Expectation:
    return Expectation(f"mean of {column} above {bound}", lambda: F.avg(column), lambda v: v is not None and v > bound)


@dataclass(frozen=True)
class Stage:
    """``build`` makes the output from the outputs of ``needs``, the tables ``inputs`` and the parameters ``params``."""

    name: str
    build: Callable[[SparkSession, Tables], DataFrame]
    needs: Sequence[str] = ()
    expects: Sequence[Expectation] = field(default_factory=tuple)
    params: Mapping[str, object] = field(default_factory=dict)
    inputs: Mapping[str, DataFrame] = field(default_factory=dict)


def validate(stage: Stage, df: DataFrame) -> dict[str, object]:
    """Values of all expectations, from one aggregation; a broken one raises."""
    if missing := [c for e in stage.expects for c in e.columns if c not in df.columns]:
        raise InvalidValue(f"stage {stage.name}: expected columns {', '.join(missing)}")
    if not stage.expects:
        return {}
    row = df.agg(*[e.value().alias(f"e{i}") for i, e in enumerate(stage.expects)]).first()
    values = {e.name: row[i] for i, e in enumerate(stage.expects)}
    if broken := [e.name for i, e in enumerate(stage.expects) if not e.holds(row[i])]:
        raise InvalidValue(f"stage {stage.name}: expected {'; '.join(broken)}; found {values}")
    return values


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def removed(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def rows_fingerprint(df: DataFrame) -> str:
    """A hash of all rows whatever their order, and of the schema, in one pass."""
    values = [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if "map" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    row = F.xxhash64(*values) if values else F.lit(0)
    # two hashes of the rows; repeated rows don't cancel out in a sum
    found = df.agg(F.count("*"), F.sum((row % 2147483647).cast("decimal(38,0)")), F.sum(F.pmod(F.xxhash64(row), F.lit(2147483629)).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr([df.schema.simpleString(), *map(str, found)]).encode()).hexdigest()


def fingerprint(stage: Stage, of: Mapping[str, str], inputs: Mapping[str, str]) -> str:
    """What the stage's output depends on; ``of`` has the fingerprints of stages, ``inputs`` those of its tables."""
    told = {"stage": stage.name, "params": stage.params, "needs": {n: of[n] for n in sorted(stage.needs)}, "inputs": dict(sorted(inputs.items()))}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def write_manifest(spark: SparkSession, path: str, manifest: Mapping[str, object]) -> None:
    text = json.dumps(manifest, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest, or None where there is none that was written to its end."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, f"{path}/_SUCCESS") else None


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """stage, fingerprint, rows, columns, params, needs (both as JSON), of all outputs below ``root``."""
    x = spark.read.text(f"{root.rstrip('/')}/*.manifest").select(F.from_json("value", "stage string, fingerprint string, rows long, columns array<string>, params string, needs string").alias("m"))
    return x.select("m.*")


def run_stages(spark: SparkSession, stages: Sequence[Stage], root: str, resume: bool = False, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Runs the stages in order; each is written, read back and checked, then its manifest is written.

    With ``resume`` an output is taken as it is if it is complete, checked, and of the same parameters and inputs; else it
    is made again, and with it all that depends on it where that changes their fingerprints. Stages outside ``only`` must be there
    just so. Each run leaves a log below ``<root>/runs``: stage, action, seconds, rows, checked values.
    """
    root = root.rstrip("/")
    done: dict[str, DataFrame] = {}
    prints: dict[str, str] = {}
    seen: dict[int, str] = {}
    told: list[dict] = []
    try:
        for stage in stages:
            began, path = time.time(), f"{root}/{stage.name}"
            if missing := [n for n in stage.needs if n not in done]:
                raise MissingArtifact(f"stage {stage.name} needs {', '.join(missing)}")
            for df in stage.inputs.values():
                if id(df) not in seen:
                    seen[id(df)] = rows_fingerprint(df)
            mine = prints[stage.name] = fingerprint(stage, prints, {n: seen[id(df)] for n, df in stage.inputs.items()})
            manifest = read_manifest(spark, f"{path}.manifest") if exists(spark, f"{path}/_SUCCESS") else None
            same = manifest is not None and manifest["fingerprint"] == mine
            outside = only is not None and stage.name not in only
            if outside and not same:
                raise MissingArtifact(path if manifest is None else f"{path} is of other parameters or inputs")
            keep = outside or (resume and same)
            if not keep:
                log.info("stage %s%s", stage.name, "" if manifest is None or same else ": parameters or inputs have changed")
                # an output without a manifest isn't taken: so it is until this one is checked
                removed(spark, f"{path}.manifest")
                stage.build(spark, done).write.mode("overwrite").parquet(path, compression="zstd")
            df = spark.read.parquet(path)
            values = validate(stage, df)
            rows = manifest["rows"] if keep else df.count()
            if not keep:
                write_manifest(spark, f"{path}.manifest", {"stage": stage.name, "fingerprint": mine, "params": stage.params, "needs": {n: prints[n] for n in stage.needs}, "rows": rows, "columns": df.columns, "schema": df.schema.simpleString(), "values": values})
            told.append({"stage": stage.name, "action": "kept" if keep else "built", "seconds": round(time.time() - began, 3), "rows": rows, "values": json.dumps(values, default=str)})
            log.info("stage %s: %s", stage.name, values)
            done[stage.name] = df
    except Exception as e:
        told.append({"stage": stage.name, "action": "failed", "seconds": round(time.time() - began, 3), "rows": None, "values": json.dumps(str(e)[:2000])})
        raise
    finally:
        if told:
            log_ = spark.createDataFrame([(i, *(x[c] for c in ("stage", "action", "seconds", "rows", "values"))) for i, x in enumerate(told)], "position int, stage string, action string, seconds double, rows long, values string")
            log_.coalesce(1).write.json(f"{root}/runs/{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}")
    return done


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """run, position, stage, action, seconds, rows, values of all runs below ``root``."""
    x = spark.read.schema("position int, stage string, action string, seconds double, rows long, values string").json(f"{root.rstrip('/')}/runs/*")
    return x.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
