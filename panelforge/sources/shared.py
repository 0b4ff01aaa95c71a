"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_folder: ContextVar[str] = ContextVar("panelforge_folder", default="")


def shared_root(spark: SparkSession) -> str:
    """The shared folder (``spark.checkpoint.dir``); one is made only for a local session, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: computed once (an eager checkpoint computes twice), and there when an executor is lost."""
    return _written(df, _folder.get() or f"{shared_root(df.sparkSession)}/panelforge")


@contextmanager
def iteration(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are deleted at the end. What it gives cuts a table so that it outlives that: the result."""
    outer = _folder.get() or f"{shared_root(spark)}/panelforge"
    path = f"{outer}/job-{uuid.uuid4().hex}"
    before = _folder.set(path)
    try:
        yield lambda df: _written(df, outer)
    finally:
        _folder.reset(before)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f``, whose first argument is a table, with the tables that it cuts on its way deleted at its end; its result is a table of its own."""

    @wraps(f)
    def run(first: DataFrame, *args: object, **kw: object) -> DataFrame:
        with iteration(first.sparkSession) as kept:
            return kept(f(first, *args, **kw))

    return run
