"""Records, vectors and features brought together by key, never by position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..functions.scalars import compact_date, unit
from .relational import asof_join
from .text import text_embedding


def record_ids_asof(snapshot: DataFrame, records: DataFrame, key: str = "ts_code", at: str = "trade_date", record_key: str = "stock_code", told: str = "asof_date", record: str = "record_id") -> DataFrame:
    """Adds the id of the key's latest record not after ``at`` (dates as text, dashes are ignored); NULL where the key has none.

    Rows of dates before any key's first record get ``key_at`` instead.
    """
    r = records.select(F.col(record_key).alias(key), compact_date(F.col(told).cast("string")).alias("_told"), F.col(record))
    first = r.agg(F.min("_told").alias("_first"))
    x = snapshot.drop(record).withColumn("_at", compact_date(F.col(at).cast("string")))
    x = asof_join(x, r, key, "_at", "_told", [record], tie=record).join(F.broadcast(first))
    early = F.col("_first").isNull() | (F.col("_at") < F.col("_first"))
    return x.withColumn(record, F.when(early, F.concat_ws("_", key, "_at")).otherwise(F.col(record))).drop("_at", "_told", "_first")


def with_momentum(df: DataFrame, panel: DataFrame, keys: Sequence[str], long: str = "ret_252d", short: str = "ret_20d", name: str = "momentum_raw") -> DataFrame:
    """``df`` with the panel's long return less its short one (or the long one alone), in place of a column of that name."""
    if long not in panel.columns:
        return df
    value = F.col(long) - F.col(short) if short in panel.columns else F.col(long)
    return df.drop(name).join(panel.select(*keys, value.alias(name)), list(keys), "left")


def align_by(rows: DataFrame, vectors: DataFrame, keys: Sequence[tuple[str, str]], vector: str) -> DataFrame:
    """Adds ``vector`` by the first of several (row key, vector key) pairs that has one; NULL where none has."""
    found = []
    for i, (mine, theirs) in enumerate(keys):
        v = vectors.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.first(vector).alias(f"_v{i}"))
        rows = rows.join(v, F.col(mine) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return rows.withColumn(vector, F.coalesce(*found)).drop(*found)


def key_positions(keys: DataFrame, table: DataFrame, key: str, position: str = "pos", record: str = "record_id", stock: str = "stock_code") -> DataFrame:
    """Adds the position in ``table`` of the row whose stock code, or else record id, is the key (the last of several); -1 for misses."""
    at = [table.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{n}")).agg(F.max(position).alias(f"_p{n}")) for n, c in (("s", stock), ("r", record))]
    x = keys.join(at[0], F.col(key) == F.col("_s"), "left").join(at[1], F.col(key) == F.col("_r"), "left")
    return x.withColumn(position, F.coalesce("_ps", "_pr", F.lit(-1).cast("long"))).drop("_s", "_r", "_ps", "_pr")


def first_view(records: DataFrame, views: DataFrame, key: str, preference: Sequence[str], vector: str = "embedding", view: str = "view") -> DataFrame:
    """Adds the vector of the first preferred view that has the record, and that view's name; NULLs where none has."""
    order = F.coalesce(*[F.when(F.col(view) == v, F.lit(i)) for i, v in enumerate(preference)])
    best = views.withColumn("_o", order).where("_o is not null").groupBy(key).agg(F.min_by(F.struct(vector, view), "_o").alias("_b"))
    return records.join(best, key, "left").select(*[records[c] for c in records.columns], F.col(f"_b.{vector}").alias(vector), F.col(f"_b.{view}").alias(view))


def numeric_vectors(df: DataFrame, columns: Sequence[str], vector: str = "embedding", least: float = 1e-8) -> DataFrame:
    """Adds unit vectors of standardised columns (NULL as 0, population deviation): what stands in for missing text vectors."""
    df = df.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(columns)})
    stats = df.agg(*[g(f"_f{i}").alias(f"_{n}{i}") for i in range(len(columns)) for n, g in (("m", F.avg), ("d", F.stddev_pop))])
    z = [(F.col(f"_f{i}") - F.col(f"_m{i}")) / F.when(F.col(f"_d{i}") == 0, 1.0).otherwise(F.col(f"_d{i}")) for i in range(len(columns))]
    v = F.array(*z)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(least)
    return df.join(F.broadcast(stats)).withColumn(vector, F.transform(v, lambda x: x / size)).drop(*[f"_{n}{i}" for i in range(len(columns)) for n in "fmd"])


def view_features(records: DataFrame, key: str, text: str, views: Mapping[str, DataFrame], size: int, vector: str = "embedding") -> DataFrame:
    """key and a unit vector of ``text``: the view of that name where there is one (zeros for records it lacks), else a text embedding."""
    if text in views:
        v = views[text].select(key, vector)
        n = v.agg(F.max(F.size(vector)).alias("_n"))
        zero = F.expr("array_repeat(0.0D, coalesce(_n, 0))")
        return records.select(key).join(v, key, "left").join(F.broadcast(n)).select(key, F.coalesce(unit(F.col(vector)), zero).alias(vector))
    if text not in records.columns:
        raise InvalidValue(f"neither a view nor a column: {text}")
    return text_embedding(records, key, text, size)


def concat_by_key(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The columns of all parts side by side, rows matched by key; keys come from the first part."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.drop(*[c for c in p.columns if c in out.columns and c != key]), key, "left")
    return out


def cast_columns(df: DataFrame, columns: Sequence[str], kind: str = "float") -> DataFrame:
    """Those of ``columns`` that are there, in a narrower type."""
    return df.withColumns({c: F.col(c).cast(kind) for c in columns if c in df.columns})

