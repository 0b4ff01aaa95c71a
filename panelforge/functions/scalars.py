"""Row-wise column functions: clipping, logs, text and JSON measures, vector arithmetic. All stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a confidence word counts for.
CONFIDENCE = {"high": 1.0, "medium": 0.5, "low": 0.2}


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def clip(c: Column, low: Column, high: Column) -> Column:
    """``c`` within the bounds; NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def centred(c: Column, mean: Column, sd: Column) -> Column:
    """z-score; with a zero or missing deviation only the mean is taken off."""
    return F.when(sd.isNull() | (sd == 0), c - mean).otherwise((c - mean) / sd)


def log_positive(c: Column) -> Column:
    """Natural logarithm with zero as NULL."""
    return F.ln(F.nullif(c, F.lit(0).cast("double")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def json_list_length(c: Column) -> Column:
    """Length of a JSON list; 0 for NULL, broken text and anything that is no list."""
    return F.coalesce(F.json_array_length(c), F.lit(0))


def confidence_value(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return reduce(lambda rest, kv: F.when(word == kv[0], F.lit(kv[1])).otherwise(rest), CONFIDENCE.items(), F.lit(0.0))


def phrase_hits(c: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains."""
    return reduce(add, [F.coalesce(F.contains(c, F.lit(p)), F.lit(False)).cast("int") for p in phrases])


def compact_date(c: Column) -> Column:
    """YYYY-MM-DD text without dashes."""
    return F.regexp_replace(c, "-", "")


def mean_of(columns: list[Column]) -> Column:
    """Mean of the non-NULL values of a row, NULL if there is none."""
    n = reduce(add, [c.isNotNull().cast("int") for c in columns])
    return F.when(n > 0, reduce(add, [F.coalesce(c, F.lit(0.0)) for c in columns]) / n)


# --- vectors -----------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    """Row L2 normalisation; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def decayed_distance(a: Column, b: Column, tau: float = 1.0) -> Column:
    """exp(-distance / tau)."""
    return F.exp(-distance(a, b) / F.lit(tau))


def scaled(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * F.lit(k))


def vector_mean(vectors: list[Column]) -> Column:
    """Element-wise mean of equally long vectors."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")), vectors)
    return F.transform(total, lambda x: x.cast("double") / F.lit(float(len(vectors))))


def weighted_concat(blocks: list[tuple[Column, float]]) -> Column:
    """Blocks scaled by their weights, one after the other, normalised."""
    return unit(F.concat(*[scaled(v, w) for v, w in blocks]))


def padded(v: Column, size: int) -> Column:
    """Cut or zero-filled to ``size``."""
    v = F.transform(v, lambda x: x.cast("double"))
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)
