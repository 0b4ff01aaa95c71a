"""Text and vector features: TF-IDF, truncated SVD, PCA, anchors, quality columns, view fusion."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence_value, json_list_length, padded, phrase_hits, text_or_empty, unit, vector_mean, weighted_concat
from ..sources.shared import cut

#: Phrases that mark a doubtful source (fixed values).
RISK_PHRASES = ["uncertain", "unverified", "no source", "estimated", "outdated", "conflict", "missing", "low confidence"]


def terms(df: DataFrame, id_col: str, text_col: str, ngrams: tuple[int, int] = (1, 2)) -> DataFrame:
    """id, term, n: tokens of two or more word characters in lower case, and their n-grams."""
    tokens = F.regexp_extract_all(F.lower(text_or_empty(F.col(text_col))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    x = df.select(F.col(id_col).alias("id"), tokens.alias("t"))

    def grams(n: int) -> F.Column:
        if n == 1:
            return F.col("t")
        last = F.size("t") - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(F.col("t"), i, n), " "))

    return x.select("id", F.explode(F.concat(*[grams(n) for n in range(ngrams[0], ngrams[1] + 1)])).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


#: Tokens that are looked at in one piece, and frequent words up to which n-grams are searched among them only.
TOKENS, WORDS = 1 << 20, 200_000


def _tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t: one row an id, with a list of tokens for each of its texts. Texts are brought together only where ids repeat."""
    t = F.regexp_extract_all(F.lower(text_or_empty(F.col(text_col))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    x = df.select(F.col(id_col).alias("id"), t.alias("t"))
    if df.groupBy(id_col).count().where("count > 1").limit(1).count():
        return x.groupBy("id").agg(F.collect_list("t").alias("t"))
    return x.select("id", F.array("t").alias("t"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some ``TOKENS`` tokens (one row at least)."""
    for batch in batches:
        lists = batch.column(1)
        at = lists.values.offsets.to_numpy()[lists.offsets.to_numpy()]
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + TOKENS, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def _grams(lists: pa.Array, ngrams: tuple[int, int], words: pa.Array | None) -> tuple[np.ndarray, pa.Array]:
    """The n-grams of each row's texts, and of which row each is; with ``words`` only those that hold no other."""
    texts = lists.flatten()
    flat = texts.flatten()
    sizes = np.diff(texts.offsets.to_numpy())
    row = np.repeat(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    good = np.ones(len(flat), bool) if words is None else pc.is_in(flat, value_set=words.cast(flat.type)).to_numpy(zero_copy_only=False)
    rows, found = [], []
    for n in range(ngrams[0], ngrams[1] + 1):
        at = np.flatnonzero(left >= n)
        for i in range(n):
            at = at[good[at + i]]
        parts = [flat.take(pa.array(at + i)) for i in range(n)]
        rows.append(row[at])
        found.append(parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " "))
    return np.concatenate(rows), pa.concat_arrays([f.cast(pa.large_string()) for f in found])


def _totals(tokens: DataFrame, ngrams: tuple[int, int], min_df: int, words: pa.Array | None = None) -> DataFrame:
    """term, total, df of the n-grams in at least ``min_df`` rows: each task counts its own before terms are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, term = _grams(batch.column(1), ngrams, words)
            coded = term.dictionary_encode()
            size, at = max(1, len(coded.dictionary)), coded.indices.to_numpy()
            key, n = np.unique(row * size + at, return_counts=True)
            total, df = np.bincount(key % size, n, size).astype(np.int64), np.bincount(key % size, minlength=size)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), *(pa.array(x[: len(coded.dictionary)]) for x in (total, df))], ["term", "total", "df"])

    found = tokens.mapInArrow(run, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    return found.where(F.col("df") >= min_df)


def vocabulary(tokens: DataFrame, ngrams: tuple[int, int], max_features: int, min_df: int) -> list[tuple[str, int]]:
    """The ``max_features`` most frequent terms (ties by term) with the numbers of rows that have them, in the order of terms.

    No n-gram is more frequent than one of its words, so where single words fill the vocabulary already, n-grams count
    only if all their words are as frequent as the last of these: those of rare words are never made.
    """
    first = lambda x: x.orderBy(F.desc("total"), "term").limit(max_features).collect()
    words = None
    if ngrams[0] == 1 < ngrams[1]:
        single = cut(_totals(tokens, (1, 1), min_df))
        top = first(single)
        if len(top) == max_features:
            frequent = single.where(F.col("total") >= top[-1]["total"]).limit(WORDS + 1).select("term").collect()
            words = pa.array([r[0] for r in frequent], pa.string()) if len(frequent) <= WORDS else None
    return sorted((r["term"], r["df"]) for r in first(_totals(tokens, ngrams, min_df, words)))


def _counted(df: DataFrame, id_col: str, text_col: str, max_features: int, ngrams: tuple[int, int], min_df: int) -> tuple[DataFrame, list[str], np.ndarray]:
    """Rows k, i, n (an id, the places of its terms in the vocabulary and how often it has them), the vocabulary and each term's idf."""
    tokens = _tokens(df, id_col, text_col)
    docs = df.count()
    terms_ = vocabulary(tokens, ngrams, max_features, min_df)
    names = pa.array([t for t, _ in terms_], pa.large_string())
    words = pa.array(sorted({w for t, _ in terms_ for w in t.split(" ")}), pa.string())
    idf = np.log((1 + docs) / (1 + np.array([n for _, n in terms_], np.float64))) + 1
    size = max(1, len(terms_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            row, term = _grams(batch.column(1), ngrams, words)
            at = pc.index_in(term, value_set=names)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            key, n = np.unique(row[known] * size + at.drop_null().to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(key // size, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % size, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["k", "i", "n"])

    return tokens.mapInArrow(run, f"k {tokens.schema['id'].dataType.simpleString()}, i array<int>, n array<int>"), [t for t, _ in terms_], idf


def tfidf(df: DataFrame, id_col: str, text_col: str, max_features: int = 5000, ngrams: tuple[int, int] = (1, 2), min_df: int = 1) -> DataFrame:
    """id, term, weight: n * (ln((1 + docs) / (1 + df)) + 1), rows of length 1. The vocabulary holds the ``max_features`` most frequent terms (ties by term).

    A row's terms are counted and weighed where the row lies; only terms with their counts are shuffled.
    """
    rows, names, idf = _counted(df, id_col, text_col, max_features, ngrams, min_df)
    terms_, kind = pa.array(names, pa.string()), rows.schema["k"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            at = batch.column(1).flatten().to_numpy()
            w = batch.column(2).flatten().to_numpy() * idf[at]
            size = np.sqrt(np.bincount(row, w * w, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms_.take(pa.array(at)), pa.array(w / size[row])], ["k", "term", "weight"])

    return rows.mapInArrow(weigh, f"k {kind}, term string, weight double").withColumnRenamed("k", id_col)


def _signed(components: np.ndarray) -> np.ndarray:
    """Columns with their largest loading positive, so that runs agree."""
    top = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    return components * np.where(top < 0, -1, 1)


def _gram(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the weights of ``rows`` (i, n: places and counts of terms), added up by tasks; its bytes depend on the number of terms only."""
    size = len(idf)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                dense = _dense(part.column(0), part.column(1), idf)
                total += dense.T @ dense
        kept = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(list(total[kept]), pa.list_(pa.float64()))], ["k", "v"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": part["k"].iloc[:1], "v": [np.sum(np.stack(part["v"].to_list()), axis=0)]})

    parts = rows.select("i", "n").coalesce(64).mapInArrow(add, "k int, v array<double>")
    out = np.zeros((size, size))
    for r in parts.groupBy("k").applyInPandas(merge, "k int, v array<double>").collect():
        out[r[0]] = r[1]
    return out


def _dense(places: pa.Array, counts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Rows of weights, of length 1; a row without a term is zero."""
    out = np.zeros((len(places), len(idf)))
    out[np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy()] = counts.flatten().to_numpy()
    out *= idf
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1.0)


def text_embedding(df: DataFrame, id_col: str, text_col: str, size: int = 64, max_features: int = 2000, ngrams: tuple[int, int] = (1, 2)) -> DataFrame:
    """id, embedding: TF-IDF, truncated (uncentred) SVD, padding to ``size``, unit length. Texts without a term are zero.

    The right singular vectors are the eigenvectors of the terms' Gram matrix, which has ``max_features`` rows at most.
    """
    zero = F.array_repeat(F.lit(0.0), size)
    rows, names, idf = _counted(df, id_col, text_col, max_features, ngrams, 1)
    n = len(names)
    if not n:
        return df.select(id_col, zero.alias("embedding"))
    rows = cut(rows)
    value, vector = np.linalg.eigh(_gram(rows, idf))
    top = np.argsort(-value, kind="stable")[: min(size, n)]
    loads = np.zeros((n, size))
    # directions that no text has stay zero
    loads[:, : len(top)] = _signed(vector[:, top]) * (value[top] > 1e-12 * value.max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                x = _dense(part.column(1), part.column(2), idf) @ loads
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["k", "e"])

    kind = dict(df.dtypes)[id_col]
    e = rows.mapInArrow(project, f"k {kind}, e array<double>")
    return df.select(id_col).join(e, F.col(id_col) == F.col("k"), "left").select(id_col, F.coalesce(unit(F.col("e")), zero).alias("embedding"))


def reduced(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """id, embedding: padded where the vectors are no longer than ``size``, else their ``size`` principal components (centred), unit length."""
    dim = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    v = F.transform(vector_col, lambda x: x.cast("double"))
    if dim <= size:
        return vectors.select(id_col, unit(padded(v, size)).alias("embedding"))
    means = vectors.select(F.posexplode(v).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).orderBy("p").collect()
    mean = F.array(*[F.lit(float(r[1])) for r in means])
    x = vectors.select(id_col, array_to_vector(F.zip_with(v, mean, lambda a, b: a - b)).alias("f"))
    model = PCA(k=size, inputCol="f", outputCol="o").fit(x)
    components = _signed(model.pc.toArray())
    flip = [1.0 if np.allclose(a, b) else -1.0 for a, b in zip(components.T, model.pc.toArray().T)]
    signs = F.array(*[F.lit(s) for s in flip])
    return model.transform(x).select(id_col, unit(F.zip_with(vector_to_array("o"), signs, lambda a, b: a * b)).alias("embedding"))


def anchors(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """id, anchor: one-hot values of the fields in sorted order (NULL as "unknown"), each standardised over all rows."""
    parts = []
    for c in fields:
        value = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
        stats = df.groupBy(value.alias("v")).agg(F.count("*").alias("n")).orderBy("v").collect()
        total = sum(r["n"] for r in stats)
        for r in stats:
            p = r["n"] / total
            sd = (p * (1 - p)) ** 0.5
            parts.append((F.when(value == r["v"], 1.0).otherwise(0.0) - F.lit(p)) / F.lit(sd if sd >= 1e-6 else 1.0))
    return df.select(id_col, F.array(*parts).alias("anchor"))


def quality_features(df: DataFrame, confidence: str = "confidence", note: str = "source_quality_note", text: str = "full_text", uncertain: str = "uncertainties_json") -> DataFrame:
    """Adds confidence_score, uncertainty_count, risk_score, text_length and stability_penalty; absent columns count as empty."""
    c = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    df = df.withColumns({"confidence_score": confidence_value(c(confidence)), "uncertainty_count": json_list_length(c(uncertain)), "risk_score": phrase_hits(F.lower(c(note)), RISK_PHRASES), "text_length": F.length(text_or_empty(c(text)))})
    return df.withColumn("stability_penalty", (F.col("uncertainty_count") + F.col("risk_score")) / 10)


def fused_views(df: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds one unit vector a family: the mean of its views that are columns; families without any fall back to the first that has one."""
    have = {f: [v for v in views if v in df.columns] for f, views in families.items()}
    first = next((v for v in have.values() if v), None)
    if first is None:
        raise ValueError("no view is there")
    return df.withColumns({f: unit(vector_mean([F.col(v) for v in (views or first)])) for f, views in have.items()})


def semantic_vector(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Adds ``semantic``: the blocks scaled by their weights, one after the other, unit length."""
    return df.withColumn("semantic", weighted_concat([(F.col(c), w) for c, w in weights.items()]))


__all__ = ["anchors", "fused_views", "quality_features", "reduced", "semantic_vector", "terms", "text_embedding", "tfidf"]
