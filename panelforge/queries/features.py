"""Scalars, cross-sections, styles, text and vector features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog_queries import query
from ..functions import scalars as sc
from ..operators import crosssection as cs
from ..operators.quantiles import winsorize_groups
from ..operators import text
from .base import SECTION, load, r, rounded, section, with_


def _sec(columns: str, *parts: str, source: str = "section", where: str = "") -> str:
    return with_(SECTION, *parts) + f"select id, {columns} from {source} {where}"


@query("f1_winsorize_global", _sec("round(least(greatest(price, lo), hi), 6) + 0.0 as price", "b as (select quantile_cont(price, 0.05) as lo, quantile_cont(price, 0.95) as hi from section)", source="section, b"))
def f1_winsorize_global(spark, d):
    return rounded(cs.winsorize_all(section(spark, d), ["price"], 0.05, 0.95).select("id", "price"))


@query("f1_winsorize_group", _sec("round(case when size is not null then least(greatest(size, quantile_cont(size, 0.1) over (partition by grp)), quantile_cont(size, 0.9) over (partition by grp)) end, 6) + 0.0 as size"))
def f1_winsorize_group(spark, d):
    return rounded(section(spark, d).select("id", cs.winsorized("size", ["grp"], 0.1, 0.9).alias("size")))


@query("f1_winsorize_ranges", _sec("round(case when size is not null then least(greatest(size, quantile_cont(size, 0.1) over (partition by grp)), quantile_cont(size, 0.9) over (partition by grp)) end, 6) + 0.0 as size, round(least(greatest(price, quantile_cont(price, 0.1) over (partition by grp)), quantile_cont(price, 0.9) over (partition by grp)), 6) + 0.0 as price"))
def f1_winsorize_ranges(spark, d):
    """Two columns by group, from quantiles that no task holds a group for."""
    return rounded(winsorize_groups(section(spark, d), ["size", "price"], ["grp"], 0.1, 0.9).select("id", "size", "price"))


@query("f2_zscore", _sec("round((size - avg(size) over g) / case when stddev_samp(size) over g = 0 then 1 else stddev_samp(size) over g end, 6) + 0.0 as z", where="window g as (partition by kind)"))
def f2_zscore(spark, d):
    return rounded(section(spark, d).select("id", cs.zscored("size", ["kind"]).alias("z")))


@query("f4_standardize", _sec("round((price - avg(price) over g) / case when stddev_pop(price) over g < 1e-6 then 1 else stddev_pop(price) over g end, 6) + 0.0 as z", where="window g as (partition by kind)"))
def f4_standardize(spark, d):
    return rounded(section(spark, d).select("id", cs.standardized("price", ["kind"]).alias("z")))


@query("f7_neutralize", _sec("round(case when grp is not null then (size - avg(size) over g) / case when stddev_samp(size) over g = 0 then 1 else stddev_samp(size) over g end end, 6) + 0.0 as z", where="window g as (partition by grp)"))
def f7_neutralize(spark, d):
    x = section(spark, d)
    return rounded(x.select("id", cs.neutralized(x, "size", "grp").alias("z")))


RANKED = "case when size is not null then (rank() over (partition by {g} order by size asc nulls last) + (count(size) over (partition by {g}, size) - 1) / 2.0) / count(size) over (partition by {g}) end"


@query("w9_percent_rank", _sec(f"round({RANKED.format(g='kind')}, 6) + 0.0 as p"))
def w9_percent_rank(spark, d):
    """Mean rank of ties over the number of values."""
    return rounded(section(spark, d).select("id", cs.percent_rank("size", ["kind"]).alias("p")))


@query("b5_group_ranks", _sec(f"round(case when grp is not null then {RANKED.format(g='grp')} end, 6) + 0.0 as size_rank"))
def b5_group_ranks(spark, d):
    x = section(spark, d)
    return rounded(x.select("id", cs.neutralized(x, "size", "grp", how="rank").alias("size_rank")))


FILLED = "a as (select *, coalesce(size, case when grp is not null then median(size) over (partition by grp) end) as s1 from section), b as (select *, coalesce(s1, (select median(s1) from a)) as s2 from a)"


@query("f8_fill_missing", _sec("round(s2, 6) + 0.0 as size", FILLED, source="b"))
def f8_fill_missing(spark, d):
    return rounded(cs.fill_missing(section(spark, d), ["size"], "grp").select("id", "size"))


@query("f9_log_positive", _sec("round(ln(nullif(size - 10, 0)), 6) + 0.0 as v", where="where size >= 10"))
def f9_log_positive(spark, d):
    return rounded(section(spark, d).where("size >= 10").select("id", sc.log_positive(F.col("size") - 10).alias("v")))


@query("p10_ratio", _sec("round(price / nullif(size - 10, 0), 6) + 0.0 as v"))
def p10_ratio(spark, d):
    return rounded(section(spark, d).select("id", sc.ratio(F.col("price"), F.col("size") - 10).alias("v")))


@query("a14_row_mean", _sec("round(case when size is null then price else (price + size) / 2 end, 6) + 0.0 as m"))
def a14_row_mean(spark, d):
    return rounded(section(spark, d).select("id", sc.mean_of([F.col("price"), F.col("size")]).alias("m")))


STYLE = """b as (select *, quantile_cont(price, 0.01) over (partition by kind) as pl, quantile_cont(price, 0.99) over (partition by kind) as ph, quantile_cont(size, 0.01) over (partition by kind) as sl, quantile_cont(size, 0.99) over (partition by kind) as sh from section),
  w as (select id, grp, kind, least(greatest(price, pl), ph) as price, case when size is not null then least(greatest(size, sl), sh) end as size from b),
  f as (select id, grp, kind, price, coalesce(size, case when grp is not null then median(size) over (partition by kind, grp) end) as size from w),
  g as (select id, grp, kind, price, coalesce(size, median(size) over (partition by kind)) as size from f),
  m as (select id, grp, kind, price as a, (price + size) / 2 as v from g),
  z as (select id, grp, kind, (a - avg(a) over k) / case when stddev_samp(a) over k = 0 then 1 else stddev_samp(a) over k end as size_style, (v - avg(v) over k) / case when stddev_samp(v) over k = 0 then 1 else stddev_samp(v) over k end as value_style from m window k as (partition by kind)),
  n as (select *, case when grp is not null then (size_style - avg(size_style) over q) / case when stddev_samp(size_style) over q = 0 then 1 else stddev_samp(size_style) over q end end as size_neutral from z window q as (partition by kind, grp))"""


@query("b9_style_exposures", _sec("round(size_style, 6) + 0.0 as size_style, round(value_style, 6) + 0.0 as value_style, round(size_neutral, 6) + 0.0 as size_neutral", STYLE, source="n"))
def b9_style_exposures(spark, d):
    """Winsorize, fill, average, z-score, neutralize: one plan over all dates (here: part types)."""
    x = cs.style_exposures(section(spark, d), "kind", "grp", {"Size": ["price"], "Value": ["price", "size"], "Quality": ["roe"]})
    return rounded(x.select("id", F.col("Size").alias("size_style"), F.col("Value").alias("value_style"), F.col("Size_neutral").alias("size_neutral")))


@query("f11_json_list_length", "select event_id, coalesce(case when event_id % 3 = 0 then event_id % 5 end, 0) as n from events")
def f11_json_list_length(spark, d):
    """Lists by length; objects, broken text and NULL count 0."""
    n = (F.col("event_id") % 5).cast("int")
    made = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array_repeat(F.lit("x"), n))).when(F.col("event_id") % 3 == 1, F.col("props"))
    return load(spark, d, "events").select("event_id", sc.json_list_length(made).cast("long").alias("n"))


@query("b15_quality_features", "select doc_id, case source when 'src1' then 1.0 when 'src2' then 0.5 when 'src3' then 0.2 else 0.0 end as confidence_score, cast(contains(lower(text), 'missing') as bigint) as risk_score, length(text) as text_length, round(cast(contains(lower(text), 'missing') as bigint) / 10.0, 6) + 0.0 as stability_penalty from documents")
def b15_quality_features(spark, d):
    x = load(spark, d, "documents")
    word = F.when(F.col("source") == "src1", "High").when(F.col("source") == "src2", "medium").when(F.col("source") == "src3", "LOW").otherwise("none")
    note = F.when(F.contains(F.lower("text"), F.lit("missing")), "missing")
    x = x.withColumns({"confidence": word, "source_quality_note": note, "full_text": F.col("text")})
    return rounded(text.quality_features(x).select("doc_id", "confidence_score", "risk_score", "text_length", "stability_penalty"))


def _components(x, key: str, **vectors):
    """Every component of some vectors, rounded: key, vector, pos, x."""
    out = None
    for name, v in vectors.items():
        part = x.select(key, F.posexplode(v).alias("pos", "x")).select(key, F.lit(name).alias("vector"), F.col("pos").cast("long").alias("pos"), r(F.col("x").cast("double"), 5).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


UNITS = "u as (select vec_id, cast(embedding as double[]) as e, list_transform(cast(embedding as double[]), lambda x: 2 * x) as twice, list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[])))) as u from embeddings)"


def _listed(key: str, name: str, expression: str, source: str = "u") -> str:
    return f"select {key}, '{name}' as vector, generate_subscripts(v, 1) - 1 as pos, round(unnest(v), 5) + 0.0 as x from (select {key}, {expression} as v from {source})"


@query("f3_unit_vectors", f"with {UNITS} " + _listed("vec_id", "unit", "u"))
def f3_unit_vectors(spark, d):
    """Vectors of twice the length, at unit length."""
    return _components(load(spark, d, "embeddings"), "vec_id", unit=sc.unit(sc.scaled(F.col("embedding"), 2.0)))


@query("f5_padded", f"with {UNITS} " + _listed("vec_id", "longer", "list_resize(e, 80, 0)") + " union all " + _listed("vec_id", "shorter", "e[1:10]"))
def f5_padded(spark, d):
    """Vectors filled up with zeros, and cut."""
    return _components(load(spark, d, "embeddings"), "vec_id", longer=sc.padded(F.col("embedding"), 80), shorter=sc.padded(F.col("embedding"), 10))


@query("f17_similarities", "select a.vec_id as a, b.vec_id as b, round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) + 0.0 as dot, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) + 0.0 as cosine, round(exp(-list_distance(cast(a.embedding as double[]), cast(b.embedding as double[]))), 5) + 0.0 as decay from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def f17_similarities(spark, d):
    a = load(spark, d, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = load(spark, d, "embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    j = a.join(b, F.col("b") == F.col("a") + 1)
    x, y = F.col("x"), F.col("y")
    return j.select("a", "b", r(sc.dot(x, y), 5).alias("dot"), r(sc.cosine(x, y), 5).alias("cosine"), r(sc.decayed_distance(x, y), 5).alias("decay"))


TOKENS = "t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term from documents), c as (select doc_id, term, count(*) as n from t group by 1, 2), f as (select term, count(*) as df, sum(n) as total from c group by 1 order by total desc, term limit 500), w as (select doc_id, c.term, n * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as w from c join f using (term))"


@query("b11_tfidf", f"with {TOKENS} select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) + 0.0 as weight from w")
def b11_tfidf(spark, d):
    """Smoothed TF-IDF of single words, the 500 most frequent terms as vocabulary (a parameter of the operator)."""
    return rounded(text.tfidf(load(spark, d, "documents"), "doc_id", "text", 500, (1, 1)))


@query("b12_text_embedding", None)
def b12_text_embedding(spark, d):
    """TF-IDF and truncated SVD of all documents, every component."""
    x = text.text_embedding(load(spark, d, "documents"), "doc_id", "text", 16, 400, (1, 1))
    return _components(x, "doc_id", embedding=F.col("embedding"))


@query("b13_vector_reduction", None)
def b13_vector_reduction(spark, d):
    """Principal components of centred vectors, unit length, every component."""
    x = text.reduced(load(spark, d, "embeddings"), "vec_id", "embedding", 16)
    return _components(x, "vec_id", embedding=F.col("embedding"))


@query(
    "b14_anchors",
    "with n as (select count(*) as n from customer), p as (select c_mktsegment as v, count(*) / any_value(n) as p from customer, n group by 1) select c_custkey, v as value, round((case when c_mktsegment = v then 1 else 0 end - p) / sqrt(p * (1 - p)), 6) + 0.0 as x from customer, p",
)
def b14_anchors(spark, d):
    x = load(spark, d, "customer")
    names = [row[0] for row in x.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    a = text.anchors(x, "c_custkey", ["c_mktsegment"])
    return rounded(a.select("c_custkey", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("value"), F.col("anchor").alias("x"))).alias("s")).select("c_custkey", F.col("s.value").alias("value"), F.col("s.x").alias("x")))


CONCAT = "w as (select vec_id, list_concat(list_transform(e, lambda x: 0.6 * x), list_transform(list_reverse(e), lambda x: 0.8 * x)) as w from u), s as (select vec_id, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) as s from w)"


@query("b18_semantic_vector", f"with {UNITS}, {CONCAT} " + _listed("vec_id", "semantic", "s", "s"))
def b18_semantic_vector(spark, d):
    """Two blocks by their weights, one after the other, at unit length."""
    x = load(spark, d, "embeddings").withColumn("other", F.reverse("embedding"))
    return _components(text.semantic_vector(x, {"embedding": 0.6, "other": 0.8}), "vec_id", semantic=F.col("semantic"))


FUSED = "w as (select vec_id, list_transform(range(1, 65), lambda i: (e[i] + e[65 - i]) / 2) as w from u), s as (select vec_id, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) as s from w)"


@query("b16_fused_views", f"with {UNITS}, {FUSED} " + _listed("vec_id", "text", "s", "s") + " union all " + _listed("vec_id", "theme", "s", "s"))
def b16_fused_views(spark, d):
    """The unit mean of a family's views; a family without one falls back to the first that has one."""
    x = load(spark, d, "embeddings").withColumn("back", F.reverse("embedding"))
    x = text.fused_views(x, {"text": ["embedding", "back"], "theme": ["none"]})
    return _components(x, "vec_id", text=F.col("text"), theme=F.col("theme"))
