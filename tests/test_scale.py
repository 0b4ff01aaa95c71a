"""Forms that need no task or driver to hold everything, against plain ones: numbering, neighbours, density clusters, communities, vector files, manifests."""

from __future__ import annotations

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.errors import InvalidValue, MissingArtifact
from panelforge.operators import clusters, communities, density, graphs, metrics, neighbours
from panelforge.operators import crosssection as cs
from panelforge.operators import relational as rel
from panelforge.operators.numbering import numbered
from panelforge.operators.quantiles import exact_quantiles, one_row, winsorize_groups
from panelforge.plans.staged import StagedJob
from panelforge.plans.stages import Stage, at_least_rows, manifests, rows_fingerprint, run_log, run_stages
from panelforge.sources import npy
from panelforge.sources.shared import cut, iteration, shared_root
from tests.sequential import leaf_clusters, sequential_communities


def edge_frame(spark, rows, kind="long"):
    both = [(a, b, float(w)) for a, b, w in rows] + [(b, a, float(w)) for a, b, w in rows]
    return spark.createDataFrame(both, f"src {kind}, dst {kind}, weight double").coalesce(2)


def test_numbers(spark):
    x = spark.range(1000).select((F.col("id") * 7 % 13).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b")).repartition(6)
    got = [(r.number, (r.a, r.b is not None, r.b or 0)) for r in numbered(x, ["a", "b"]).orderBy("number").collect()]
    assert [n for n, _ in got] == list(range(1, 1001)) and [k for _, k in got] == sorted(k for _, k in got)
    assert numbered(x.limit(0), ["a"]).count() == 0
    assert sorted(r.n for r in numbered(spark.range(4).select(F.lit("same").alias("s")), ["s"], "n", 0).collect()) == [0, 1, 2, 3]


def brute(ids, x, k, metric, least, tau):
    y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x
    s = np.round(neighbours.similarity(metric, y, y, tau), 9)
    out = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and (least is None or s[i, j] >= least)), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(a, ids[j], rank + 1) for rank, j in enumerate(order)}
    return out, {(ids[i], ids[j]): s[i, j] for i in range(len(ids)) for j in range(len(ids))}


@pytest.mark.parametrize("metric, least", [("cosine", None), ("cosine", 0.3), ("l2", None), ("decay", 0.2), ("inner", None), ("mean_product", 0.0)])
def test_neighbours_in_many_cells(spark, monkeypatch, caplog, metric, least):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    r = np.random.default_rng(5)
    centres = r.standard_normal((8, 6)) * 6
    x = np.concatenate([centres[i % 8] + r.standard_normal(6) * 0.3 for i in range(400)]).reshape(400, 6)
    x[50:60] = x[49]
    x[70] = 0
    ids = r.permutation(400).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")
    with caplog.at_level(logging.INFO, "panelforge"):
        got = graphs.knn(df, "id", "v", 5, metric, least, 2.0).collect()
    want, s = brute(ids, x, 5, metric, least, 2.0)
    assert {(g.src, g.dst, g.rank) for g in got} == want
    assert all(abs(g.weight - s[g.src, g.dst]) < 1e-8 for g in got)
    done, every = [int(w) for w in caplog.messages[-1].split() if w.isdigit()][:2]
    assert every == 100 and (done < every or metric in ("inner", "mean_product"))


def test_neighbours_of_text_ids_and_small_tables(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [1.0, 0.0]), ("d", [0.0, 1.0]), ("e", None), (None, [1.0, 0.0])], "id string, v array<double>")
    got = [(r.src, r.dst, r.rank) for r in graphs.knn(df, "id", "v", 2).orderBy("src", "rank").collect()]
    assert got == [("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2), ("d", "a", 1), ("d", "b", 2)]
    assert graphs.knn(df.limit(0), "id", "v", 2).count() == 0 and graphs.knn(df.where("id = 'a'"), "id", "v", 2).count() == 0
    with pytest.raises(ValueError):
        graphs.knn(df, "id", "v", 2, "other")


def blobs(n, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, 4)) * 5
    x = np.stack([centres[i % 12] + r.standard_normal(4) * (0.2 + 0.1 * (i % 12)) if i % 10 else r.standard_normal(4) * 6 for i in range(n)])
    x[5:9] = x[4]
    return x


@pytest.mark.parametrize("n, piece, text", [(2000, density.PIECE, False), (300, 40, True)])
def test_density_clusters(spark, n, piece, text):
    x = blobs(n, 7)
    ids = [f"{i:06d}.SZ" if text else i for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], f"id {'string' if text else 'long'}, v array<double>")
    got = {r.id: (r.cluster_id, r.probability) for r in density.density_clusters(df, "id", "v", 8, piece=piece).collect()}
    label, strength = leaf_clusters(x, 8, 15)
    assert len(got) == n and max(label) >= 5 and -1 in label
    assert [got[i][0] for i in ids] == label
    assert np.allclose([got[i][1] for i in ids], strength, atol=1e-9)
    assert any(0 < p < 1 for p in strength)


def test_density_of_one_or_no_cluster(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.standard_normal((12, 2)))], "id long, v array<double>")
    assert {(x.cluster_id, x.probability) for x in density.density_clusters(df, "id", "v", 10).collect()} == {(-1, 0.0)}
    assert density.density_clusters(df.limit(0), "id", "v").count() == 0
    lone = df.where("id < 2").unionByName(spark.createDataFrame([(9, None)], "id long, v array<double>"))
    assert {(x.id, x.cluster_id) for x in density.density_clusters(lone, "id", "v").collect()} == {(0, -1), (1, -1), (9, -1)}


def test_spanning_forest(spark):
    r = np.random.default_rng(2)
    rows = sorted({(int(min(a, b)), int(max(a, b)), float(w)) for a, b, w in zip(r.integers(0, 60, 150), r.integers(0, 60, 150), r.integers(1, 6, 150)) if a != b})
    got = {(x.a, x.b): x.w for x in density.spanning_forest(spark.createDataFrame(rows + [(7, 7, 0.0)], "a long, b long, w double")).collect()}
    least: dict = {}
    for a, b, w in rows:
        least[a, b] = min(w, least.get((a, b), w))
    parent = list(range(60))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    want = {}
    for (a, b), w in sorted(least.items(), key=lambda y: (y[1], y[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want[a, b] = w
    assert got == want


def connected(edges, label):
    near: dict = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for c in set(label.values()):
        members = {v for v in label if label[v] == c}
        seen, stack = set(), [next(iter(members))]
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                stack += near.get(v, set()) & members
        if seen != members:
            return False
    return True


def test_communities_of_text_keys(spark):
    """Cliques in a ring, keys that are no numbers."""
    rows = [(f"{c:02d}{i}.SZ", f"{c:02d}{j}.SZ", 1.0) for c in range(6) for i in range(4) for j in range(i)] + [(f"{c:02d}0.SZ", f"{(c + 1) % 6:02d}1.SZ", 0.2) for c in range(6)]
    nodes = spark.createDataFrame([(f"{c:02d}{i}.SZ",) for c in range(6) for i in range(4)] + [("alone",)], "ts_code string")
    for refine in (False, True):
        got = {r.ts_code: r.community_id for r in communities.communities(edge_frame(spark, rows, "string"), nodes, "ts_code", refine=refine).collect()}
        assert len(got) == 25 and sorted(set(got.values())) == list(range(7))
        assert all(got[f"{c:02d}{i}.SZ"] == got[f"{c:02d}0.SZ"] for c in range(6) for i in range(4))
    spectral = clusters.spectral_clusters(edge_frame(spark, rows, "string"), 3, "ts_code").collect()
    assert len(spectral) == 24 and all(r.ts_code.endswith(".SZ") for r in spectral)


def test_refined_communities_are_connected(spark):
    """A star's centre that is drawn elsewhere leaves its leaves apart: only the refined form parts them."""
    r = np.random.default_rng(11)
    rows = sorted({(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 40, (70, 2)) if a != b})
    rows = [(a, b, 1.0) for a, b in rows]
    nodes = spark.range(40).coalesce(1)
    e = edge_frame(spark, rows)
    got = {x.id: x.community_id for x in communities.communities(e, nodes, "id", refine=True).collect()}
    assert connected(rows, got)
    one = sequential_communities(e.toPandas())
    value = lambda label: clusters.modularity(e, spark.createDataFrame(list(label.items()), "id long, c long"), "id", "c").first()[0]
    assert value(got) > value(one) - 0.03
    # the part that refining rests on: labels whose nodes aren't connected are parted
    split = {x.id: x.label for x in communities.connected_parts(e, spark.range(40).select("id", (F.col("id") % 2).alias("label"))).collect()}
    assert connected(rows, split)


def test_tables_of_iterations_go(spark):
    from panelforge.plans.stages import exists

    with iteration(spark) as kept:
        inner = cut(spark.range(3))
        path = inner.inputFiles()[0].rsplit("/", 2)[0]
        out = kept(inner.selectExpr("id + 1 as id"))
    assert not exists(spark, path) and sorted(r.id for r in out.collect()) == [1, 2, 3]


def snapshot(spark, n=60):
    r = np.random.default_rng(3)
    rows = []
    for i in range(n):
        f = r.standard_normal(5)
        rows.append((f"{i:06d}.SZ", "20260423", f"i{i % 4}", f"j{i % 8}", *[float(v) + 5 for v in f]))
    names = ["total_mv", "pb", "realized_vol_20d", "debt_to_assets", "roe"]
    return spark.createDataFrame(rows, "ts_code string, trade_date string, l1_name string, l2_name string, " + ", ".join(f"{c} double" for c in names)).coalesce(2)


def bars(spark, n=60):
    r = np.random.default_rng(4)
    return spark.createDataFrame([(f"{i:06d}.SZ", f"2026{4 + d // 28:02d}{1 + d % 28:02d}", float(10 + r.random()), 100.0, 1000.0) for i in range(n) for d in range(30)], "ts_code string, trade_date string, close double, vol double, amount double").coalesce(2)


def views(spark, n=60):
    r = np.random.default_rng(6)
    return spark.createDataFrame([(f"{i:06d}.SZ", (np.eye(4)[i % 4] * 3 + r.standard_normal(4) * 0.2).tolist()) for i in range(n)], "ts_code string, embedding array<double>").coalesce(2)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The stages for a way to cluster, and where all of them run: what they share is built once."""
    vectors = views(spark).withColumn("embedding", F.expr("transform(embedding, x -> x / sqrt(aggregate(embedding, 0D, (s, y) -> s + y * y)))"))
    tables = cut(snapshot(spark)), cut(bars(spark)), {"full_text": cut(vectors)}
    return lambda method: StagedJob(*tables, levels=("l1_name", "l2_name"), method=method, n_clusters=4, k_semantic=6, k=6, top=6, dates=20, least_rows=1).stages()[:7], f"file://{tmp_path_factory.mktemp('staged')}/s"


@pytest.mark.parametrize("method", ["kmeans", "density", "louvain", "leiden"])
def test_staged_job_by_each_method_on_text_keys(spark, staged, tmp_path, method):
    stages = staged[0](method)
    done = run_stages(spark, stages, staged[1], resume=True)
    labels = {r.ts_code: r.cluster_id for r in done["clustering"].collect()}
    assert len(labels) == 60 and all(isinstance(c, int) for c in labels.values()) and len(set(labels.values())) >= 2
    last = {r.stage: r.action for r in run_log(spark, staged[1]).collect() if json.loads(r.values) is not None}
    assert set(last) == {s.name for s in stages}
    if method == "density":
        assert min(labels.values()) >= -1
        with pytest.raises(InvalidValue):
            run_stages(spark, [Stage("c", lambda s, d: done["clustering"].withColumn("cluster_id", F.lit(-2)), (), stages[6].expects)], f"file://{tmp_path}/t")


def test_ways_to_cluster_share_the_stages_before(spark, staged):
    """Of all runs above, each stage ahead of the clusters was built once."""
    built = run_log(spark, staged[1]).where("action = 'built'").groupBy("stage").count().collect()
    counts = {r.stage: r["count"] for r in built}
    assert counts.pop("clustering") == 4 and set(counts.values()) == {1}


def test_manifests(spark, tmp_path):
    root, calls = f"file://{tmp_path}/m", []
    source = cut(spark.range(10))

    def job(least=2, scale=1, table=source):
        def first(s, done):
            calls.append("a")
            return table.where(F.col("id") >= least)

        def second(s, done):
            calls.append("b")
            return done["a"].select((F.col("id") * scale).alias("id"))

        def third(s, done):
            calls.append("c")
            return s.range(3)

        return [Stage("a", first, (), (at_least_rows(1),), {"least": least}, {"table": table}), Stage("b", second, ("a",), (), {"scale": scale}), Stage("c", third)]

    def run(**kw):
        calls.clear()
        done = run_stages(spark, job(**kw), root, resume=True)
        return "".join(calls), done["b"].agg(F.sum("id")).first()[0]

    assert run() == ("abc", 44) and run() == ("", 44)
    # what depends on a changed parameter is made again, and nothing else
    assert run(scale=2) == ("b", 88) and run(least=5, scale=2) == ("ab", 70)
    assert run(least=5, scale=2, table=cut(spark.range(11))) == ("ab", 90)
    # rows in another order and in other files are the same input
    assert run(least=5, scale=2, table=cut(spark.range(11).repartition(5).orderBy(F.desc("id")))) == ("", 90)
    with pytest.raises(MissingArtifact):
        run_stages(spark, job(least=4), root, only=["b"])
    run_stages(spark, job(least=5, scale=3, table=cut(spark.range(11))), root, only=["b"])
    m = {r.stage: r for r in manifests(spark, root).collect()}
    assert m["a"].rows == 6 and m["b"].columns == ["id"] and json.loads(m["b"].params) == {"scale": 3} and json.loads(m["b"].needs) == {"a": m["a"].fingerprint}
    with pytest.raises(InvalidValue):
        run_stages(spark, [Stage("d", lambda s, d: s.range(0), (), (at_least_rows(1),))], root)
    # an output that failed its check has no manifest, so it isn't resumed
    assert "d" not in {r.stage for r in manifests(spark, root).collect()}
    runs = run_log(spark, root)
    assert runs.where("action = 'failed'").count() == 2 and runs.where("action = 'kept' and stage = 'c'").count() >= 4
    assert rows_fingerprint(spark.range(2)) != rows_fingerprint(spark.range(2).unionByName(spark.range(2)).unionByName(spark.range(2)))


def test_vector_files(spark, tmp_path):
    n = 3000
    df = spark.range(n).select(F.col("id"), F.array(*[(F.col("id") * 3 + i).cast("float") for i in range(8)]).alias("v")).repartition(3)
    path = f"file://{tmp_path}/vectors"
    npy.write_npy(df, "id", "v", path, file_bytes=20_000)
    back = npy.read_records_npy(spark, path, split_bytes=4096)
    assert back.count() == n and back.where("embedding[0] <> cast(record_id as float) * 3 or size(embedding) <> 8").count() == 0
    single = f"{tmp_path}/one.npy"
    np.save(single, np.arange(40_000, dtype=">f8").reshape(10_000, 4))
    one = npy.read_npy(spark, single, split_bytes=32_000)
    # many tasks read one file, each from its own row on
    assert one.rdd.getNumPartitions() == 10 and one.where("embedding[3] <> pos * 4 + 3").count() == 0 and one.agg(F.count_distinct("pos")).first()[0] == 10_000
    assert npy.read_npy(spark, single, "pos long").columns == ["pos"] and npy.read_npy(spark, single, "pos long").count() == 10_000
    # files that no committed task wrote aren't listed
    np.save(tmp_path / "vectors" / "part-stray.npy", np.zeros((5, 8), np.float32))
    assert npy.read_npy(spark, path).count() == n
    for bad in (np.zeros(3), np.asfortranarray(np.zeros((3, 2)))):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(Exception, match="isn't a matrix"):
            npy.read_npy(spark, f"{tmp_path}/bad.npy").count()
    np.save(tmp_path / "none.npy", np.zeros((0, 4), np.float32))
    assert npy.read_npy(spark, f"{tmp_path}/none.npy").count() == 0
    whole = (tmp_path / "one.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-100])
    with pytest.raises(Exception, match="shorter"):
        npy.read_npy(spark, f"{tmp_path}/cut.npy").count()
    with pytest.raises(Exception, match="unlike lengths"):
        npy.write_npy(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>").coalesce(1), "id", "v", f"{tmp_path}/uneven")
    assert shared_root(spark)


def test_components_still_agree(spark):
    e = edge_frame(spark, [(i, i + 1, 1.0) for i in range(30)] + [(40, 41, 1.0)])
    got = {r.id: (r.component, r.size) for r in metrics.connected_components(e, spark.range(43).coalesce(1), "id").collect()}
    assert got[30] == (0, 31) and got[41] == (40, 2) and got[42] == (42, 1)


def test_quantiles_by_narrowing_ranges(spark):
    r = np.random.default_rng(9)
    rows = [(int(g) if g < 3 else None, float(a), float(b) if i % 7 else None) for i, (g, a, b) in enumerate(zip(r.integers(0, 4, 800), r.lognormal(0, 8, 800), r.integers(0, 5, 800)))]
    rows += [(9, 1e308, None), (9, -1e308, None), (9, 5e-324, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(5)
    points = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {(x.g, x.column): (x.n, x.q) for x in exact_quantiles(df, ["a", "b"], points, ["g"], steps=7).collect()}
    want = df.groupBy("g").agg(*[F.array(*[F.percentile(c, F.lit(p)) for p in points]).alias(c) for c in ("a", "b")], F.count("a").alias("na"), F.count("b").alias("nb")).collect()
    assert len(got) == 2 * len(want) - 1
    for w in want:
        for c, n in (("a", w.na), ("b", w.nb)):
            if n:
                assert got[w.g, c][0] == n and np.allclose(got[w.g, c][1], w[c], rtol=1e-12, atol=0), (w.g, c)
    whole = one_row(exact_quantiles(df.where("g <> 9"), ["a", "b"], [0.25]), ["a", "b"], "q_").first()
    assert np.allclose([whole.q_a[0], whole.q_b[0]], df.where("g <> 9").agg(F.percentile("a", F.lit(0.25)), F.percentile("b", F.lit(0.25))).first())
    assert exact_quantiles(df.limit(0), ["a"], points).count() == 0 and one_row(exact_quantiles(df.limit(0), ["a"], points), ["a"], "q_").first().q_a is None
    clipped = winsorize_groups(df.where("g is null or g < 9"), ["a"], ["g"], 0.1, 0.9)
    assert clipped.count() == 800 and clipped.where("a is null").count() == 0
    plain = df.where("g is null or g < 9").select("g", cs.winsorized("a", ["g"], 0.1, 0.9).alias("a"))
    assert np.allclose(sorted(x.a for x in clipped.collect()), sorted(x.a for x in plain.collect()))


def test_asof_in_slices_of_a_hot_key(spark):
    """One key with nearly all rows; slices without a match, ties, missing keys and dates."""
    left = spark.range(3000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).when(F.col("id") % 101 == 0, None).otherwise(-1).alias("k"), F.when(F.col("id") % 37 > 0, F.expr("date_add(date'2020-01-01', cast((id * 7919) % 1500 as int))")).alias("at"))
    right = spark.range(600).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("k"), F.expr("date_add(date'2020-01-01', cast((id * 6007) % 1400 as int) + if(id % 3 = 0, 0, 200))").alias("told"), (F.col("id") % 17).alias("v"), F.col("id").alias("tie"))
    right = right.where("month(told) not in (3, 4, 5)")
    plain = rel.asof_join(left, right, "k", "at", "told", ["v", "tie"], tie="tie")
    for slices in (F.year, lambda c: F.date_trunc("month", c)):
        sliced = rel.asof_join(left, right, "k", "at", "told", ["v", "tie"], tie="tie", slices=slices)
        assert sliced.columns == plain.columns and sorted(map(str, sliced.collect())) == sorted(map(str, plain.collect()))
    late = rel.asof_join(left, right, "k", "at", "told", ["v"], tolerance_days=20, tie="tie", slices=F.year)
    assert sorted(map(str, late.collect())) == sorted(map(str, rel.asof_join(left, right, "k", "at", "told", ["v"], tolerance_days=20, tie="tie").collect()))
    assert plain.where("v is not null").count() > 2000


@pytest.mark.parametrize("signed, least", [(True, None), (True, 0.1), (False, None)])
def test_masked_correlation(spark, signed, least):
    r = np.random.default_rng(12)
    n, t = 60, 40
    x = r.standard_normal((n, 3)) @ r.standard_normal((3, t)) + 0.5 * r.standard_normal((n, t)) + 1000
    x[r.random((n, t)) < 0.4] = np.nan
    x[5] = 7.0
    x[6, 3:] = np.nan
    rows = [(f"e{i:03d}", int(d), float(x[i, d])) for i in range(n) for d in range(t) if not np.isnan(x[i, d])]
    long = spark.createDataFrame([*rows, ("e000", 99, None)], "id string, day int, ret double").repartition(4)
    got = {(g.src, g.dst): (g.weight, g.rank) for g in graphs.correlation_edges(long, "id", "day", "ret", 4, least, signed).collect()}
    want = {}
    for i in range(n):
        found = []
        for j in range(n):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if i != j and both.sum() > 1:
                a, b = x[i][both] - x[i][both].mean(), x[j][both] - x[j][both].mean()
                w = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9) if a @ a > 1e-15 and b @ b > 1e-15 else 0.0
                if least is None or w >= least:
                    found.append((-(w if signed else abs(w)), f"e{j:03d}", w))
        for rank, (_, name, w) in enumerate(sorted(found)[:4], 1):
            want[f"e{i:03d}", name] = (w, rank)
    assert got.keys() == want.keys() and all(abs(got[p][0] - want[p][0]) < 1e-7 and got[p][1] == want[p][1] for p in want)
    assert graphs.correlation_edges(long.limit(0), "id", "day", "ret", 4).count() == 0


def test_core_numbers_with_hubs_and_long_paths(spark, monkeypatch):
    r = np.random.default_rng(13)
    rows = {(int(min(a, b)), int(max(a, b))) for a, b in zip(r.integers(0, 80, 300), r.integers(0, 80, 300)) if a != b} | {(0, i) for i in range(1, 80)} | {(i, i + 1) for i in range(100, 5000)}
    e = edge_frame(spark, [(a, b, 1.0) for a, b in rows])
    near: dict = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left, want, k = {v: set(x) for v, x in near.items()}, {}, 0
    while left:
        v = min(left, key=lambda y: len(left[y]))
        k = max(k, len(left[v]))
        want[v] = k
        for u in left.pop(v):
            left[u].discard(v)
    for hub in (10**6, 20):
        monkeypatch.setattr(metrics, "HUB", hub)
        got = {x.id: x.core for x in metrics.core_numbers(e, spark.range(5002).coalesce(1), "id").collect()}
        assert all(got[v] == want.get(v, 0) for v in range(5002))
    # what is looked at follows what changes: on a path two nodes a round, not all
    src = np.repeat(np.arange(1000), 2)[1:-1]
    looked = []
    plain = metrics.h_index
    monkeypatch.setattr(metrics, "h_index", lambda values, first: looked.append(len(first)) or plain(values, first))
    nodes, now = metrics.settled(src, np.where(np.arange(len(src)) % 2 == 0, src + 1, src - 1), np.full(len(src), 2))
    assert (now == 1).all() and len(nodes) == 1000 and sum(looked) < 5 * 1000


@pytest.mark.parametrize("piece", [200_000, 700])
def test_communities_settle_in_pieces(spark, monkeypatch, piece):
    """a few tables a level instead of some for each round; the same quality when the graph is many pieces."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 120, (2, 900))
    keep = (a != b) & ((a // 20 == b // 20) | (rng.random(900) < 0.15))
    rows = sorted({(int(min(x, y)), int(max(x, y)), 1.0) for x, y in zip(a[keep], b[keep])})
    e = edge_frame(spark, rows, "long").cache()
    made = []
    monkeypatch.setattr(communities, "PIECE", piece)
    monkeypatch.setattr(communities, "cut", lambda df, cut=communities.cut: made.append(1) or cut(df))
    x = e.toPandas()

    def q(label):
        m, k = x.weight.sum(), x.groupby("src").weight.sum()
        inside = x[x.src.map(label) == x.dst.map(label)].weight.sum() / m
        return inside - (k.groupby(k.index.map(label)).sum() ** 2).sum() / m**2

    for refine in (True,) if piece > 1000 else (False,):
        got = {r.id: r.community_id for r in communities.communities(e, spark.range(120), "id", refine=refine).collect()}
        assert len(got) == 120 and q(got) > 0.97 * q(sequential_communities(x, refine=refine))
    assert piece < 1000 or len(made) < 60


def test_communities_of_many_pieces_settle_in_few_rounds(spark, monkeypatch, caplog):
    """Half of the gaining nodes move at once, not the nodes of a piece again and again; what is left is one task's work."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 300, (2, 1500))
    keep = (a != b) & ((a // 30 == b // 30) | (rng.random(1500) < 0.4))
    e = edge_frame(spark, sorted({(int(min(x, y)), int(max(x, y)), 1.0) for x, y in zip(a[keep], b[keep])}), "long").cache()
    whole = [tuple(c) for c in e.toPandas()[["src", "dst", "weight"]].to_numpy()]
    monkeypatch.setattr(communities, "PIECE", 500)
    with caplog.at_level("INFO", "panelforge"):
        got = {r.id: r.community_id for r in communities.communities(e, spark.range(300), "id").collect()}
    told = [r.getMessage() for r in caplog.records if "communities: round" in r.getMessage()]
    levels = sum("round 0," in t for t in told)
    assert levels and len(told) <= 12 * levels and ", 0 nodes gain" in told[-1]
    k, m = dict.fromkeys(range(300), 0.0), sum(w for *_, w in whole)
    for x, _, w in whole:
        k[x] += w
    one = sequential_communities(e.toPandas())

    def q(label):
        vol = {}
        for x in k:
            if x in label:
                vol[label[x]] = vol.get(label[x], 0.0) + k[x]
        return sum(w for x, y, w in whole if label[x] == label[y]) / m - sum(v * v for v in vol.values()) / m**2

    assert len(got) == 300 and q(got) > 0.97 * q(one)


@pytest.mark.parametrize("signed, least", [(True, None), (False, 0.1)])
def test_correlations_of_pairs_of_groups(spark, monkeypatch, signed, least):
    """pairs of groups are compared once, for both of them; ties go by dst."""
    from panelforge.operators import correlations

    monkeypatch.setattr(correlations, "BLOCK_CELLS", 64)
    monkeypatch.setattr(correlations, "GROUP_CELLS", 150)
    rng = np.random.default_rng(7)
    x = np.where(rng.random((50, 8)) < 0.5, rng.integers(0, 4, (50, 8)) / 3.0, np.nan)
    rows = [(i, t, float(x[i, t])) for i in range(50) for t in range(8) if not np.isnan(x[i, t])]
    got = graphs.correlation_edges(spark.createDataFrame(rows, "id long, t long, v double"), "id", "t", "v", 3, least, signed).collect()
    r = np.round(correlations.masked_correlation(x, x), 9)
    want = set()
    for i in range(50):
        fits = [j for j in range(50) if j != i and r[i, j] > -np.inf and (least is None or r[i, j] >= least)]
        best = sorted(fits, key=lambda j: (-r[i, j] if signed else -abs(r[i, j]), j))[:3]
        want |= {(i, j, round(r[i, j] + 0.0, 6), n + 1) for n, j in enumerate(best)}
    assert {(g.src, g.dst, round(g.weight, 6), g["rank"]) for g in got} == want


def test_correlation_of_nearly_constant_series():
    """F8: series that differ in their last digits over the common dates aren't constant; those that don't are."""
    from panelforge.operators.correlations import masked_correlation

    nan = np.nan
    x = np.array([[0.5, 0.5 + 1e-9, nan, -3.0], [0.25, 0.25, 0.25, nan], [0.1, 0.1 + 1e-7, 0.1 + 5e-7, nan]])
    y = np.array([[1.0, 2.0, nan, nan], [1.0, 2.0, 4.0, nan]])
    got = masked_correlation(x, y)
    want = np.corrcoef([1.0, 2.0, 4.0], [0.0, 1.0, 5.0])[0, 1]
    assert abs(got[0, 0] - 1) < 1e-9 and got[1, 0] == got[1, 1] == 0 and abs(got[2, 1] - want) < 1e-6


def test_group_cliques_shuffle_no_pairs(spark, monkeypatch):
    """pairs come from the join alone, also with groups of many parts, missing levels and repeated ids."""
    monkeypatch.setattr(graphs, "CLIQUE_ROWS", 3)
    said = [(i, None if i % 7 == 0 else i % 4, i % 2) for i in range(20)]
    x = spark.createDataFrame(said, "id long, fine int, wide int")
    levels = [("wide", 0.4), ("fine", 1.0)]
    g = graphs.group_cliques(x, "id", levels)
    assert "Aggregate(keys=[src" not in g._jdf.queryExecution().executedPlan().toString()

    def want(rows):
        out = {}
        for a, f, w in rows:
            for b, h, v in rows:
                weight = 1.0 if f is not None and f == h else 0.4 if w == v else 0
                if a != b and weight:
                    out[a, b] = max(weight, out.get((a, b), 0))
        return out

    got = [tuple(r) for r in g.collect()]
    assert len(got) == len(set(got)) and {(a, b): w for a, b, w in got} == want(said)
    twice = [*said, (3, 0, 0)]
    got = [tuple(r) for r in graphs.group_cliques(spark.createDataFrame(twice, x.schema), "id", levels).collect()]
    assert len(got) == len(want(twice)) and {(a, b): w for a, b, w in got} == want(twice)


@pytest.mark.parametrize("metric, least", [("cosine", None), ("l2", None), ("inner", 0.5)])
def test_neighbours_are_sent_to_few_groups(spark, monkeypatch, metric, least):
    """Groups are as few as the tasks ask for, whatever the cells; vectors that aren't finite hide no others, long ones are compared exactly."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 30)
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    dealt = []
    groups = neighbours._groups
    monkeypatch.setattr(neighbours, "_groups", lambda *a: dealt.append(groups(*a)) or dealt[-1])
    x = np.random.default_rng(9).standard_normal((600, 12))
    x[30:60] = x[29]
    x[100] *= 1e18 if metric == "cosine" else 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, [float("nan")] * 12), (1001, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows + odd[: 1 if metric == "inner" else 2], "id long, v array<double>")
    got = {(g.src, g.dst, g.rank) for g in graphs.knn(df, "id", "v", 5, metric, least).collect()}
    want, _ = brute(list(range(600)), x, 5, metric, least, 1.0)
    assert got == want
    assert len({g for *_, g in dealt[0][0]}) <= 2 + np.sqrt(3 * spark.sparkContext.defaultParallelism)


def test_return_features_hold_two_orders(spark):
    """all windows by time share one order of an entity's rows, and those by sign have the other; columns stay in their places."""
    from panelforge.operators import timeseries

    x = spark.range(50).select((F.col("id") % 2).alias("e"), F.col("id").alias("t"), *[(F.col("id") * 7 % 11 + i).cast("double").alias(c) for i, c in enumerate(("low", "close", "high"), 1)])
    got = timeseries.return_features(x, "e", "t")
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Sort [") == 2
    names = [c.rsplit("_", 1)[0] for c in got.columns if c.endswith("_20")]
    assert names == ["ret", "reversal", "realized_vol", "downside_vol", "max_drawdown", "range"]
