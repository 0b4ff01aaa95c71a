"""Operators on hand-made inputs: ties, nulls, missing partners, empty tables, known graphs."""

from __future__ import annotations

import math
import re
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.errors import InvalidValue, MissingArtifact, NotSettled, RowMismatch
from panelforge.functions import scalars as sc
from panelforge.operators import alignment, clusters, graphs, metrics, neighbours, reports, text
from panelforge.operators import crosssection as cs
from panelforge.operators import relational as rel
from panelforge.operators import timeseries as ts
from panelforge.plans import stages
from panelforge.plans.stages import Stage, at_least_rows, run_stages
from panelforge.sources import io
from panelforge.sources.catalog import TableSpec, Warehouse
from panelforge.sources.dataset import SemanticDataset
from panelforge.streaming.ingest import current_version, incremental_load, loaded, merge_load, upsert


def edges(spark, pairs):
    rows = [(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))]
    return spark.createDataFrame(rows, "src long, dst long, weight double")


def nodes(spark, n):
    return spark.range(n)


def pairs(df, *cols):
    return {r[0]: r[1] if len(cols) == 2 else tuple(r)[1:] for r in df.select(*cols).collect()}


def test_asof_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5), ("c", 9), (None, 9)], "k string, at int")
    right = spark.createDataFrame([("a", 10, 1.0, 1), ("a", 10, 2.0, 2), ("a", 15, 3.0, 1), ("a", 21, 9.0, 1), ("b", 6, 4.0, 1), (None, 1, 7.0, 1)], "k string, told int, v double, tie int")
    got = {(r.k, r.at): r.v for r in rel.asof_join(left, right, "k", "at", "told", ["v"], tie="tie").collect()}
    assert got == {("a", 10): 2.0, ("a", 20): 3.0, ("b", 5): None, ("c", 9): None, (None, 9): None}
    assert rel.asof_join(left, right.limit(0), "k", "at", "told", ["v"]).where("v is null").count() == 5


def test_asof_tolerance(spark):
    left = spark.sql("select 1 as k, date'2020-03-01' as at")
    right = spark.sql("select 1 as k, date'2020-01-01' as told, 5 as v")
    assert rel.asof_join(left, right, "k", "at", "told", ["v"], tolerance_days=30).first().v is None
    assert rel.asof_join(left, right, "k", "at", "told", ["v"], tolerance_days=90).first().v == 5


def test_validity(spark):
    m = spark.createDataFrame([("a", 1, None, "x"), ("b", 1, 0, "x"), ("c", 1, 10, "x"), ("d", 1, 11, "x"), ("e", 1, None, "old"), ("e", 5, None, "new")], "k string, in_date int, out_date int, g string")
    assert sorted(r.k for r in rel.valid_at(m, F.lit(10)).collect()) == ["a", "b", "d", "e", "e"]
    f = spark.createDataFrame([(k, 10) for k in "abcdez"], "k string, day int")
    assert pairs(rel.membership_join(f, m, "k", "day", ["g"]), "k", "g") == {"a": "x", "b": "x", "c": None, "d": "x", "e": "new", "z": None}


def test_latest_and_keys(spark):
    x = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "c")], "k int, at int, v string")
    assert pairs(rel.latest_per_key(x, "k", ["at"]), "k", "v") == {1: None, 2: "c"}
    with pytest.raises(RowMismatch):
        rel.check_keys(x, x.where("k = 1"), "k")
    with pytest.raises(InvalidValue):
        rel.require_columns(x, ["nope"])


def test_percent_rank_ties_and_nulls(spark):
    x = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, None)], "i int, v double").withColumn("g", F.lit(1))
    assert pairs(x.select("i", cs.percent_rank("v", ["g"]).alias("p")), "i", "p") == {1: 0.5, 2: 0.5, 3: 1.0, 4: None}


def test_neutralize_edges(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, None, 1.0), (5, "c", 2.0), (6, "c", 2.0)], "i int, g string, v double")
    got = pairs(x.select("i", cs.neutralized(x, "v", "g").alias("z")), "i", "z")
    assert got[3] is None and got[4] is None and got[5] == 0.0 and math.isclose(got[2], 1 / math.sqrt(2))
    with pytest.raises(ValueError):
        cs.neutralized(x, "v", "g", how="other")


def test_winsorize_and_fill(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", None), (4, "a", 100.0)], "i int, g string, v double")
    assert pairs(cs.fill_missing(x, ["v"], "g"), "i", "v") == {1: 1.0, 2: 50.5, 3: 50.5, 4: 100.0}
    assert max(r.v for r in cs.winsorize_all(x, ["v"], 0.05, 0.95).where("v is not null").collect()) < 100


def test_rolling_needs_enough_rows(spark):
    x = spark.createDataFrame([("a", i, 1.0 + i % 3) for i in range(25)] + [("b", i, 1.0) for i in range(3)], "k string, t int, close double")
    y = ts.realized_vol(ts.returns(x, "k", "t", periods=[1]), "k", "t")
    assert y.where("k = 'b' and realized_vol_20 is not null").count() == 0
    assert y.where("k = 'a' and realized_vol_20 is not null").count() == 25 - 10
    last = pairs(ts.latest_price_features(x.withColumns({"vol": F.lit(1.0), "amount": F.lit(1.0)}), "k", "t"), "k", "ret_252")
    assert last["b"] == 0.0


def test_scalars(spark):
    x = spark.createDataFrame([(1, '["a","b"]', "High"), (2, '{"a":1}', "LOW"), (3, "broken", None), (4, None, "x")], "i int, j string, c string")
    got = pairs(x.select("i", sc.json_list_length(F.col("j")).alias("n"), sc.confidence_value(F.col("c")).alias("v")), "i", "n", "v")
    assert got == {1: (2, 1.0), 2: (0, 0.2), 3: (0, 0.0), 4: (0, 0.0)}
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in v.select(sc.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert v.select(sc.padded(F.col("v"), 3)).first()[0] == [3.0, 4.0, 0.0]


def test_knn_excludes_self_among_copies(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id long, v array<double>")
    got = {(r.src, r.dst): round(r.weight, 6) for r in graphs.knn(v, "id", "v", 1).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (3, 1): 0.0}
    assert graphs.knn(v, "id", "v", 2, min_sim=0.5).count() == 2


def test_knn_blocks_agree(spark, monkeypatch):
    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.standard_normal((60, 5)))], "id long, v array<double>")
    one = {tuple(x) for x in graphs.knn(v, "id", "v", 3).collect()}
    monkeypatch.setattr(neighbours, "PART_ROWS", 17)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 15)
    assert {tuple(x) for x in graphs.knn(v, "id", "v", 3).collect()} == one


def test_metrics_on_known_graphs(spark):
    e, n = edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)]), nodes(spark, 5)
    assert pairs(metrics.degrees(e, n, "id"), "id", "degree") == {0: 2, 1: 2, 2: 3, 3: 1, 4: 0}
    assert pairs(metrics.core_numbers(e, n, "id"), "id", "core") == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0}
    c = pairs(metrics.clustering_coefficient(e, n, "id"), "id", "clustering")
    assert c[0] == c[1] == 1.0 and math.isclose(c[2], 1 / 3) and c[3] == c[4] == 0.0
    assert pairs(metrics.connected_components(e, n, "id"), "id", "component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    b = pairs(metrics.betweenness(e, n, "id"), "id", "betweenness")
    assert math.isclose(b[2], 2 * 2 / (4 * 3)) and b[0] == b[3] == 0.0
    rank = pairs(metrics.pagerank(e, n, "id", normalize=True), "id", "pagerank")
    assert math.isclose(sum(rank.values()), 1) and max(rank, key=rank.get) == 2
    assert math.isclose(sum(pairs(metrics.eigenvector_centrality(e, n, "id"), "id", "eigenvector").values()), 1)


@pytest.mark.parametrize("piece", [metrics.PIECE, 0])
def test_eigenvector_of_a_long_path_needs_few_products(spark, monkeypatch, piece):
    """Power iteration needs thousands of rounds there; a task ranks a small graph by itself, a large one goes by joins."""
    monkeypatch.setattr(metrics, "PIECE", piece)
    path = [(i, i + 1) for i in range(29)]
    got = pairs(metrics.eigenvector_centrality(edges(spark, path), nodes(spark, 30), "id", rounds=60, tol=1e-9), "id", "eigenvector")
    want = np.sin(np.pi * np.arange(1, 31) / 31)
    assert np.abs(np.array([got[i] for i in range(30)]) - want / want.sum()).max() < 1e-7
    text = edges(spark, [(0, 1), (2, 3)]).select(F.concat(F.lit("n"), "src").alias("src"), F.concat(F.lit("n"), "dst").alias("dst"), "weight")
    got = pairs(metrics.eigenvector_centrality(text, nodes(spark, 5).select(F.concat(F.lit("n"), "id").alias("id")), "id", rounds=60), "id", "eigenvector")
    assert all(math.isclose(got[f"n{i}"], 0.25, rel_tol=1e-5) for i in range(4)) and 0 <= got["n4"] < 1e-5
    e, n = edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)]), nodes(spark, 5)
    rank = pairs(metrics.pagerank(e, n, "id", rounds=5, tol=0.0), "id", "pagerank")
    p, x = np.array([[0, 1, 1, 0, 0], [1, 0, 1, 0, 0], [1, 1, 0, 1, 0], [0, 0, 1, 0, 0], [0] * 5]), np.full(5, 0.2)
    for _ in range(5):
        x = 0.03 + 0.85 * (p / np.maximum(p.sum(axis=0), 1)) @ x
    assert np.abs(x - [rank[i] for i in range(5)]).max() < 1e-12


def test_communities_find_cliques(spark):
    clique = lambda a: [(a + i, a + j) for i in range(5) for j in range(i)]
    e, n = edges(spark, clique(0) + clique(5) + clique(10) + [(0, 5), (5, 10)]), nodes(spark, 16)
    for refine in (False, True):
        label = pairs(clusters.communities(e, n, "id", refine=refine), "id", "community_id")
        assert len({label[i] for i in range(15)}) == 3 and all(len({label[a + i] for i in range(5)}) == 1 for a in (0, 5, 10))
        q = clusters.modularity(e, spark.createDataFrame(list(label.items()), "id long, c long"), "id", "c").first()[0]
        assert q > 0.5


def test_parallel_communities_match_the_sequential_form(spark):
    """Modularity on a random graph with planted groups, against one node at a time."""
    from .sequential import sequential_communities

    r = random.Random(40)
    group = [i // 20 for i in range(120)]
    links = {(i, j) for i in range(120) for j in range(i) if r.random() < (0.3 if group[i] == group[j] else 0.02)}
    e, n = edges(spark, sorted(links)).coalesce(1), nodes(spark, 121).coalesce(1)
    q = lambda label: clusters.modularity(e, spark.createDataFrame(sorted(label.items()), "id long, c long"), "id", "c").first()[0]
    for refine in (False, True):
        mine = pairs(clusters.communities(e, n, "id", refine=refine), "id", "community_id")
        # a node without edges is alone, and communities are numbered
        assert list(mine.values()).count(mine[120]) == 1 and set(mine.values()) == set(range(1 + max(mine.values())))
        assert q(mine) > 0.95 * q(sequential_communities(e.toPandas(), refine=refine))


def test_components_of_long_paths(spark):
    r = random.Random(41)
    links = [(i, i + 1) for i in range(150)] + [(200 + r.randint(0, 90), 200 + r.randint(0, 90)) for _ in range(70)]
    links = [p for p in links if p[0] != p[1]]
    want = list(range(300))
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert pairs(metrics.connected_components(edges(spark, links), nodes(spark, 300), "id"), "id", "component") == dict(enumerate(want))


def test_iterations_that_do_not_settle_raise(spark):
    e, n = edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)]), nodes(spark, 5)
    with pytest.raises(NotSettled):
        metrics.pagerank(e, n, "id", rounds=5, tol=1e-12)
    with pytest.raises(NotSettled):
        metrics.eigenvector_centrality(e, n, "id", rounds=10, tol=1e-12)


def test_alignment(spark):
    snap = spark.createDataFrame([("a", "20240105"), ("a", "20240201"), ("b", "20240105"), ("a", "20231201"), (None, "20240105")], "ts_code string, trade_date string")
    records = spark.createDataFrame([("a", "2024-01-01", "r1"), ("a", "2024-01-10", "r2"), ("a", "2024-03-01", "r3")], "stock_code string, asof_date string, record_id string")
    got = {(r.ts_code, r.trade_date): r.record_id for r in alignment.record_ids_asof(snap, records).collect()}
    assert got == {("a", "20240105"): "r1", ("a", "20240201"): "r2", ("b", "20240105"): None, ("a", "20231201"): "a_20231201", (None, "20240105"): None}
    assert {r.record_id for r in alignment.record_ids_asof(snap.where("ts_code = 'b'"), records.limit(0)).collect()} == {"b_20240105"}
    v = alignment.numeric_vectors(spark.createDataFrame([(1, 1.0, None), (2, 3.0, None)], "id int, x double, y double"), ["x", "y"])
    assert np.allclose(sorted(r.embedding for r in v.collect()), [[-1, 0], [1, 0]])
    x = alignment.view_features(spark.createDataFrame([(1, "apple pie"), (2, "plum")], "id int, body string"), "id", "body", {}, 4)
    assert all(math.isclose(np.linalg.norm(r.embedding), 1) for r in x.collect())
    with pytest.raises(InvalidValue):
        alignment.view_features(x, "id", "absent", {}, 4)


def test_dataset(spark):
    d = SemanticDataset(spark.createDataFrame([("a", 1), ("b", 2)], "record_id string, n int"), {"v": spark.createDataFrame([("a", [3.0, 4.0])], "record_id string, embedding array<double>")})
    assert d.list_views() == ["v"] and d.has_view("v") and not d.has_view("w") and d.num_rows() == 2
    assert d.record("b").first().n == 2 and np.allclose(d.view("v", normalize=True).first().embedding, [0.6, 0.8])
    with pytest.raises(KeyError):
        d.record("z")
    with pytest.raises(MissingArtifact):
        d.view("w")


def test_records_are_checked(spark):
    full = spark.createDataFrame([tuple("x" for _ in io.RECORD_COLUMNS)], ", ".join(f"{c} string" for c in io.RECORD_COLUMNS))
    assert set(io.RECORD_JSON_COLUMNS) <= set(io.checked_records(full).columns)
    with pytest.raises(InvalidValue):
        io.checked_records(full.drop("full_text"))


def test_stage_expectations(spark):
    v = spark.createDataFrame([(1, [0.6, 0.8], "x"), (2, [1.0, 0.0], "y")], "id int, v array<double>, g string")
    good = [stages.has_columns("id", "v"), stages.never_null("g"), stages.least_at_least("id", 1), stages.unit_length("v"), stages.values_of("g", "x", "y"), stages.mean_sum_above("id", "g", 1.0)]
    stages.validate(Stage("s", None, (), tuple(good)), v)
    for bad in (stages.has_columns("z"), stages.least_at_least("id", 2), stages.values_of("g", "z"), stages.mean_sum_above("id", "g", 2.0)):
        with pytest.raises(InvalidValue):
            stages.validate(Stage("s", None, (), (bad,)), v)
    with pytest.raises(InvalidValue):
        stages.validate(Stage("s", None, (), (stages.unit_length("v"),)), v.selectExpr("array(1.0D, 1.0D) as v"))


def test_command_line(spark, tmp_path, capsys):
    from panelforge import cli

    assert cli.main(["list"]) == 0 and "g1_knn" in capsys.readouterr().out
    assert cli.main(["query", "--data", "/root/testdata/sf0.001", "--query", "s10_latest_date", "--out", f"{tmp_path}/q"]) == 0
    assert spark.read.parquet(f"{tmp_path}/q").count() == 1
    with pytest.raises(InvalidValue):
        cli.main(["query", "--data", "x", "--query", "nothing"])
    records = spark.createDataFrame([tuple(f"{c}{i % 3}" if c != "record_id" else f"r{i}" for c in io.RECORD_COLUMNS) for i in range(12)], ", ".join(f"{c} string" for c in io.RECORD_COLUMNS))
    records.write.parquet(f"{tmp_path}/records.parquet")
    io.save_config({"paths": {"records": f"{tmp_path}/records.parquet", "output": f"{tmp_path}/out"}}, f"{tmp_path}/c.yaml")
    assert cli.main(["check", "--config", f"{tmp_path}/c.yaml"]) == 0 and "rows=12" in capsys.readouterr().out


def test_cluster_scores(spark):
    x = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (2, 0), (2, 0)], "a int, b int")
    assert clusters.purity(x, "a", "b").first()[0] == 1.0
    assert math.isclose(clusters.nmi(x, "a", "a").first()[0], 1.0)
    r = np.random.default_rng(2)
    points = np.concatenate([r.normal(0, 0.1, (20, 2)), r.normal(5, 0.1, (20, 2))])
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    label = clusters.kmeans(v, "id", "v", 2)
    assert clusters.silhouette(v, label, "id", "v").first()[0] > 0.9
    assert clusters.separation(v, label, "id", "v").first().davies_bouldin < 0.2
    dense = pairs(clusters.density_clusters(v, "id", "v", 5), "id", "cluster_id")
    assert len(set(dense.values()) - {-1}) >= 2
    assert not {dense[i] for i in range(20)} & {dense[i] for i in range(20, 40)} - {-1}


def test_fusion(spark):
    a, b = edges(spark, [(0, 1)]), edges(spark, [(0, 1), (1, 2)])
    got = {(r.src, r.dst): r.weight for r in graphs.fuse({"a": a, "b": b}, {"a": 1.0, "b": 3.0}).collect()}
    assert got[0, 1] == 1.0 and got[1, 2] == got[2, 1] == 0.75
    with pytest.raises(ValueError):
        graphs.fuse({"a": a}, {"b": 1.0})
    s = pairs(graphs.smooth(a, spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 5.0)], "id long, x double"), "id", ["x"], 0.5, 1), "id", "x")
    assert s == {0: 2.0, 1: 2.0, 2: 2.5}


def test_text_embedding(spark):
    x = spark.createDataFrame([(1, "apple banana"), (2, "apple banana"), (3, "cherry plum plum"), (4, None)], "id int, t string")
    got = pairs(text.text_embedding(x, "id", "t", 4, 50), "id", "embedding")
    assert np.allclose(got[1], got[2]) and abs(np.dot(got[1], got[3])) < 1e-6 and not any(got[4])


def test_reports(spark):
    x = spark.createDataFrame([(1, None, 1.0), (2, "a", None), (3, "a", float("nan")), (4, "b", float("inf"))], "i int, g string, v double")
    q = pairs(reports.column_quality(x), "column_name", "missing", "infinite", "level")
    assert q == {"i": (0, 0, "OK"), "g": (1, 0, "MEDIUM"), "v": (2, 1, "MEDIUM")}
    assert reports.histogram(x.where("i < 3"), "v", 4).count() == 1
    assert reports.column_quality(x.limit(0)).count() == 3


def test_warehouse_checks(spark, tmp_path):
    spec = TableSpec("t", ("k",), (("k", "int"), ("v", "string")))
    spark.createDataFrame([(1, "a"), (2, None), (3, "c")], spec.schema).write.parquet(f"{tmp_path}/t.parquet")
    w = Warehouse(spark, str(tmp_path), {"t": spec})
    assert [r.k for r in w.fetch("t", ["k"], {"k": [1, 3]}, order_by=["k"]).collect()] == [1, 3]
    assert w.fetch("t", filters={"v": None}).count() == 1 and w.fetch("t", filters={"k": []}).count() == 0
    for bad in (lambda: w.fetch("u"), lambda: w.fetch("t", ["x"])):
        with pytest.raises(InvalidValue):
            bad()


def test_stages_resume_and_check(spark, tmp_path):
    calls = []

    def build(s, done):
        calls.append(1)
        return s.range(3)

    stages = [Stage("a", build, (), (at_least_rows(2),)), Stage("b", lambda s, d: d["a"].where("id > 0"), ("a",))]
    for _ in range(2):
        assert run_stages(spark, stages, f"file://{tmp_path}/s", resume=True)["b"].count() == 2
    assert len(calls) == 1
    with pytest.raises(InvalidValue):
        run_stages(spark, [Stage("a", build, (), (at_least_rows(9),))], f"file://{tmp_path}/u")
    with pytest.raises(MissingArtifact):
        run_stages(spark, stages[1:], f"file://{tmp_path}/w")


def test_sinks_round_trip(spark, tmp_path):
    io.write_layers({"a": edges(spark, [(0, 1)]), "b": edges(spark, [(1, 2), (2, 3)])}, f"{tmp_path}/layers")
    assert {k: v.count() for k, v in io.read_layers(spark, f"{tmp_path}/layers").items()} == {"a": 2, "b": 4}
    x = spark.createDataFrame([("1", "é,\"q\"")], "record_id string, full_text string")
    io.write_table(x, f"{tmp_path}/t", csv=True)
    assert io.read_records(spark, f"{tmp_path}/t.csv").collect() == x.collect()
    with pytest.raises(InvalidValue):
        io.read_records(spark, "x.txt")
    io.save_config({"a": [1, 2]}, f"{tmp_path}/c.yaml")
    assert io.load_config(f"{tmp_path}/c.yaml") == {"a": [1, 2]}


def test_vector_views(spark, tmp_path):
    import json

    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "v-all.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    (tmp_path / "v" / "v-all.meta.json").write_text(json.dumps({"row_ids": ["x", "y", "z"]}))
    assert pairs(io.read_vector_views(spark, str(tmp_path), ["v", "v"]), "record_id", "embedding") == {"x": [0.0, 1.0], "y": [2.0, 3.0], "z": [4.0, 5.0]}


def test_incremental_load(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 0, "z")], "k int, at int, v string").write.parquet(src)
    load = lambda: incremental_load(spark, src, "k int, at int, v string", f"{tmp_path}/out", f"{tmp_path}/cp", ["k"], "at").awaitTermination()
    load()
    spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, at int, v string").write.mode("append").parquet(src)
    load()
    assert pairs(spark.read.parquet(f"{tmp_path}/out/v1"), "k", "v") == {1: "c", 2: "b", 3: "d"}
    assert upsert(spark.range(0).selectExpr("id as k", "id as at"), spark.range(2).selectExpr("id as k", "id as at"), ["k"], "at").count() == 2


def test_merge_load_rewrites_touched_buckets(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "k int, g string, at int, v string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        merge_load(spark, src, schema, out, f"{tmp_path}/cp", ["k", "g"], "at", buckets=4).awaitTermination()
        return {(r.k, r.g): (r["at"], r.v) for r in loaded(spark, out).collect()}

    assert current_version(spark, out) is None
    many = [(i, "a", 1, f"v{i}") for i in range(40)]
    want = {(k, g): (at, v) for k, g, at, v in many} | {(1, None): (None, "lone")}
    assert arrive([*many, (1, None, None, "lone"), (0, "a", None, "older"), (0, "a", 0, "old")]) == want
    first = {p.name for p in (tmp_path / "out" / "data" / "v0").glob("_bucket=*")}
    assert len(first) == 4
    # later, older and equal times, a key of NULLs
    want |= {(0, "a"): (2, "late"), (1, None): (5, "known"), (2, "a"): (1, "tie")}
    assert arrive([(0, "a", 2, "late"), (3, "a", 0, "stale"), (1, None, 5, "known"), (2, "a", 1, "tie")]) == want
    assert {(r.k, r.g): r.v for r in loaded(spark, out, 0).collect()}[0, "a"] == "v0"
    want |= {(0, "a"): (3, "later")}
    assert arrive([(0, "a", 3, "later")]) == want and current_version(spark, out) == 2
    assert len(list((tmp_path / "out" / "data" / "v2").glob("_bucket=*"))) == 1
    assert sorted(p.name for p in (tmp_path / "out" / "pointers").iterdir()) == ["v1", "v2"]
    # a pointer without its end, as a lost driver leaves it, is no version
    shutil.copytree(tmp_path / "out" / "pointers" / "v2", tmp_path / "out" / "pointers" / "v3")
    (tmp_path / "out" / "pointers" / "v3" / "_SUCCESS").unlink()
    assert current_version(spark, out) == 2


def test_core_numbers_of_a_long_path(spark):
    """The change moves one node a round from each end: over a hundred rounds."""
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(219) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long, weight double").coalesce(1)
    assert {r.core for r in metrics.core_numbers(edges, spark.range(220).coalesce(1), "id").collect()} == {1}


def test_knn_graph_is_compared_once(spark):
    """What reads the graph reads a table and compares no vectors again."""
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, v array<double>")
    g = graphs.knn_graph(v, "id", "v", 2, -1.0, mutual=False)
    assert "MapInArrow" not in g._jdf.queryExecution().toString() and g.count()


def test_tfidf_counts_before_it_shuffles(spark):
    """terms by id go through no shuffle; the vocabulary is the same with n-grams of frequent words only, and with ids that repeat."""
    said = ["a1 b1 a1 b1 c1", "a1 b1 d1 e1", "c1 a1 b1 a1", None, "zz yy xx ww"]
    x = spark.createDataFrame(list(enumerate(said)), "id int, t string")
    for size in (3, 5, 50):
        w = text.tfidf(x, "id", "t", size)
        assert "Exchange hashpartitioning(id" not in w._jdf.queryExecution().executedPlan().toString()
        n = text.terms(x, "id", "t")
        total = n.groupBy("term").agg({"n": "sum"}).collect()
        want = {t for t, _ in sorted(((r[0], r[1]) for r in total), key=lambda r: (-r[1], r[0]))[:size]}
        got = {(r.id, r.term): r.weight for r in w.collect()}
        assert {t for _, t in got} == want and set(got) == {(r.id, r.term) for r in n.collect() if r.term in want}
        assert all(abs(sum(v * v for (i, _), v in got.items() if i == k) - 1) < 1e-9 for k in {i for i, _ in got})
    twice = spark.createDataFrame([(1, "a1 b1"), (1, "b1 a1"), (2, "a1")], "id int, t string")
    got = {(r.id, r.term) for r in text.tfidf(twice, "id", "t", 9).collect()}
    assert got == {(1, "a1"), (1, "b1"), (1, "a1 b1"), (1, "b1 a1"), (2, "a1")}


@pytest.mark.parametrize("window", [2, 5, 252])
def test_beta_by_blocks(spark, window):
    """no frame slides over the window's rows, and values are those of the plain rolling form, with gaps, constant markets and other series beside."""
    rng = np.random.default_rng(12)
    rows = [(k, t, float(rng.standard_normal() * 0.02) if rng.random() > 0.2 else None) for k, n in (("a", 700), ("b", 252), ("c", 3), ("d", 11)) for t in range(n) if t % 17 or k == "a"]
    rows = [(k, t, None if k == "a" and 300 <= t < 310 else r) for k, t, r in rows]
    x = spark.createDataFrame(rows, "k string, t int, ret_1 double").repartition(3)
    markets = {t: None if t % 23 == 0 else 0.01 if 40 <= t < 60 else 1e6 + float(rng.standard_normal()) for t in range(700)}
    given = spark.createDataFrame(list(markets.items()), "t int, market double")
    means = {t: np.mean([r for _, u, r in rows if u == t and r is not None] or [np.nan]) for t in markets}
    for market, of in ((None, {t: None if np.isnan(m) else m for t, m in means.items()}), (given, markets)):
        y = ts.beta(x, market, "k", "t", window=window)
        plan = y._jdf.queryExecution().toString()
        assert "RowFrame" in plan and not re.search(r"RowFrame, -\d+, currentrow", plan)
        got = {(r.k, r.t): r.beta for r in y.collect()}
        assert len(got) == len(rows)
        for k in "abcd":
            series = sorted((t, r) for q, t, r in rows if q == k)
            for i, (t, _) in enumerate(series):
                both = np.array([(of[u], r) for u, r in series[max(0, i - window + 1) : i + 1] if r is not None and of[u] is not None]).reshape(-1, 2)
                if not len(both):
                    assert got[k, t] is None
                    continue
                m, r = (both - both.mean(axis=0)).T
                want = 0.0 if (both[:, 0] == both[0, 0]).all() else (m @ r) / (m @ m)
                assert got[k, t] == pytest.approx(want, rel=1e-6, abs=1e-9)
