"""Isolation forest, attribution and importances: properties and brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from procsift.operators import attribution, forest, importance
from procsift.sources.unified import column_or_null

NAMES = ["a", "b", "c"]


def points(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.gauss(0, 1), float(rng.randrange(3)), rng.random()) for i in range(n - 1)]
    rows.append((n - 1, 25.0, 9.0, -8.0))  # one clear outlier
    return spark.createDataFrame(rows, "event_id bigint, a double, b double, c double")


@pytest.fixture(scope="module")
def fitted(spark):
    return forest.fit_and_score(points(spark), trees=30, max_samples=64, columns=NAMES)


def test_average_path():
    assert forest.average_path(np.array([0, 1, 2])).tolist() == [0.0, 0.0, 1.0]
    assert float(forest.average_path(256)) == pytest.approx(10.2447, abs=1e-3)


def test_model_shape(fitted):
    model, _ = fitted
    frame = model.node_frame
    assert frame["tree"].nunique() == 30
    roots = frame[frame["node"] == 0]
    assert (roots["size"] == 64).all()
    leaves = frame[frame["feature"] < 0]
    assert (leaves.groupby("tree")["size"].sum() == 64).all()
    assert frame["depth"].max() <= 6
    for _, tree in frame.groupby("tree"):
        sizes = dict(zip(tree["node"], tree["size"]))
        for node in tree[tree["feature"] >= 0]["node"]:
            assert sizes[node] == sizes[2 * node + 1] + sizes[2 * node + 2]


def test_scores_and_contamination(fitted):
    model, scored = fitted
    rows = scored.orderBy("anomaly_score").collect()
    assert rows[0].event_id == 399
    assert len(rows) == 400 and sum(r.is_anomaly for r in rows) == 20
    assert all(r.is_anomaly == (r.anomaly_score < 0) for r in rows)


def plain_path(tree, row):
    nodes = {r.node: r for r in tree.itertuples()}
    node = nodes[0]
    while node.feature >= 0:
        node = nodes[2 * node.node + (1 if row[node.feature] <= node.cut else 2)]
    return node.depth + float(forest.average_path(node.size))


def test_scores_match_a_plain_walk(spark, fitted):
    model, scored = fitted
    rows = points(spark).limit(25).collect()
    got = {r.event_id: r.anomaly_score for r in scored.collect()}
    trees = [t for _, t in model.node_frame.groupby("tree")]
    for r in rows:
        mean = np.mean([plain_path(t, (r.a, r.b, r.c)) for t in trees])
        raw = -(2 ** (-mean / float(forest.average_path(64))))
        assert got[r.event_id] == pytest.approx(raw - model.offset, abs=1e-12)


def test_same_seed_same_forest_whatever_the_partitions(spark):
    one, first = forest.fit_and_score(points(spark).coalesce(1), trees=10, max_samples=32, columns=NAMES)
    two, second = forest.fit_and_score(points(spark).repartition(7), trees=10, max_samples=32, columns=NAMES)
    pd.testing.assert_frame_equal(one.node_frame, two.node_frame)
    assert first.orderBy("event_id").collect() == second.orderBy("event_id").collect()
    other = forest.fit(points(spark), trees=10, max_samples=32, columns=NAMES, seed=1)
    assert not other.node_frame.equals(one.node_frame)


def test_samples_are_exact_and_uniform_when_the_pool_is_thinned(spark):
    matrix = spark.range(40000).select(F.col("id").alias("event_id"), F.rand(1).alias("a"))
    samples = forest.tree_samples(matrix, 40000, 5, 16, 42)
    sizes = {r.tree: r["count"] for r in samples.groupBy("tree").count().collect()}
    assert sizes == {t: 16 for t in range(5)}
    assert samples.groupBy("tree").agg(F.count_distinct("event_id").alias("n")).where("n <> 16").isEmpty()
    many = forest.tree_samples(matrix, 40000, 200, 16, 42)
    mean = many.agg(F.avg("event_id")).first()[0]
    assert abs(mean - 20000) < 5 * 40000 / math.sqrt(12 * 3200)


def test_small_and_constant_data(spark):
    tiny = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "event_id bigint, a double")
    model, scored = forest.fit_and_score(tiny, trees=5, columns=["a"])
    assert model.sample_size == 3 and len({r.anomaly_score for r in scored.collect()}) == 1
    one, alone = forest.fit_and_score(tiny.limit(1), trees=3, columns=["a"])
    assert alone.first().anomaly_score == 0.0
    with pytest.raises(ValueError):
        forest.fit(tiny.where("a > 1"), columns=["a"])
    auto = forest.fit(points(spark), trees=5, max_samples="auto", contamination="auto", columns=NAMES)
    assert auto.offset == -0.5 and auto.sample_size == 256


def test_missing_values_count_as_zero(spark, fitted):
    model, _ = fitted
    df = spark.createDataFrame([(0, None, 1.0, None), (1, 0.0, 1.0, 0.0)], "event_id bigint, a double, b double, c double")
    rows = forest.score(df, model).collect()
    assert rows[0].anomaly_score == rows[1].anomaly_score


def test_too_large_a_model_is_refused(fitted):
    model, _ = fitted
    big = forest.Forest(model.nodes, 100_000, 4096, NAMES, 0.0, "0.05")
    with pytest.raises(ValueError, match="nodes"):
        big.tables()


def test_save_and_load(spark, fitted, tmp_path):
    model, _ = fitted
    forest.save_forest(model, str(tmp_path / "m"))
    loaded = forest.load_forest(spark, str(tmp_path / "m"))
    assert loaded.offset == model.offset and loaded.features == NAMES
    pd.testing.assert_frame_equal(loaded.node_frame, model.node_frame)
    assert forest.load_forest(spark, str(tmp_path / "absent")) is None
    broken = tmp_path / "broken" / "nodes"
    broken.mkdir(parents=True)
    (broken / "x.parquet").write_bytes(b"not parquet")
    assert forest.load_forest(spark, str(tmp_path / "broken")) is None


def test_trace_columns(spark):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.6)], "event_id bigint, anomaly_score double")
    events = spark.createDataFrame([(0, "cmd.exe")], "event_id bigint, process_image string")
    rows = forest.with_trace(scores, events).orderBy("event_id").collect()
    assert [r.process_image for r in rows] == ["cmd.exe", None]
    bare = forest.with_trace(scores, None)
    assert bare.first().source is None and dict(bare.dtypes)["timestamp"] == "timestamp_ntz"
    assert column_or_null(scores, "absent") is not None


# --- attribution --------------------------------------------------------------


def game(tree, row, known):
    """Expected path length when only the known features are used."""
    nodes = {r.node: r for r in tree.itertuples()}

    def value(at):
        node = nodes[at]
        if node.feature < 0:
            return node.depth + float(forest.average_path(node.size))
        left, right = 2 * at + 1, 2 * at + 2
        if node.feature in known:
            return value(left if row[node.feature] <= node.cut else right)
        return (value(left) * nodes[left].size + value(right) * nodes[right].size) / node.size

    return value(0)


def brute_force(model, row):
    n = len(model.features)
    phi = np.zeros(n)
    trees = [t for _, t in model.node_frame.groupby("tree")]
    for j in range(n):
        others = [i for i in range(n) if i != j]
        for k in range(n):
            for s in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                for t in trees:
                    phi[j] += weight * (game(t, row, {*s, j}) - game(t, row, set(s))) / len(trees)
    return phi


def test_attributions_are_the_shapley_values(spark, fitted):
    model, _ = fitted
    rows = points(spark).where("event_id in (0, 7, 399)")
    for r in attribution.attributions(rows, model).collect():
        assert r.attribution == pytest.approx(brute_force(model, (r.a, r.b, r.c)), abs=1e-9)


def test_attributions_add_up(spark, fitted):
    model, _ = fitted
    base = attribution.base_value(model)
    scale = float(forest.average_path(model.sample_size))
    both = attribution.attributions(forest.raw_scores(points(spark), model), model)
    for r in both.collect():
        mean = -math.log2(-r.raw_score) * scale
        assert base + sum(r.attribution) == pytest.approx(mean, abs=1e-9)


def test_explanations_are_extended_on_flagged_rows_only(spark, fitted):
    model, _ = fitted
    df = points(spark).where("event_id >= 396").withColumns(
        {
            "flagged": F.when(F.col("event_id") == 397, F.lit(None)).otherwise(F.col("event_id") != 396),
            "explanation": F.when(F.col("event_id") < 398, F.lit("—")).otherwise(F.lit("Flagged: x")),
        }
    )
    rows = {r.event_id: r.explanation for r in attribution.append_attributions(df, model).collect()}
    assert len(rows) == 4 and rows[396] == rows[397] == "—"
    assert rows[399].startswith("Flagged: x | Top features: ")
    assert attribution.append_attributions(df, None) is df
    assert attribution.append_attributions(df.drop("flagged"), model).columns == df.drop("flagged").columns
    assert attribution.append_attributions(df.drop("a"), model).columns == df.drop("a").columns


# --- importances --------------------------------------------------------------


def test_importances(spark):
    rng = random.Random(3)
    rows = [(float(i % 2), rng.random(), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, is_attack int")
    got = importance.rf_importance(df, ["a", "b"], trees=10, depth=3).collect()
    assert got[0].feature == "a" and sum(r.importance for r in got) == pytest.approx(1.0)
    assert importance.rf_importance(df.where("a = 1"), ["a", "b"]).count() == 0


def test_importances_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), int(a + 0.3 * b > 0.6)) for i, (a, b) in enumerate(rng.random((400, 2)))]
    df = spark.createDataFrame(rows, "event_id bigint, a double, b double, is_attack int")
    found = [
        importance.rf_importance(df.repartition(n), ["a", "b"], trees=10, depth=4).collect() for n in (1, 4, 13)
    ]
    assert found[0] == found[1] == found[2] and found[0][0]["feature"] == "a"


def test_importances_read_their_rows_once_for_the_fit(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    rows = [(i, float(i % 5), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id bigint, a double, is_attack int")
    got = importance.rf_importance(df.withColumn("a", counted("a")), ["a"], trees=3, depth=3).collect()
    assert [r.feature for r in got] == ["a"] and seen.value == len(rows)


def test_too_large_a_forest_is_refused_before_the_fit(spark):
    with pytest.raises(ValueError, match="nodes"):
        forest.fit_and_score(None, trees=100_000, max_samples=4096)


def test_snapshot_with_a_forest_survives_saving(spark, tmp_path):
    from procsift.plans.catalog import _prepped
    from procsift.operators.features import build_features, graph_table, pair_table
    from procsift.streaming.alerts import Snapshot, gate_events, load_snapshot, save_snapshot

    prepped = _prepped(spark, "/root/testdata/sf0.001").drop("value")
    model = forest.fit(build_features(prepped), trees=5)
    bounds = {"Critical": -0.1, "High": 0.0, "Medium": 0.1, "Low": 0.2}
    snapshot = Snapshot(graph_table(prepped), pair_table(prepped), bounds, 0.0, model)
    save_snapshot(snapshot, str(tmp_path / "s"))
    loaded = load_snapshot(spark, str(tmp_path / "s"))
    assert (loaded.bounds, loaded.threshold) == (bounds, 0.0)
    events = prepped.select("event_id", *[c for c in prepped.columns if c not in ("event_id",) and not c.endswith("_base")])
    one, two = (
        gate_events(events, s).select("event_id", "anomaly_score", "flagged").orderBy("event_id").collect()
        for s in (snapshot, loaded)
    )
    assert one == two and len(one) == prepped.count()
    with pytest.raises(ValueError, match="event_id"):
        gate_events(events.drop("event_id"), snapshot)
