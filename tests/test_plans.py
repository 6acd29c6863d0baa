"""What the plans move and read: shuffled rows, passes over a table, parts of a scan."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from procsift.operators import evaluate, forest, gating
from procsift.operators.features import add_row_features, heuristic_labels
from procsift.operators.lookup import LookupLimits, lookup
from procsift.operators.prep import prep_events
from procsift.operators.quantiles import exact_quantiles
from procsift.schema import FEATURES
from procsift.session import store
from procsift.sources.bridge import process_events
from verify import SF_DIR


def executed(df):
    """The nodes of the plan that ran, with their metrics."""
    df.collect()
    out = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        out.append(node)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def shuffled_rows(df):
    total = []
    for node in executed(df):
        if node.nodeName() == "Exchange":
            total.append(node.metrics().apply("shuffleRecordsWritten").value())
    return sorted(total)


def test_only_rows_without_a_hot_key_are_shuffled(spark):
    # Key 1 has two thirds of the rows; a tenth has no key.
    rows = [(i, None if i % 10 == 9 else 1 if i % 3 else 100 + i) for i in range(3000)]
    events = store(spark.createDataFrame(rows, "event_id bigint, k bigint"), "t").df
    keys = sorted({k for _, k in rows if k})
    table = store(spark.createDataFrame([(k, -k) for k in keys], "k bigint, v bigint"), "t")
    unserved = sum(k is not None and k != 1 for _, k in rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = lookup(events, table, {"k": "k"}, {"v": "got"}, limits=LookupLimits(broadcast_bytes=0, hot_keys=1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # both sides are small here
    try:
        moved = shuffled_rows(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved == sorted([unserved, len(keys)]), moved
    want = {i: -k if k else None for i, k in rows}
    assert {r["event_id"]: r["got"] for r in found.collect()} == want


def test_scores_are_computed_where_the_matrix_lies(spark):
    draw = random.Random(4)
    rows = [(i, *[draw.choice([0.0, 1.0, draw.random()]) for _ in FEATURES]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "event_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    matrix = store(frame, "m", group_bytes=forest.MATRIX_GROUP_BYTES).df
    model = forest.Forest(*[getattr(forest.fit(frame, trees=8), n) for n in ("nodes", "trees", "sample_size", "features", "offset", "contamination")])
    scored = forest.scored_matrix(matrix, model, [])
    assert not [n for n in executed(scored) if n.nodeName() in ("Exchange", "Sort")]
    want = {r["event_id"]: r["raw_score"] for r in scored.collect()}
    for n in (1, 13):
        got = forest.raw_scores(frame.repartition(n), model).collect()
        assert {r["event_id"]: r["raw_score"] for r in got} == want


def test_a_small_matrix_is_read_in_parts(spark):
    frame = spark.range(120_000).select(F.col("id").alias("event_id"), *[F.rand(i).alias(f) for i, f in enumerate(FEATURES)])
    one = store(frame.coalesce(1), "m", group_bytes=forest.MATRIX_GROUP_BYTES).df
    sizes = [r["n"] for r in one.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) < 40_000


@pytest.fixture
def reads(spark):
    """Counts how often a frame's rows are computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def counted(df):
        return df.mapInArrow(count, df.schema)

    return seen, counted


@pytest.mark.parametrize("kind", ["continuous", "four values", "infinite"])
def test_quantiles_in_two_passes(spark, reads, kind):
    seen, counted = reads
    draw = np.random.default_rng(7)
    values = {
        "continuous": draw.normal(size=20_000),
        "four values": draw.integers(0, 4, 20_000).astype(float),
        "infinite": np.where(draw.random(20_000) < 0.05, -np.inf, np.where(draw.random(20_000) < 0.1, np.inf, draw.normal(size=20_000))),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    probs = [0.02, 0.05, 0.10, 0.20, 0.5, 0.999]
    got = exact_quantiles(counted(df), "s", probs)
    assert seen.value <= 2 * len(values)
    ordered = np.sort(values)
    for p, value in zip(probs, got, strict=True):
        at = (len(values) - 1) * p
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        want = low if low == high else (1 - (at - math.floor(at))) * low + (at - math.floor(at)) * high
        assert value == pytest.approx(want, nan_ok=True)


def test_labels_need_the_features_once(spark, reads):
    seen, counted = reads
    rows = add_row_features(prep_events(process_events(spark, SF_DIR)))
    n = rows.count()
    stored = store(counted(rows.select("event_id", "suspicious_parent", "dump_precursor", "hidden_flags")), "labels").df
    heuristic_labels(stored).collect()
    assert seen.value == n


def test_histograms_take_two_jobs(spark, reads):
    seen, counted = reads
    rows = [(i, float(i % 7), float(i % 60), None if i % 2 else 1.5, float("nan") if i % 3 else -0.0) for i in range(900)]
    names = FEATURES[:4]
    df = spark.createDataFrame(rows, "event_id bigint, " + ", ".join(f"{n} double" for n in names))
    found = evaluate.feature_histograms(counted(df), names).collect()
    assert seen.value == 2 * len(rows)
    bins = {n: max(r["bin"] for r in found if r["feature"] == n) for n in names}
    assert list(bins.values()) == [10, 50, 10, 10]
    assert [sum(r["n"] for r in found if r["feature"] == n) for n in names] == [900, 900, 450, 300]


def test_correlations_of_awkward_columns(spark):
    draw = np.random.default_rng(2)
    n = 500
    x = draw.normal(size=n)
    columns = {
        FEATURES[0]: 1e9 + x,  # large against its spread
        FEATURES[1]: -3 * x + 0.1 * draw.normal(size=n),
        FEATURES[2]: np.where(draw.random(n) < 0.4, np.nan, draw.normal(size=n)),
        FEATURES[3]: np.full(n, 0.1),
        FEATURES[4]: np.where(np.arange(n) == 3, np.inf, x),
        FEATURES[5]: np.where(draw.random(n) < 0.3, np.nan, x),
    }
    rows = [(i, *[None if np.isnan(c[i]) and i % 2 else float(c[i]) for c in columns.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id bigint, " + ", ".join(f"{c} double" for c in columns))
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in evaluate.feature_correlation(df.repartition(5)).collect()}
    assert len(got) == 36
    for (a, b), value in got.items():
        one, other = columns[a], columns[b]
        both = ~np.isnan(one) & ~np.isnan(other)
        if FEATURES[3] in (a, b) or FEATURES[4] in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(np.corrcoef(one[both], other[both])[0, 1], abs=1e-6)
            assert -1.0 <= value <= 1.0


def test_gate_bounds_come_from_two_passes(spark, reads):
    seen, counted = reads
    events = process_events(spark, SF_DIR).withColumnRenamed("value", "anomaly_score").select("event_id", "anomaly_score")
    n = events.count()
    gating.risk_bounds(counted(events))
    assert seen.value == 2 * n
