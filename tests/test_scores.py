"""Quantiles, bands, gate, explanations, evaluation and triage."""

from __future__ import annotations

import random

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from procsift.functions import reasons as texts
from procsift.operators import evaluate, gating, triage
from procsift.operators.quantiles import exact_quantiles
from procsift.schema import RISK_QUANTILES

PROBS = [0.0, 0.02, 0.05, 0.25, 0.5, 0.95, 1.0]


def scores(spark, values, **columns):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "event_id bigint, anomaly_score double")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


# --- quantiles ----------------------------------------------------------------


def spread_values(kind, n=6000):
    rng = random.Random(kind)
    if kind == "even":
        return [rng.random() for _ in range(n)]
    if kind == "heavy":  # a third of the rows share one value, at a wanted rank
        return [0.5 if rng.random() < 0.4 else rng.gauss(0, 1) for _ in range(n)]
    if kind == "long tail":
        return [rng.paretovariate(0.3) for _ in range(n)]
    if kind == "edges":  # ties at both ends
        return [0.0] * (n // 3) + [rng.random() for _ in range(n // 3)] + [1.0] * (n // 3)
    return [float(rng.randrange(5)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["even", "heavy", "long tail", "edges", "few"])
@pytest.mark.parametrize("max_values", [200_000, 40])
def test_exact_quantiles(spark, kind, max_values):
    values = spread_values(kind)
    df = scores(spark, [*values, None, float("nan")])
    got = exact_quantiles(df, "anomaly_score", PROBS, max_values=max_values)
    assert got == pytest.approx([float(np.quantile(values, p)) for p in PROBS], rel=1e-12)
    # Values that hold a rank must come out exactly: bands compare with <=.
    for p, g in zip(PROBS, got):
        position = (len(values) - 1) * p
        if position == int(position):
            assert g == sorted(values)[int(position)]


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(scores(spark, [None]), "anomaly_score", [0.5, 0.1]) == [None, None]
    assert exact_quantiles(scores(spark, [3]), "anomaly_score", [0.05]) == [3.0]


# --- bands and gate -----------------------------------------------------------


def test_published_counts(spark):
    """366 distinct scores: 74 outside Normal, 19 under the gate."""
    df = scores(spark, range(366), suspicious_parent=1)
    gated, threshold, bounds = gating.gate(df)
    assert gated.where("risk_level <> 'Normal'").count() == 74
    assert gated.where("flagged").count() == 19
    assert threshold == bounds["High"] == pytest.approx(18.25)


def test_risk_levels(spark):
    banded = gating.add_risk_level(scores(spark, range(100)))
    counts = {r.risk_level: r["count"] for r in banded.groupBy("risk_level").count().collect()}
    assert counts == {"Critical": 2, "High": 3, "Medium": 5, "Low": 10, "Normal": 80}
    odd = gating.add_risk_level(scores(spark, [None, 0.0, float("nan")])).orderBy("event_id").collect()
    assert [r.risk_level for r in odd] == ["Normal", "Critical", "Normal"]
    own = gating.add_risk_level(scores(spark, range(0, 33, 3)), quantiles={"Medium": 0.7, "Low": 0.4, "Spare": 0.1})
    assert [r.risk_level for r in own.orderBy("event_id").collect()] == ["Medium"] * 8 + ["Normal"] * 3
    default = gating.add_risk_level(scores(spark, range(100)), quantiles={})
    assert default.where("risk_level = 'Low'").count() == 10
    ties = gating.add_risk_level(scores(spark, [0.1] * 50))
    assert {r.risk_level for r in ties.collect()} == {"Critical"}


@pytest.mark.parametrize(
    "row, strong",
    [((1, 0, 0), True), ((0, 1, 0), True), ((0, 0, 2), True), ((0, 0, 1), False), ((0, 0, 0), False),
     ((None, None, None), False)],
)
def test_strong_indicator(spark, row, strong):
    df = spark.createDataFrame([row], "suspicious_parent int, dump_precursor int, hidden_flags int")
    assert df.select(gating.strong_indicator(df)).first()[0] is strong


def test_strong_indicator_without_columns(spark):
    df = scores(spark, [0])
    assert df.select(gating.strong_indicator(df)).first()[0] is False


@pytest.mark.parametrize("max_values", [50, 10**6])
def test_quantiles_are_the_same_either_way(spark, max_values):
    """Bit for bit what the sorted values give, infinities included."""
    rng = np.random.default_rng(4)
    values = [*rng.normal(0, 1, 3000).tolist(), *[0.25] * 500]
    probs = [0.0, 0.02, 0.05, 0.33, 0.5, 0.98, 1.0]
    for extra in ([], [-math.inf] * 90, [math.inf] * 90 + [-math.inf]):
        every = sorted(values + extra)
        want = []
        for p in probs:
            at = (len(every) - 1) * p
            k = math.floor(at)
            a, b, share = every[k], every[min(k + 1, len(every) - 1)], at - k
            want.append(a if a == b or share == 0 else (1 - share) * a + share * b)
        df = spark.createDataFrame([(v,) for v in values + extra + [None, math.nan]], "anomaly_score double")
        assert exact_quantiles(df, "anomaly_score", probs, max_values=max_values) == want


def test_gate_needs_score_and_indicator(spark, graded_rows):
    flagged, threshold = gating.add_flagged(graded_rows, 0.0)
    assert threshold == 0.0
    assert [r.event_id for r in flagged.where("flagged").orderBy("event_id").collect()] == [0, 3, 6, 9, 12]
    assert gating.add_flagged(graded_rows, -100.0)[0].where("flagged").count() == 0
    _, default = gating.add_flagged(scores(spark, range(100), suspicious_parent=1))
    assert default == pytest.approx(float(np.quantile(range(100), 0.05)))
    missing = gating.add_flagged(scores(spark, [None, 1, 2], suspicious_parent=1), 1.5)[0]
    assert [r.flagged for r in missing.orderBy("event_id").collect()] == [False, True, False]


def test_merge_keeps_scored_columns(spark):
    rows = [(i, f"scored {i}", -i / 8) for i in (17, 23, 40)]
    scored = spark.createDataFrame(rows, "event_id bigint, timestamp string, anomaly_score double")
    rows = [(i, f"feature {i}", i % 2, i / 4) for i in (23, 40, 99)]
    features = spark.createDataFrame(rows, "event_id bigint, timestamp string, long_cmd int, cmd_entropy double")
    merged = {r.event_id: r for r in gating.merge_scored(scored, features).collect()}
    assert {i: r.timestamp for i, r in merged.items()} == {i: f"scored {i}" for i in (17, 23, 40)}
    assert {i: (r.long_cmd, r.cmd_entropy) for i, r in merged.items()} == {17: (None, None), 23: (1, 5.75), 40: (0, 10.0)}


# --- explanations -------------------------------------------------------------

BASE = dict(process_image="x.exe", command_line="", target_image=None, dump_precursor=0, hidden_flags=0,
            unusual_chain=0.5, cmd_entropy=0.0, long_cmd=0, suspicious_parent=0)


def explain(spark, score=-0.5, **changes):
    row = {**BASE, **changes, "anomaly_score": score, "flagged": True}
    shape = ("process_image string, command_line string, target_image string, dump_precursor int, "
             "hidden_flags int, unusual_chain double, cmd_entropy double, long_cmd int, "
             "suspicious_parent int, anomaly_score double, flagged boolean")
    return gating.add_explanations(spark.createDataFrame([tuple(row.values())], shape)).first().explanation


@pytest.mark.parametrize(
    "changes, wanted",
    [
        ({}, [texts.NO_REASON]),
        ({"process_image": "LSASS.exe"}, [texts.LSASS]),
        ({"target_image": "c:/lsass.exe"}, [texts.LSASS]),
        ({"command_line": "delete SHADOW"}, [texts.VSSADMIN]),
        ({"command_line": "ntds.dit"}, [texts.NTDS]),
        ({"process_image": "ntdsutil.exe"}, [texts.NTDS]),
        ({"process_image": "procdump.exe"}, [texts.PROCDUMP]),
        ({"command_line": "mimikatz"}, [texts.MIMIKATZ]),
        ({"dump_precursor": 1}, [texts.DUMP]),
        ({"dump_precursor": 1, "command_line": "procdump"}, [texts.PROCDUMP]),
        ({"command_line": "-enc A"}, [texts.ENCODED]),
        ({"hidden_flags": 2}, [texts.HIDDEN]),
        ({"hidden_flags": 3, "long_cmd": 1, "command_line": "-EncodedCommand"}, [texts.ENCODED]),
        ({"unusual_chain": 0.8}, [texts.CHAIN]),
        ({"unusual_chain": 0.7}, [texts.NO_REASON]),
        ({"cmd_entropy": 2.6}, [texts.ENTROPY]),
        ({"long_cmd": 1, "hidden_flags": 2}, [texts.HIDDEN, texts.LONG]),
        ({"suspicious_parent": 1}, [texts.PARENT]),
        ({"suspicious_parent": 1, "unusual_chain": 1.0}, [texts.CHAIN]),
        ({"command_line": "lsass shadow ntds procdump -enc "}, [texts.LSASS, texts.VSSADMIN, texts.NTDS]),
        # The rule past the cut still silences the flag rule.
        ({"command_line": "lsass shadow ntds -enc ", "hidden_flags": 2, "long_cmd": 1},
         [texts.LSASS, texts.VSSADMIN, texts.NTDS]),
        ({"process_image": None, "command_line": None}, [texts.NO_REASON]),
    ],
)
def test_reasons(spark, changes, wanted):
    assert explain(spark, **changes) == "Flagged: " + " + ".join(wanted) + " (score: -0.500)"


def test_explanation_edges(spark):
    assert explain(spark, score=float("nan")).endswith("(score: N/A)")
    assert explain(spark, score=None).endswith("(score: N/A)")
    plain = scores(spark, [0.5]).withColumn("flagged", F.lit(False))
    assert gating.add_explanations(plain).first().explanation == "—"
    assert gating.add_explanations(scores(spark, [0.5])).first().explanation == "—"


# --- evaluation ---------------------------------------------------------------


def test_metrics_and_confusion(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "is_attack int, hit int")
    m = evaluate.precision_recall(df, F.col("hit") == 1).first()
    assert (m.tp, m.fp, m.fn) == (3, 1, 2)
    assert (m.precision, m.recall, m.f1) == pytest.approx((0.75, 0.6, 2 / 3))
    c = {r.is_attack: (r.predicted_0, r.predicted_1) for r in evaluate.confusion_matrix(df, F.col("hit") == 1).collect()}
    assert c == {0: (4, 1), 1: (2, 3)}
    none = evaluate.precision_recall(df.where("hit = 5"), F.col("hit") == 1).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_labels_join(spark):
    labels = spark.createDataFrame([(0, 1)], "event_id bigint, is_attack int")
    rows = evaluate.with_labels(scores(spark, [1, 2]), labels).orderBy("event_id").collect()
    assert [r.is_attack for r in rows] == [1, 0]
    assert evaluate.any_overlap(scores(spark, [1]), labels)
    assert not evaluate.any_overlap(scores(spark, [1]).withColumn("event_id", F.lit(9)), labels)


def test_patterns_count_command_and_process(spark):
    rows = [("lsass", "lsass.exe", True), ("x", "VSSADMIN.exe", True), ("ntdsutil", "y", False)]
    df = spark.createDataFrame(rows, "command_line string, process_image string, flagged boolean")
    got = {r.pattern: (r.hits, r.n_flagged, r.warn) for r in evaluate.pattern_counts(df).collect()}
    assert got == {"vssadmin": (1, 2, False), "lsass": (2, 2, False), "ntdsutil": (0, 2, True)}
    none = evaluate.pattern_counts(df.where("flagged = false")).collect()
    assert [(r.hits, r.warn) for r in none] == [(0, False)] * 3


def test_histograms(spark):
    df = scores(spark, [0, 0, 1, 5, 10, None])
    bins = evaluate.score_histogram(df, max_bins=5).orderBy("bin").collect()
    assert [r.n for r in bins] == [3, 0, 1, 0, 1]
    wide = evaluate.score_histogram(df).count()
    assert wide == 6  # no more bins than rows
    cut = evaluate.score_bins(scores(spark, range(21))).orderBy("bin").collect()
    assert [r.n for r in cut] == [2] + [1] * 19 and cut[0].lo == pytest.approx(-0.02)
    same = evaluate.score_bins(scores(spark, [4, 4])).collect()
    assert sum(r.n for r in same) == 2 and len(same) == 20
    assert evaluate.score_bins(scores(spark, [None])).count() == 0


def test_feature_histograms_and_correlation(spark):
    rows = [(float(i), i % 3, None if i % 4 == 0 else float(i * i), 7) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d int")
    hist = evaluate.feature_histograms(df, ["a", "b", "c", "d"]).collect()
    per = {n: [r.n for r in sorted((x for x in hist if x.feature == n), key=lambda x: x.bin)] for n in "abcd"}
    assert per["a"] == np.histogram(range(100), 50)[0].tolist()
    assert per["b"] == np.histogram([i % 3 for i in range(100)], 10)[0].tolist()
    assert sum(per["c"]) == 75 and len(per["c"]) == 50
    assert len(per["d"]) == 10 and sum(per["d"]) == 100
    got = {(r.feature_a, r.feature_b): r.correlation for r in evaluate.feature_correlation(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16 and got["a", "d"] is None and got["d", "d"] is None
    kept = [r for r in rows if r[2] is not None]
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["a", "c"] == got["c", "a"] == pytest.approx(np.corrcoef([r[0] for r in kept], [r[2] for r in kept])[0, 1])
    assert got["a", "b"] == pytest.approx(np.corrcoef([r[0] for r in rows], [r[1] for r in rows])[0, 1])
    assert evaluate.feature_correlation(df, ["a"]).count() == 0


def test_describe_and_quantile_table(spark):
    row = evaluate.describe_score(scores(spark, [1, 2, 3, 4, None, float("nan")])).first()
    assert (row["count"], row.mean, row.min, row.q25, row.q50, row.q75, row.max) == (4, 2.5, 1, 1.75, 2.5, 3.25, 4)
    assert row.std == pytest.approx(np.std([1, 2, 3, 4], ddof=1))
    table = evaluate.score_quantiles(scores(spark, range(100)), [0.05, 0.1]).collect()
    assert [(r.p, r.score) for r in table] == [(0.05, pytest.approx(4.95)), (0.1, pytest.approx(9.9))]


# --- triage -------------------------------------------------------------------


def alerts(spark):
    rows = [(0, -0.3, "High", True, "powershell -enc A", "2024-01-03"), (1, None, "Critical", True, None, "2024-01-01"),
            (2, -0.1, "Normal", True, "x" * 100, None), (3, -0.2, "Low", None, "y", "2024-01-02"),
            (4, -0.4, "Critical", True, "PowerShell", "2024-01-02")]
    return spark.createDataFrame(
        rows, "event_id bigint, anomaly_score double, risk_level string, flagged boolean, command_line string, timestamp string")


def ids(df):
    return [r.event_id for r in df.collect()]


def test_alert_set(spark):
    df = alerts(spark)
    assert sorted(ids(triage.alert_set(df))) == [0, 1, 2, 4]
    assert sorted(ids(triage.alert_set(df.drop("flagged")))) == [0, 1, 3, 4]
    assert ids(triage.alert_set(df.select("event_id"))) == []


def test_triage_filters_and_sorts(spark):
    df = alerts(spark)
    assert ids(triage.triage_rows(df)) == [4, 0, 1]
    assert ids(triage.triage_rows(df, ascending=False)) == [0, 4, 1]
    assert ids(triage.triage_rows(df, sort_by="risk_level")) == [1, 4, 0]
    assert ids(triage.triage_rows(df, sort_by="timestamp", ascending=False)) == [0, 4, 1]
    assert ids(triage.triage_rows(df, keyword="POWER.hell", levels=["High"])) == [0]
    assert ids(triage.triage_rows(df, levels=[])) == []
    with pytest.raises(ValueError, match="regular expression"):
        triage.triage_rows(df, keyword="(")
    with pytest.raises(ValueError):
        triage.sort_alerts(df, "pid")
    view = triage.triage_view(triage.triage_rows(df, levels=["Normal"]))
    assert len(view.first().command_line) == 80


def test_kpis_and_rankings(spark):
    df = alerts(spark).withColumn("process_image", F.when(F.col("event_id") < 2, F.lit("b")).otherwise(F.lit("a")))
    kpi = triage.kpi_summary(df).first()
    assert (kpi.total, kpi.flagged, kpi.pct_flagged) == (5, 4, 80.0)
    assert triage.kpi_summary(df.where("false")).first().pct_flagged == 0.0
    assert [tuple(r) for r in triage.top_values(df, "process_image").collect()] == [("a", 2), ("b", 2)]
    assert triage.top_values(df, "parent_image").count() == 0
    assert [tuple(r) for r in triage.risk_distribution(df).collect()] == [
        ("Critical", 2), ("High", 1), ("Low", 1), ("Normal", 1)]
    assert RISK_QUANTILES["Low"] == 0.2
