"""The jobs end to end, the streams, and the session helpers."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from procsift.operators import gating
from procsift.operators.features import graph_table, pair_table
from procsift.operators.prep import prep_events
from procsift.plans import jobs
from procsift.schema import CORE_COLUMNS, FEATURES, RAW_FILES, TARGET_COLUMNS
from procsift.session import dealt_out, scratch_root, store
from procsift.sources.bridge import RAW_TEXT, process_events
from procsift.sources.unified import combined_events
from procsift.streaming.alerts import Snapshot, gate_events, start_alerts
from procsift.streaming.ingest import start_ingest
from verify import SF_DIR


@pytest.fixture(scope="module")
def raw_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for source, name in RAW_FILES.items():
        RAW_TEXT[source](process_events(spark, SF_DIR)).repartition(3).write.text(str(folder / name))
    return str(folder)


@pytest.fixture(scope="module")
def pipeline(spark, raw_folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    reports = {"ingest": jobs.ingest_job(spark, raw_folder, out)}
    events = spark.read.parquet(f"{out}/events.parquet")
    reports["features"] = jobs.feature_job(events, out, top_n=7)
    reports["score"] = jobs.score_job(spark, out, trees=40, max_samples=64, top_n=5)
    reports["gate"] = jobs.gate_job(spark, out, top_n=5)
    return out, reports


def test_ingest_reports(pipeline):
    _, reports = pipeline
    report = reports["ingest"]
    assert sum(r.n for r in report["event_types"].collect()) == 1000
    assert {r.column_name: r.nulls for r in report["nulls"].collect()}["target_pid"] == 1000
    assert report["suspicious_count"].first().n > 5
    assert report["suspicious_rows"].count() == 5


def test_raw_report(spark, raw_folder):
    report = jobs.raw_report(spark, raw_folder)
    assert {r.source for r in report["malformed"].collect()} == set(RAW_FILES)
    assert sum(r.malformed for r in report["malformed"].collect()) == 11
    assert report["event_types_sysmon"].count() == 3


def test_feature_job_outputs(spark, pipeline):
    out, reports = pipeline
    features = spark.read.parquet(f"{out}/X_features.parquet")
    assert features.columns == ["event_id", "timestamp", *FEATURES]
    prepped = spark.read.parquet(f"{out}/events_prepped.parquet")
    assert features.count() == prepped.count() == spark.read.parquet(f"{out}/y_labels.parquet").count() == 925
    top = spark.read.csv(f"{out}/top_suspicious.csv", header=True)
    assert top.count() == 7 and {"command_line", *FEATURES} <= set(top.columns)
    report = reports["features"]
    assert report["correlation"].count() == 144
    assert sum(r.importance for r in report["importance"].collect()) == pytest.approx(1.0)
    assert jobs.eda_report(features.select("event_id", "long_cmd")) == {}


def test_score_job_outputs(spark, pipeline):
    out, reports = pipeline
    scored = spark.read.parquet(f"{out}/scored_events.parquet")
    assert scored.count() == 925 and scored.where("process_image is null").count() == 0
    assert scored.agg(F.sum("is_anomaly")).first()[0] == pytest.approx(47, abs=2)
    assert spark.read.csv(f"{out}/top_anomalies.csv", header=True).count() == 5
    assert reports["score"]["metrics"].count() == 1
    assert sum(r.n for r in reports["score"]["histogram"].collect()) == 925


def test_gate_job_outputs(spark, pipeline):
    out, reports = pipeline
    gated = spark.read.parquet(f"{out}/scored_events_gated.parquet")
    flagged = gated.where("flagged")
    assert gated.count() == 925 and 0 < flagged.count() <= 47
    assert flagged.where("explanation like 'Flagged: % | Top features: %'").count() == flagged.count()
    assert gated.where("not flagged and explanation <> '—'").count() == 0
    config = json.loads(spark.read.text(f"{out}/threshold_config.json").first().value)
    assert config["shap_enabled"] is True and abs(config["score_threshold"]) < 1e-9
    assert reports["gate"]["confusion"].count() == 2
    assert spark.read.csv(f"{out}/top_flagged_gated.csv", header=True).count() == 5


def test_gate_without_model_or_labels(spark, pipeline, tmp_path):
    out, _ = pipeline
    report = jobs.gate_job(
        spark, str(tmp_path), scored_path=f"{out}/scored_events.parquet",
        features_path=f"{out}/X_features.parquet", score_threshold=-100.0,
    )
    assert "metrics" not in report and report["top_flagged"].count() == 0
    assert report["config"].first().shap_enabled is False
    assert report["config"].first().score_threshold == -100.0


def test_triage_job(spark, pipeline, tmp_path):
    out, _ = pipeline
    done = jobs.triage_job(
        spark, f"{out}/scored_events_gated.parquet", keyword="vssadmin", export=str(tmp_path / "export")
    )
    # Gated events carry no pid columns, so as an upload they are rejected.
    assert "missing columns" in done.intake.problem
    events = spark.read.parquet(f"{out}/events_prepped.parquet").select("event_id", "pid", "ppid")
    full = spark.read.parquet(f"{out}/scored_events_gated.parquet").join(events, "event_id")
    full.write.parquet(str(tmp_path / "full.parquet"))
    done = jobs.triage_job(spark, str(tmp_path / "full.parquet"), export=str(tmp_path / "export"))
    exported = spark.read.csv(str(tmp_path / "export"), header=True, escape='"')
    assert exported.count() == done.rows.count() == full.where("flagged").count()
    assert done.report["kpi"].first().total == 925
    assert sum(r.n for r in done.report["score_bins"].collect()) == 925


# --- streams ------------------------------------------------------------------


def as_rows(df):
    return sorted(map(str, df.select(*CORE_COLUMNS, *TARGET_COLUMNS).collect()))


def test_stream_ingest_equals_batch_and_resumes(spark, raw_folder, tmp_path):
    folders = {s: f"{raw_folder}/{n}" for s, n in RAW_FILES.items()}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    running = start_ingest(spark, folders, out, state, max_files=1)
    running.awaitTermination()
    assert len(running.recentProgress) >= 3
    batch = combined_events(spark, raw_folder)
    assert as_rows(spark.read.parquet(out)) == as_rows(batch)
    start_ingest(spark, folders, out, state, max_files=1).awaitTermination()
    assert spark.read.parquet(out).count() == batch.count() == 1000


@pytest.fixture(scope="module")
def snapshot(spark):
    prepped = prep_events(process_events(spark, SF_DIR).where("event_id < 600"))
    scored = prepped.withColumnRenamed("value", "anomaly_score")
    bounds = gating.risk_bounds(scored)
    return Snapshot(graph_table(prepped), pair_table(prepped), bounds, bounds["High"])


def surrogate(rows):
    return rows.withColumnRenamed("value", "anomaly_score")


def test_stream_alerts_over_batches(spark, snapshot, tmp_path):
    events = process_events(spark, SF_DIR)
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_alerts(stream, snapshot, str(tmp_path / "out"), str(tmp_path / "state"), scorer=surrogate).awaitTermination()
    alerts = spark.read.parquet(str(tmp_path / "out"))
    want = gate_events(events, snapshot, scorer=surrogate).where("flagged")
    assert alerts.select("batch").distinct().count() == 4
    assert sorted(r.event_id for r in alerts.collect()) == sorted(r.event_id for r in want.collect())


def test_unseen_pids_and_pairs_in_a_stream(spark, snapshot):
    known = snapshot.graph.df.where("parent is not null and depth between 1 and 18").orderBy("id").first()
    rows = [(0, 5_000_000, known.id), (1, 5_000_001, 6_000_000), (2, 5_000_002, 5_000_002), (3, known.id, 1)]
    now = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(i, now, "1", "C:/new/a.exe", "C:/new/b.exe", None, p, q, 1.0) for i, p, q in rows],
        "event_id bigint, timestamp timestamp_ntz, event_type string, process_image string, "
        "parent_image string, command_line string, pid bigint, ppid bigint, value double",
    )
    got = gate_events(events, snapshot, scorer=surrogate).orderBy("event_id").collect()
    assert [r.pid_depth for r in got] == [known.depth + 1, 1, 0, known.depth]
    assert {r.rare_parent_child for r in got} == {1.0}
    with pytest.raises(ValueError, match="scorer"):
        gate_events(events, snapshot)


# --- session helpers ----------------------------------------------------------


def test_store_measures_and_cuts_lineage(spark):
    kept = store(spark.createDataFrame([("abc", 1, [1, 2]), (None, 2, None)], "s string, n int, a array<int>"), "t")
    assert kept.rows == 2 and kept.bytes >= 3 + 2 * 8
    assert kept.df.count() == 2 and kept.path.startswith(scratch_root(spark))
    assert store(spark.range(0), "empty").bytes == 0


def test_only_local_sessions_may_lack_a_checkpoint_folder(spark):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("__", "."): v for k, v in values.items()})

    assert scratch_root(Session(spark__checkpoint__dir="s3://b/x/", spark__master="yarn")) == "s3://b/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Session(spark__master="yarn"))


def test_layout_follows_from_the_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "event_id")
    one, many = (dealt_out(rows.repartition(n), 1000, 300, "event_id") for n in (1, 13))
    assert one.rdd.getNumPartitions() == 4
    assert one.rdd.glom().collect() == many.rdd.glom().collect()


def test_jobs_leave_no_scratch_tables(spark, raw_folder, tmp_path):
    import os

    from procsift.plans import jobs

    root = scratch_root(spark).removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    output = str(tmp_path / "out")
    jobs.ingest_job(spark, raw_folder, output)
    events = spark.read.parquet(f"{output}/events.parquet")
    jobs.feature_job(events, output, importances=False)
    jobs.score_job(spark, output, trees=5)
    report = jobs.gate_job(spark, output)
    assert set(os.listdir(root)) == before
    assert report["config"].count() == 1 and report["top_flagged"].count() >= 0
    kinds = sorted(name.split("-")[0] for name in os.listdir(f"{output}/snapshot"))
    assert kinds == ["forest", "limits", "staged", "tables", "versions"]
