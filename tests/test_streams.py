"""Ids on a stream, folders that appear at once, and snapshots that change under a stream."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from procsift.operators import gating
from procsift.operators.features import add_row_features, graph_table, pair_table
from procsift.operators.prep import prep_events
from procsift.plans.catalog import end_to_end
from procsift.schema import RAW_FILES
from procsift.sources import publish
from procsift.sources.bridge import RAW_TEXT, process_events
from procsift.sources.unified import combined_events, union_events, to_unified, with_places
from procsift.sources.rawlogs import PARSERS, good_rows
from procsift.streaming import alerts, ids
from procsift.streaming.ingest import start_ingest, write_batch
from verify import SF_DIR


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for source, name in RAW_FILES.items():
        RAW_TEXT[source](process_events(spark, SF_DIR)).repartition(2).write.text(str(folder / name))
    return str(folder)


def ingested(spark, logs, out, **options):
    folders = {s: f"{logs}/{n}" for s, n in RAW_FILES.items()}
    start_ingest(spark, folders, f"{out}/events", f"{out}/state", **options).awaitTermination()
    return spark.read.parquet(f"{out}/events")


def keyed(df):
    return sorted(map(str, df.select("event_id", "source", "timestamp", "pid", "command_line").collect()))


def test_ids_are_the_same_in_any_batch_and_split(spark, logs, tmp_path):
    one = ingested(spark, logs, str(tmp_path / "one"))
    want = keyed(one)
    assert len(want) == one.select("event_id").distinct().count() == combined_events(spark, logs).count()
    assert one.where("event_id < 0 or event_id is null").isEmpty()
    two = ingested(spark, logs, str(tmp_path / "two"), max_files=1)
    assert two.select("batch").distinct().count() > 1 and keyed(two) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert keyed(ingested(spark, logs, str(tmp_path / "three"))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def placed(spark, logs):
    return union_events(
        [
            to_unified(good_rows(PARSERS[s](with_places(spark.read.text(f"{logs}/{n}"), i))), s, "row")
            for i, (s, n) in enumerate(RAW_FILES.items())
        ]
    )


def test_a_batch_that_is_run_again_changes_nothing(spark, logs, tmp_path):
    out, rows = str(tmp_path / "out"), placed(spark, logs)
    write_batch(rows, 0, out)
    first, names = keyed(spark.read.parquet(out)), publish.names_in(spark, f"{out}/batch=0")
    write_batch(rows, 0, out)
    assert publish.names_in(spark, f"{out}/batch=0") == names
    # Stopped after the ledger and before the rows: the same ids again.
    shutil.rmtree(f"{out}/batch=0")
    write_batch(rows, 0, out)
    assert keyed(spark.read.parquet(out)) == first


def test_pages_that_meet_take_another_digest(spark, logs, tmp_path):
    out, rows = str(tmp_path / "out"), placed(spark, logs)
    # Sixty-four digests for pages of sixty-four rows: many meet.
    files = sorted({r["_file"] for r in rows.select("_file").distinct().collect()})
    for i, half in enumerate((files[::2], files[1::2])):
        write_batch(rows.where(F.col("_file").isin(half)), i, out, page_bits=6, digest_bits=6)
    found = spark.read.parquet(out)
    assert found.count() == rows.count() == found.select("event_id").distinct().count()
    ledger = ids.read_ledger(spark, f"{out}/_ledger", 2)
    assert ledger.count() == ledger.select("digest").distinct().count()
    assert not ledger.where("salt > 0").isEmpty() and ledger.agg(F.max("digest")).first()[0] < 64


def test_a_table_appears_once(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert publish.publish_table(spark.range(3), folder, "batch=1")
    assert not publish.publish_table(spark.range(9), folder, "batch=1")
    assert spark.read.parquet(f"{folder}/batch=1").count() == 3
    assert publish.names_in(spark, str(tmp_path / "none")) == []
    assert publish.publish_json(spark, folder, "1.json", {"a": "ü"})
    assert not publish.publish_json(spark, folder, "1.json", {"a": "b"})
    assert publish.read_json(spark, f"{folder}/1.json") == {"a": "ü"}


def snapshot_of(events, threshold):
    prepped = prep_events(events)
    scored = add_row_features(prepped).withColumnRenamed("value", "anomaly_score")
    return alerts.Snapshot(graph_table(prepped), pair_table(prepped), gating.risk_bounds(scored), threshold)


def test_a_snapshot_that_is_replaced_between_two_batches(spark, tmp_path):
    events, path = process_events(spark, SF_DIR), str(tmp_path / "snapshot")
    scored = lambda rows: rows.withColumnRenamed("value", "anomaly_score")
    assert alerts.save_snapshot(snapshot_of(events, -1e9), path) == 1  # flags nothing
    stream_in = str(tmp_path / "in")
    events.repartition(2).write.parquet(stream_in)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(stream_in)
    look, seen = alerts.latest_snapshot(spark, path), []

    def current():
        seen.append(look())
        if len(seen) == 1:  # while the first batch runs
            alerts.save_snapshot(snapshot_of(events, 1e9), path)  # flags every strong indicator
        return seen[-1]

    alerts.start_alerts(stream, current, str(tmp_path / "out"), str(tmp_path / "state"), scorer=scored).awaitTermination()
    assert [s.version for s in seen] == [1, 2]
    assert spark.read.parquet(str(tmp_path / "out/batch=0")).count() == 0
    assert spark.read.parquet(str(tmp_path / "out/batch=1")).count() > 0
    # An unchanged version isn't loaded again; old ones can go.
    assert look() is look() and look().version == 2
    alerts.drop_versions(spark, path, keep=1)
    assert alerts.load_snapshot(spark, path).threshold == 1e9
    with pytest.raises(Exception):  # noqa: B017, PT011
        alerts.load_snapshot(spark, path, version=1)
    assert alerts.save_snapshot(snapshot_of(events, 0.0), path) == 3


def test_no_snapshot(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        alerts.load_snapshot(spark, str(tmp_path))


def test_end_to_end_for_two_sizes_of_batches(spark):
    one, many = (
        sorted(map(str, end_to_end(spark, SF_DIR, n).drop("batch", "event_id").collect())) for n in (None, 2)
    )
    assert one and one == many
