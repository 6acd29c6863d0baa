"""Raw-log parsing, normalising, folders of files, intake and exports."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from procsift.schema import CORE_COLUMNS, RAW_FILES, TARGET_COLUMNS
from procsift.sources import artifacts, intake, rawlogs
from procsift.sources.bridge import NAMESPACE
from procsift.sources.intake import has_broken_lines, read_intake
from procsift.sources.unified import combined_events, to_unified


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def event(event_id, items, created="2022-07-27T08:31:21.1234567Z", namespace=NAMESPACE):
    data = "".join(f'<Data Name="{n}">{v}</Data>' for n, v in items)
    return (
        f'<Event xmlns="{namespace}"><System><EventID>{event_id}</EventID>'
        f'<TimeCreated SystemTime="{created}"/></System><EventData>{data}</EventData></Event>'
    )


GOOD_JSON = (
    '{"event_simpleName":"ProcessRollup2","ProcessStartTime":"1658910730.111",'
    '"ImageFileName":"cmd.exe","RawProcessId":"100","ParentProcessId":50}'
)


def test_ndjson_lines(spark):
    texts = [GOOD_JSON, "", "   ", "{broken", "[1]", "3", "null", '{"a":1} x', '{"a":1} {"b":2}',
             '{"a":1},{"b":2}', "{'a':1}", "{}", '  {"CommandLine":"a"} ', '{"CommandLine":"x","CommandLine":"y"}']
    rows = rawlogs.ndjson_lines(lines(spark, texts)).collect()
    assert [r.malformed for r in rows] == [False] + [True] * 10 + [False] * 3
    assert rows[0].RawProcessId == "100" and rows[0].ParentProcessId == "50"
    assert rows[12].CommandLine == "a" and rows[13].CommandLine == "y"
    counts = rawlogs.malformed_counts({"falcon": rawlogs.ndjson_lines(lines(spark, texts))}).first()
    assert (counts.lines, counts.malformed) == (14, 10)
    assert rawlogs.quarantine(rawlogs.ndjson_lines(lines(spark, texts))).count() == 10


def test_ndjson_normalised(spark):
    raw = rawlogs.good_rows(rawlogs.ndjson_lines(lines(spark, [GOOD_JSON])))
    row = to_unified(raw, "falcon").first()
    assert row.timestamp == datetime(2022, 7, 27, 8, 32, 10, 111000)
    assert (row.pid, row.ppid, row.source, row.target_image) == (100, 50, "falcon", None)


def test_timestamp_fallback_is_per_column_or_per_row(spark):
    texts = ['{"ProcessStartTime":"1.5","timestamp":"9000"}', '{"timestamp":"3000"}']
    raw = rawlogs.good_rows(rawlogs.ndjson_lines(lines(spark, texts)))
    by_column = [r.timestamp for r in to_unified(raw, "falcon").collect()]
    assert by_column == [datetime(1970, 1, 1, 0, 0, 1, 500000), None]
    by_row = [r.timestamp for r in to_unified(raw, "falcon", "row").collect()]
    assert by_row[1] == datetime(1970, 1, 1, 0, 0, 3)
    without = raw.where("ProcessStartTime is null")
    assert to_unified(without, "falcon").first().timestamp == datetime(1970, 1, 1, 0, 0, 3)


def test_security_lines(spark):
    good = event(4688, [("NewProcessId", "0x3e8"), ("ProcessId", "0x1f4"), ("NewProcessName", r"C:\cmd.exe"),
                        ("CommandLine", "a &amp; b"), ("ParentProcessName", "")])
    texts = [good, "", "<bad", "<Event></Evt>", good + " junk", good + good, "  " + good + "  "]
    parsed = rawlogs.security_lines(lines(spark, texts))
    assert [r.malformed for r in parsed.select("malformed").collect()] == [
        False, True, True, True, True, True, False,
    ]
    row = to_unified(rawlogs.good_rows(parsed), "security_4688").first()
    assert (row.pid, row.ppid, row.event_type, row.command_line) == (1000, 500, "4688", "a & b")
    assert row.parent_image is None
    assert row.timestamp == datetime(2022, 7, 27, 8, 31, 21, 123456)


def test_sysmon_lines(spark):
    create = event(1, [("UtcTime", "2024-01-01 12:00:00.000"), ("Image", "a.exe"), ("Image", "b.exe"),
                       ("ProcessId", "7"), ("ParentProcessId", "4"), ("ParentImage", "p.exe")])
    access = event(10, [("UtcTime", "2024-01-01 12:00:01.000"), ("SourceImage", "s.exe"),
                        ("SourceProcessId", "100"), ("TargetImage", r"C:\lsass.exe"), ("TargetProcessId", "500")])
    bare = "<Event><System><EventID>x</EventID></System></Event>"
    raw = rawlogs.good_rows(rawlogs.sysmon_lines(lines(spark, [create, access, bare])))
    rows = to_unified(raw, "sysmon").collect()
    assert (rows[0].process_image, rows[0].pid, rows[0].ppid) == ("b.exe", 7, 4)
    assert (rows[1].event_type, rows[1].process_image, rows[1].pid) == ("10", "s.exe", 100)
    assert (rows[1].target_image, rows[1].target_pid) == (r"C:\lsass.exe", 500)
    assert rows[2].event_type is None and rows[2].timestamp is None


def test_sysmon_uses_creation_time_only_without_any_utc_time(spark):
    raw = rawlogs.good_rows(rawlogs.sysmon_lines(lines(spark, [event(1, [("UtcTime", "junk")])])))
    assert to_unified(raw, "sysmon").first().timestamp == datetime(2022, 7, 27, 8, 31, 21, 123456)


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="Unknown source"):
        to_unified(spark.range(1), "other")


def test_missing_raw_columns_become_null(spark):
    row = to_unified(spark.createDataFrame([("1",)], "RawProcessId string"), "falcon").first()
    assert row.pid == 1 and row.timestamp is None and row.command_line is None


def test_readers_filter(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    other = GOOD_JSON.replace("ProcessRollup2", "Other")
    escaped = GOOD_JSON.replace("ProcessRollup2", "ProcessRollup\\u0032")
    (folder / "a.txt").write_text("\n".join([GOOD_JSON, other, escaped, "bad"]) + "\n")
    assert rawlogs.read_ndjson(spark, str(folder)).count() == 3
    assert rawlogs.read_ndjson(spark, str(folder), creation_only=True).count() == 2
    (folder / "s.xml").write_text("\n".join(event(i, []) for i in (1, 8, 10, 10)))
    assert rawlogs.read_sysmon(spark, str(folder / "s.xml")).count() == 4
    assert rawlogs.read_sysmon(spark, str(folder / "s.xml"), event_ids=[8, 10]).count() == 3
    assert rawlogs.read_security(spark, str(folder / "s.xml")).count() == 4


def test_combined_events_skip_missing_files(spark, tmp_path):
    assert combined_events(spark, str(tmp_path)).count() == 0
    (tmp_path / RAW_FILES["falcon"]).write_text(GOOD_JSON + "\n" + GOOD_JSON + "\n")
    (tmp_path / RAW_FILES["sysmon"]).write_text(event(1, [("Image", "a.exe")]) + "\n")
    events = combined_events(spark, str(tmp_path))
    assert events.columns == ["event_id", *CORE_COLUMNS, *TARGET_COLUMNS]
    rows = events.orderBy("event_id").collect()
    assert [r.source for r in rows] == ["falcon", "falcon", "sysmon"]
    assert len({r.event_id for r in rows}) == 3


@pytest.mark.parametrize("split", ["700", "134217728"])
def test_ids_follow_files_and_lines_for_any_split(spark, tmp_path, split):
    """The second file is larger, so Spark reads it first; bad lines leave no gaps."""
    folder = tmp_path / RAW_FILES["falcon"]
    folder.mkdir()
    record = GOOD_JSON.replace("}", ', "CommandLine": "%d"}')
    lines = [record % i if i % 7 else "{broken" for i in range(120)]
    (folder / "part-1").write_text("\n".join(lines[:5]) + "\n")
    (folder / "part-2").write_text("\n".join(lines[5:]) + "\n")
    (tmp_path / RAW_FILES["sysmon"]).write_text(event(1, [("Image", "a.exe"), ("CommandLine", "last")]) + "\n")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], split)
        spark.conf.set(keys[1], "1")
        rows = combined_events(spark, str(tmp_path)).orderBy("event_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [str(i) for i in range(120) if i % 7] + ["last"]
    assert [(r.event_id, r.command_line) for r in rows] == list(enumerate(want))


def test_csv_is_read_in_splits_where_no_value_is_broken(spark, tmp_path):
    head = "timestamp,image,parent_image,command_line,pid,ppid,event_type\n"
    plain = head + '2024-01-01 12:00:00,a.exe,b.exe,"say ""hi"", x",1,2,1\n'
    broken = head + '2024-01-01 12:00:00,a.exe,b.exe,"two\nlines",1,2,1\n'
    for name, text, several in (("plain.csv", plain, False), ("broken.csv", broken, True)):
        (tmp_path / name).write_text(text)
        path = str(tmp_path / name)
        assert has_broken_lines(spark, path) is several
        auto, whole = read_intake(spark, path).events, read_intake(spark, path, multi_line=True).events
        assert auto.collect() == whole.collect() and auto.count() == 1


INTAKE = {
    "timestamp": "2024-01-01 12:00:00", "image": r"C:\cmd.exe", "parent_image": "p.exe",
    "command_line": "whoami", "pid": "1000", "ppid": "500", "event_type": "4688", "anomaly_score": "-0.2",
}


def write_csv(path, row):
    path.write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")
    return str(path)


@pytest.mark.parametrize("name", ["events.csv", "EVENTS.CSV"])
def test_intake_csv(spark, tmp_path, name):
    taken = intake.read_intake(spark, write_csv(tmp_path / name, INTAKE))
    row = taken.events.first()
    assert (row.process_image, row.pid, row.ppid, row.anomaly_score) == (r"C:\cmd.exe", 1000, 500, -0.2)
    assert (row.risk_level, row.flagged, row.explanation) == ("Critical", True, "")


@pytest.mark.parametrize("name", ["events.parquet", "data.PARQUET"])
def test_intake_parquet(spark, tmp_path, name):
    spark.createDataFrame([tuple(INTAKE.values())], ", ".join(f"{c} string" for c in INTAKE)).write.parquet(
        str(tmp_path / name)
    )
    assert intake.read_intake(spark, str(tmp_path / name)).events.count() == 1


@pytest.mark.parametrize(
    "change, problem",
    [({"timestamp": "not-a-date"}, "timestamp"), ({"pid": "abc"}, "numeric"), ({"ppid": "def"}, "numeric")],
)
def test_intake_rejects_unusable_columns(spark, tmp_path, change, problem):
    taken = intake.read_intake(spark, write_csv(tmp_path / "bad.csv", {**INTAKE, **change}))
    assert taken.events is None and problem in taken.problem


def test_intake_rejects_files(spark, tmp_path):
    assert "not a" in intake.read_intake(spark, str(tmp_path / "events.txt")).problem
    assert "missing" in intake.read_intake(spark, write_csv(tmp_path / "m.csv", {"timestamp": "2024-01-01"})).problem
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    assert "unreadable" in intake.read_intake(spark, str(tmp_path / "bad.parquet")).problem
    assert "unreadable" in intake.read_intake(spark, str(tmp_path / "absent.csv")).problem


def test_intake_empty_csv_is_an_empty_frame(spark, tmp_path):
    (tmp_path / "empty.csv").write_text(",".join(INTAKE) + "\n")
    taken = intake.read_intake(spark, str(tmp_path / "empty.csv"))
    assert taken.problem is None and taken.events.count() == 0


def test_intake_csv_keeps_line_breaks_in_quotes(spark, tmp_path):
    row = {**INTAKE, "command_line": '"two\nlines, ""quoted"""'}
    taken = intake.read_intake(spark, write_csv(tmp_path / "q.csv", row))
    assert taken.events.first().command_line == 'two\nlines, "quoted"'


def test_aliases_and_fills(spark):
    df = spark.createDataFrame([("a.exe", "b.exe")], "`image` string, `parent image` string")
    assert intake.rename_aliases(df).columns == ["process_image", "parent_image"]
    both = spark.createDataFrame([("a", "b")], "image string, process_image string")
    assert intake.rename_aliases(both).columns == ["image", "process_image"]
    levels = spark.createDataFrame([("Critical",), ("Normal",), ("Low",), (None,)], "risk_level string")
    filled = intake.fill_risk_and_flagged(levels).collect()
    assert [r.flagged for r in filled] == [True, False, True, True]
    assert {r.explanation for r in filled} == {""}


def test_config_json(spark, tmp_path):
    config = artifacts.threshold_config(spark, 0.05)
    artifacts.save_config(config, str(tmp_path / "config"))
    text = spark.read.text(str(tmp_path / "config")).first().value
    data = json.loads(text)
    assert data["score_threshold"] == 0.05 and data["shap_enabled"] is False
    assert data["risk_level_bounds"] == {"Critical": 0.02, "High": 0.05, "Medium": 0.1, "Low": 0.2}
    assert "hidden_flags >= 2" in data["strong_indicator_definition"]


def test_artifacts_round_trip(spark, tmp_path):
    features = spark.range(3).select(F.col("id").alias("event_id"), F.lit(1).alias("x"))
    labels = features.select("event_id", F.lit(0).alias("is_attack"))
    artifacts.save_features(features, labels, features, str(tmp_path))
    assert artifacts.read_labels(spark, f"{tmp_path}/y_labels.parquet").count() == 3
    lone = labels.withColumnRenamed("is_attack", "other")
    lone.write.parquet(f"{tmp_path}/lone")
    assert artifacts.read_labels(spark, f"{tmp_path}/lone").columns == ["event_id", "is_attack"]
    lone.withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/two")
    assert artifacts.read_labels(spark, f"{tmp_path}/two") is None
    assert artifacts.read_optional(spark, f"{tmp_path}/absent") is None
    artifacts.save_top(features, f"{tmp_path}/top.csv")
    assert spark.read.csv(f"{tmp_path}/top.csv", header=True).count() == 3
    artifacts.save_gated(labels.withColumn("risk_level", F.lit("Low")), f"{tmp_path}/gated", by_risk=True)
    assert intake.read_gated(spark, f"{tmp_path}/gated").where("flagged").count() == 3
    assert intake.read_gated(spark, f"{tmp_path}/absent") is None
    matrix = artifacts.model_matrix(
        spark.createDataFrame([(1, None, float("nan"))], "event_id bigint, a int, b double"), ["a", "b"]
    )
    assert tuple(matrix.first()) == (1, 0.0, 0.0)
