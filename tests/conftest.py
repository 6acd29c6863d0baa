"""Shared session and frames."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from procsift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def dump_story(spark):
    """A credential dump in five events: shell, listing, dump, upload, clean-up."""
    shell, sysdir = "C:/Windows/System32/cmd.exe", "C:/Windows/System32"
    steps = [
        ("1", shell, "C:/Program Files/Mail/mail.exe", "cmd.exe /c tasklist", 900, 31, None),
        ("1", f"{sysdir}/tasklist.exe", shell, "tasklist /svc", 901, 900, None),
        ("10", "D:/tools/nanodump.exe", shell, "nanodump -w d:/x.bin", 902, 900, f"{sysdir}/lsass.exe"),
        ("4688", f"{sysdir}/WindowsPowerShell/v1.0/powershell.exe", shell, "powershell -nop -enc QQ==", 903, 900, None),
        ("1", f"{sysdir}/cmd.exe", f"{sysdir}/services.exe", "cmd.exe /c del d:\\x.bin", 904, 903, None),
    ]
    rows = [
        (i, f"2023-02-03 04:05:{10 * i:02d}", kind, image, parent, command, pid, ppid, target)
        for i, (kind, image, parent, command, pid, ppid, target) in enumerate(steps)
    ]
    names = (
        "event_id bigint, timestamp string, event_type string, process_image string, "
        "parent_image string, command_line string, pid bigint, ppid bigint, target_image string"
    )
    frame = spark.createDataFrame(rows, names)
    return frame.withColumn("timestamp", frame.timestamp.cast("timestamp_ntz"))


@pytest.fixture(scope="session")
def graded_rows(spark):
    """Thirty scores from -1.5 up in tenths; every third row has an indicator, each kind in turn."""
    rows = [
        (i, (i - 15) / 10, f"tool{i}.exe", "runner.exe", f"tool{i} --once",
         int(i % 9 == 0), int(i % 9 == 3), 2 * int(i % 9 == 6), 0.25, 1.5, 0)
        for i in range(30)
    ]
    return spark.createDataFrame(
        rows,
        "event_id bigint, anomaly_score double, process_image string, parent_image string, "
        "command_line string, suspicious_parent int, dump_precursor int, hidden_flags int, "
        "unusual_chain double, cmd_entropy double, long_cmd int",
    )
