"""Intake of externally scored events: checks, aliases and filled columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsift.functions.ids import numeric_id
from procsift.functions.times import parse_utc
from procsift.operators.gating import add_risk_level
from procsift.schema import INTAKE_COLUMNS
from procsift.sources.artifacts import READ_ERRORS
from procsift.sources.csvsplits import read_broken_csv

ALIASES = {"image": "process_image", "parent image": "parent_image"}


@dataclass(frozen=True)
class Intake:
    """Accepted events, or none with the reason for the rejection."""

    events: DataFrame | None
    problem: str | None = None


def rename_aliases(df: DataFrame) -> DataFrame:
    """``image`` and ``parent image`` become the unified names if those lack."""
    renames = {
        old: new for old, new in ALIASES.items() if old in df.columns and new not in df.columns
    }
    return df.withColumnsRenamed(renames)


def fill_risk_and_flagged(df: DataFrame) -> DataFrame:
    """Add ``risk_level``, ``flagged`` and ``explanation`` where they lack.

    A filled ``flagged`` means any band but Normal, a filled explanation is
    the empty text.
    """
    if "risk_level" not in df.columns and "anomaly_score" in df.columns:
        df = add_risk_level(df)
    if "flagged" not in df.columns and "risk_level" in df.columns:
        df = df.withColumn(
            "flagged", F.coalesce(F.col("risk_level") != "Normal", F.lit(True))
        )
    if "explanation" not in df.columns:
        df = df.withColumn("explanation", F.lit(""))
    return df


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in INTAKE_COLUMNS if c not in df.columns]


def intake_counts(df: DataFrame) -> DataFrame:
    """One row: rows, and usable timestamps, pids and parent pids among them."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(parse_utc(F.col("timestamp").cast("string"))).alias("n_timestamps"),
        F.count(numeric_id(F.col("pid"))).alias("n_pids"),
        F.count(numeric_id(F.col("ppid"))).alias("n_ppids"),
    )


def accepted(counts: DataFrame) -> DataFrame:
    """The counts with the verdict: one usable value per column is enough."""
    usable = (F.col("n_timestamps") > 0) & (F.col("n_pids") > 0) & (F.col("n_ppids") > 0)
    return counts.withColumn("accepted", usable | (F.col("n_rows") == 0))


def check_events(df: DataFrame) -> Intake:
    """Validate a frame; accepted events come back typed and filled."""
    df = rename_aliases(df)
    if df.isEmpty():
        return Intake(df)
    missing = missing_columns(df)
    if missing:
        return Intake(None, "missing columns: " + ", ".join(missing))
    counts = accepted(intake_counts(df)).first()
    if not counts["accepted"]:
        if counts["n_timestamps"] == 0:
            return Intake(None, "no timestamp can be parsed")
        return Intake(None, "no numeric pid and ppid")
    typed = df.withColumns(
        {"pid": numeric_id(F.col("pid")), "ppid": numeric_id(F.col("ppid"))}
    )
    if "anomaly_score" in typed.columns:
        typed = typed.withColumn("anomaly_score", F.col("anomaly_score").try_cast("double"))
    if dict(typed.dtypes).get("flagged") == "string":
        typed = typed.withColumn("flagged", F.col("flagged").try_cast("boolean"))
    return Intake(fill_risk_and_flagged(typed))


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value of a CSV file may go over several lines.

    A line with an odd number of quotes begins or ends such a value; without
    any, every line is a record and the file can be read in splits.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_intake(spark: SparkSession, path: str, *, multi_line: bool | None = None) -> Intake:
    """CSV (with header) or Parquet by extension, then the checks.

    Files are read in splits, also where quoted values hold line breaks; only
    those whose quotes don't tell where values begin are read by one task each.
    ``multi_line`` decides without a look: true for one task each, false for
    lines. All ways give the same rows where they apply.
    """
    name = path.lower().rstrip("/")
    try:
        if name.endswith(".parquet"):
            df = spark.read.parquet(path)
        elif name.endswith(".csv"):
            df = None
            if multi_line is None:
                multi_line = has_broken_lines(spark, path)
                df = read_broken_csv(spark, path) if multi_line else None
            if df is None:
                df = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
        else:
            return Intake(None, "not a .csv or .parquet file")
    except READ_ERRORS as error:
        return Intake(None, f"unreadable file: {type(error).__name__}")
    return check_events(df)


def read_gated(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored result, normalised and filled; none where it cannot be read."""
    try:
        df = spark.read.parquet(path)
    except READ_ERRORS:
        return None
    return fill_risk_and_flagged(rename_aliases(df))
