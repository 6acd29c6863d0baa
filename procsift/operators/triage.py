"""The analyst's queries over gated events."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsift.functions.text import keyword_match, short_command
from procsift.schema import RISK_LEVELS, SHORT_COMMAND
from procsift.sources.unified import column_or_null

VIEW_COLUMNS = [
    "timestamp",
    "risk_level",
    "process_image",
    "parent_image",
    "command_line",
    "explanation",
    "anomaly_score",
]
SORT_COLUMNS = ("anomaly_score", "risk_level", "timestamp")


def alert_condition(df: DataFrame) -> Column:
    """Flagged where the column exists, else any band but Normal, else none."""
    if "flagged" in df.columns:
        return F.coalesce(F.col("flagged").cast("boolean"), F.lit(False))
    if "risk_level" in df.columns:
        return F.coalesce(F.col("risk_level") != "Normal", F.lit(True))
    return F.lit(False)


def alert_set(df: DataFrame) -> DataFrame:
    return df.where(alert_condition(df))


def kpi_summary(df: DataFrame) -> DataFrame:
    """Rows, alerts and the alerts' percentage (0 for an empty frame)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(alert_condition(df)).alias("flagged")
    )
    share = F.try_divide(F.col("flagged") * 100.0, F.col("total").cast("double"))
    return counts.withColumn("pct_flagged", F.coalesce(share, F.lit(0.0)))


def top_values(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """Most frequent values of a column among the alerts, ties by value."""
    return (
        alert_set(df)
        .select(column_or_null(df, column).alias(column))
        .where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def risk_distribution(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("risk_level").isNotNull())
        .groupBy("risk_level")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "risk_level")
    )


def risk_rank(level: Column) -> Column:
    """Critical 0 to Normal 4, null for any other text."""
    rank = F
    for i, name in enumerate(RISK_LEVELS):
        rank = rank.when(level == name, F.lit(i))
    return rank


def filter_risk(df: DataFrame, levels: list[str]) -> DataFrame:
    return df.where(F.col("risk_level").isin(levels))


def filter_keyword(df: DataFrame, keyword: str, *, literal: bool = False) -> DataFrame:
    """Case-insensitive regex on the command line; a bad one raises at once."""
    if not literal:
        try:
            re.compile(keyword)
        except re.error as error:
            raise ValueError(f"not a regular expression: {keyword!r} ({error})") from error
    return df.where(keyword_match(F.col("command_line"), [keyword], literal=literal))


def sort_alerts(df: DataFrame, by: str = "anomaly_score", *, ascending: bool = True) -> DataFrame:
    """Global sort, missing values last either way, ties by row id."""
    if by not in SORT_COLUMNS:
        raise ValueError(f"sort column must be one of {SORT_COLUMNS}, not {by!r}")
    key = risk_rank(F.col(by)) if by == "risk_level" else F.col(by)
    order = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    ties = ["event_id"] if "event_id" in df.columns else []
    return df.orderBy(order, *ties)


def triage_rows(
    df: DataFrame,
    *,
    levels: list[str] | None = None,
    keyword: str | None = None,
    sort_by: str = "anomaly_score",
    ascending: bool = True,
) -> DataFrame:
    """Alerts, filtered and sorted; without levels all bands but Normal."""
    rows = filter_risk(alert_set(df), RISK_LEVELS[:-1] if levels is None else levels)
    if keyword:
        rows = filter_keyword(rows, keyword)
    return sort_alerts(rows, sort_by, ascending=ascending)


def triage_view(rows: DataFrame) -> DataFrame:
    """Display columns with the command line cut to 80 characters."""
    names = [c for c in ["event_id", *VIEW_COLUMNS] if c in rows.columns]
    shown = [
        short_command(F.col(c), SHORT_COMMAND).alias(c) if c == "command_line" else F.col(c)
        for c in names
    ]
    return rows.select(*shown)
