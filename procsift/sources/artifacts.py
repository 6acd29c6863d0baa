"""Stored results: Parquet tables between the stages, CSV and JSON exports."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsift.schema import FEATURES, RISK_QUANTILES, STRONG_INDICATOR_TEXT


# An absent path raises the first, a broken footer the second.
READ_ERRORS = (PySparkException, Py4JJavaError)


def read_optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A Parquet table, or none where the path is absent or unreadable."""
    if not path:
        return None
    try:
        return spark.read.parquet(path)
    except READ_ERRORS:
        return None


def read_labels(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Labels as ``event_id, is_attack``; a lone other column serves as label."""
    table = read_optional(spark, path)
    if table is None:
        return None
    values = [c for c in table.columns if c != "event_id"]
    if "is_attack" in values:
        return table.select("event_id", "is_attack")
    if len(values) == 1:
        return table.select("event_id", F.col(f"`{values[0]}`").alias("is_attack"))
    return None


def save_features(features: DataFrame, labels: DataFrame, events: DataFrame, output: str) -> None:
    """Features, labels and prepared events as three Parquet tables."""
    features.write.mode("overwrite").parquet(f"{output}/X_features.parquet")
    labels.select("event_id", "is_attack").write.mode("overwrite").parquet(
        f"{output}/y_labels.parquet"
    )
    events.write.mode("overwrite").parquet(f"{output}/events_prepped.parquet")


def save_scored(scored: DataFrame, path: str, *, by_source: bool = False) -> None:
    writer = scored.write.mode("overwrite")
    if by_source:
        writer = writer.partitionBy("source")
    writer.parquet(path)


def save_gated(gated: DataFrame, path: str, *, by_risk: bool = False) -> None:
    writer = gated.write.mode("overwrite")
    if by_risk:
        writer = writer.partitionBy("risk_level")
    writer.parquet(path)


def threshold_config(
    spark: SparkSession,
    score_threshold: float | None,
    quantiles: dict[str, float] | None = None,
    *,
    shap_enabled: bool = False,
) -> DataFrame:
    """The gate settings as one row."""
    bounds = quantiles or RISK_QUANTILES
    return spark.range(1).select(
        F.lit(score_threshold).cast("double").alias("score_threshold"),
        F.create_map(
            *[F.lit(x) for level, p in bounds.items() for x in (level, float(p))]
        ).alias("risk_level_bounds"),
        F.lit(STRONG_INDICATOR_TEXT).alias("strong_indicator_definition"),
        F.lit(shap_enabled).alias("shap_enabled"),
    )


def save_config(config: DataFrame, path: str) -> None:
    """One JSON object; a null threshold stays in the text as null."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    config.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_top(rows: DataFrame, path: str) -> None:
    """A short ranked report (already limited) as one CSV file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_rows(rows: DataFrame, path: str) -> None:
    """Any number of rows as CSV, one file per partition in sort order."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def model_matrix(
    df: DataFrame, features: list[str] | None = None, more: list[Column] | None = None
) -> DataFrame:
    """``event_id``, ``more``, and the model's columns in order, missing values as 0."""
    names = features or FEATURES
    return df.select(
        "event_id",
        *(more or []),
        *[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(n) for n in names],
    )
