"""Risk bands, the two-condition gate and the explanations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsift.functions.reasons import reason_list, reason_text
from procsift.operators.quantiles import exact_quantiles
from procsift.schema import (
    FEATURES,
    GATE_QUANTILE,
    NOT_FLAGGED,
    RISK_LEVELS,
    RISK_QUANTILES,
)
from procsift.sources.unified import column_or_null


def merge_scored(scored: DataFrame, features: DataFrame) -> DataFrame:
    """Scored rows with their features, by ``event_id``; on equal names the
    scored column stays."""
    extra = [c for c in FEATURES if c in features.columns and c not in scored.columns]
    return scored.join(features.select("event_id", *extra), "event_id", "left")


def _usable(score: Column) -> Column:
    """The score as DOUBLE with NaN as null."""
    number = score.cast("double")
    return F.when(~F.isnan(number), number)


def risk_bounds(
    df: DataFrame, score_col: str = "anomaly_score", quantiles: Mapping[str, float] | None = None
) -> dict[str, float | None]:
    """Upper score bound of each band."""
    wanted = dict(quantiles or RISK_QUANTILES)
    values = exact_quantiles(df, score_col, [float(p) for p in wanted.values()])
    return dict(zip(wanted, values))


def risk_level(score: Column, bounds: Mapping[str, float | None]) -> Column:
    """Band of a score: the first bound, from Critical down, that it reaches.

    Only the four known names count; an absent one never matches.
    """
    value = _usable(score)
    level = F
    for name in RISK_LEVELS[:-1]:
        bound = bounds.get(name)
        if bound is not None:
            level = level.when(value <= F.lit(float(bound)), F.lit(name))
    normal = F.lit(RISK_LEVELS[-1])
    return normal if level is F else level.otherwise(normal)


def add_risk_level(
    df: DataFrame,
    score_col: str = "anomaly_score",
    quantiles: Mapping[str, float] | None = None,
    *,
    bounds: Mapping[str, float | None] | None = None,
) -> DataFrame:
    """Add ``risk_level`` from bounds given, or computed from the scores."""
    if bounds is None:
        bounds = risk_bounds(df, score_col, quantiles)
    return df.withColumn("risk_level", risk_level(F.col(score_col), bounds))


def strong_indicator(df: DataFrame) -> Column:
    """Suspicious parent, or dump precursor, or two flags and more."""
    zero = F.lit(0)
    parent = F.coalesce(column_or_null(df, "suspicious_parent", "int"), zero)
    dump = F.coalesce(column_or_null(df, "dump_precursor", "int"), zero)
    flags = F.coalesce(column_or_null(df, "hidden_flags", "int"), zero)
    return (parent == 1) | (dump == 1) | (flags >= 2)


def gate_threshold(df: DataFrame, score_col: str = "anomaly_score") -> float | None:
    return exact_quantiles(df, score_col, [GATE_QUANTILE])[0]


def add_flagged(
    df: DataFrame, score_threshold: float | None = None, score_col: str = "anomaly_score"
) -> tuple[DataFrame, float | None]:
    """Add ``flagged``: score under the threshold and a strong indicator.

    The threshold defaults to the 5 % quantile of the scores; it is returned.
    """
    if score_threshold is None:
        score_threshold = gate_threshold(df, score_col)
    low = _usable(F.col(score_col)) < F.lit(score_threshold).cast("double")
    flagged = F.coalesce(low, F.lit(False)) & strong_indicator(df)
    return df.withColumn("flagged", flagged), score_threshold


def explanation(df: DataFrame, score_col: str = "anomaly_score") -> Column:
    reasons = reason_list(
        column_or_null(df, "process_image"),
        column_or_null(df, "command_line"),
        column_or_null(df, "target_image"),
        dump_precursor=column_or_null(df, "dump_precursor", "int"),
        hidden_flags=column_or_null(df, "hidden_flags", "int"),
        unusual_chain=column_or_null(df, "unusual_chain", "double"),
        cmd_entropy=column_or_null(df, "cmd_entropy", "double"),
        long_cmd=column_or_null(df, "long_cmd", "int"),
        suspicious_parent=column_or_null(df, "suspicious_parent", "int"),
    )
    return reason_text(reasons, F.col(score_col).cast("double"))


def add_explanations(df: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
    """Add ``explanation``: reasons of flagged rows, a dash for the others."""
    flagged = F.coalesce(column_or_null(df, "flagged", "boolean"), F.lit(False))
    text = F.when(flagged, explanation(df, score_col)).otherwise(F.lit(NOT_FLAGGED))
    return df.withColumn("explanation", text)


def gate(
    df: DataFrame,
    score_threshold: float | None = None,
    *,
    score_col: str = "anomaly_score",
) -> tuple[DataFrame, float | None, dict[str, float | None]]:
    """Bands, gate and explanations with all bounds from one pass of quantiles."""
    wanted = list(RISK_QUANTILES.values()) + [GATE_QUANTILE]
    values = exact_quantiles(df, score_col, wanted)
    bounds = dict(zip(RISK_QUANTILES, values))
    threshold = values[-1] if score_threshold is None else score_threshold
    banded = add_risk_level(df, score_col, bounds=bounds)
    flagged, threshold = add_flagged(banded, threshold, score_col)
    return add_explanations(flagged, score_col), threshold, bounds
