"""Evaluation reports, rankings, histograms and correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from procsift.functions.text import lowered
from procsift.operators.quantiles import MAX_VALUES, exact_quantiles
from procsift.schema import FEATURES, KEY_PATTERNS
from procsift.sources.unified import column_or_null

PREDICTION = "_predicted"
# A sketch of two to this many hashes counts that many distinct values exactly.
_SKETCH_BITS = 10


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``is_attack`` by ``event_id``; a missing label counts as 0."""
    found = df.drop("is_attack").join(
        labels.select("event_id", F.col("is_attack").cast("int").alias("is_attack")),
        "event_id",
        "left",
    )
    return found.withColumn("is_attack", F.coalesce("is_attack", F.lit(0)))


def labelled_rows(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` that have a label."""
    return df.join(labels.select("event_id"), "event_id", "left_semi")


def any_overlap(df: DataFrame, labels: DataFrame) -> bool:
    """Whether any row of ``df`` has a label."""
    return not labelled_rows(df.select("event_id"), labels).isEmpty()


def precision_recall(labelled: DataFrame, predicted: Column) -> DataFrame:
    """One row: counts, precision, recall and F1 (0 where undefined)."""
    hit = F.coalesce(predicted.cast("boolean"), F.lit(False))
    true = F.coalesce(F.col("is_attack") == 1, F.lit(False))
    counts = labelled.agg(
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    return counts.select(
        "tp",
        "fp",
        "fn",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def confusion_matrix(labelled: DataFrame, predicted: Column) -> DataFrame:
    """Two rows (true class 0 and 1) by two columns (predicted class)."""
    hit = F.coalesce(predicted.cast("boolean"), F.lit(False))
    counts = labelled.agg(
        *[
            F.count_if((F.col("is_attack") == true) & (hit == F.lit(bool(guess)))).alias(f"_{true}{guess}")
            for true in (0, 1)
            for guess in (0, 1)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(true).alias("is_attack"),
                F.col(f"_{true}0").alias("predicted_0"),
                F.col(f"_{true}1").alias("predicted_1"),
            )
            for true in (0, 1)
        ]
    )
    return counts.select(F.inline(rows))


def pattern_counts(df: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Key patterns in the flagged rows: command hits plus process hits.

    A row can count twice. ``warn`` tells that a pattern has no hit although
    rows are flagged.
    """
    names = patterns or KEY_PATTERNS
    command = lowered(column_or_null(df, "command_line"))
    process = lowered(column_or_null(df, "process_image"))
    flagged = df.where(F.coalesce("flagged", F.lit(False)))
    aggregates = [F.count(F.lit(1)).alias("n_flagged")]
    for i, word in enumerate(names):
        hits = F.contains(command, F.lit(word)).cast("bigint") + F.contains(
            process, F.lit(word)
        ).cast("bigint")
        aggregates.append(F.coalesce(F.sum(hits), F.lit(0)).alias(f"_{i}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(word).alias("pattern"),
                F.col(f"_{i}").alias("hits"),
                F.col("n_flagged"),
                ((F.col(f"_{i}") == 0) & (F.col("n_flagged") > 0)).alias("warn"),
            )
            for i, word in enumerate(names)
        ]
    )
    return flagged.agg(*aggregates).select(F.inline(rows))


def trace_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that the frame has, with the row id in front."""
    names = [c for c in ["event_id", *wanted] if c in df.columns]
    return df.select(*dict.fromkeys(names))


ANOMALY_COLUMNS = ["timestamp", "process_image", "parent_image", "command_line", "anomaly_score"]
FLAGGED_COLUMNS = [*ANOMALY_COLUMNS, "risk_level", "explanation"]


def top_anomalies(scored: DataFrame, n: int = 20, score_col: str = "anomaly_score") -> DataFrame:
    """Lowest scores first, missing scores last, ties by row id."""
    ranked = scored.orderBy(F.asc_nulls_last(score_col), "event_id").limit(n)
    return trace_columns(ranked, ANOMALY_COLUMNS)


def top_flagged(gated: DataFrame, n: int = 20) -> DataFrame:
    flagged = gated.where(F.coalesce("flagged", F.lit(False)))
    ranked = flagged.orderBy(F.asc_nulls_last("anomaly_score"), "event_id").limit(n)
    return trace_columns(ranked, FLAGGED_COLUMNS)


def describe_score(df: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
    """count, mean, std (sample), min, quartiles and max as one row."""
    q25, q50, q75 = exact_quantiles(df, score_col, [0.25, 0.5, 0.75])
    value = F.col(score_col).cast("double")
    value = F.when(~F.isnan(value), value)
    return df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.lit(q25).cast("double").alias("q25"),
        F.lit(q50).cast("double").alias("q50"),
        F.lit(q75).cast("double").alias("q75"),
        F.max(value).alias("max"),
    )


def score_quantiles(
    df: DataFrame,
    probs: list[float],
    score_col: str = "anomaly_score",
    *,
    max_values: int = MAX_VALUES,
) -> DataFrame:
    """Threshold ideas: one row per probability."""
    values = exact_quantiles(df, score_col, probs, max_values=max_values)
    return df.sparkSession.createDataFrame(
        [(float(p), v) for p, v in zip(probs, values)], "p double, score double"
    )


def _spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, smallest and largest value per column, as one row."""
    return df.agg(*_spread_columns(columns))


def _spread_columns(columns: list[str]) -> list[Column]:
    aggregates = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        value = F.when(~F.isnan(value), value)
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.min(value).alias(f"lo{i}"),
            F.max(value).alias(f"hi{i}"),
        ]
    return aggregates


def _left_closed_bin(value: Column, low: float, high: float, bins: int) -> Column:
    width = (high - low) / bins
    place = F.floor((value - F.lit(low)) / F.lit(width)) + 1
    return F.least(F.lit(bins).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), place))


def _limits(low: float, high: float) -> tuple[float, float]:
    """A single value gets a bin range of one unit around it."""
    return (low, high) if high > low else (low - 0.5, high + 0.5)


def score_histogram(
    df: DataFrame, score_col: str = "anomaly_score", max_bins: int = 50
) -> DataFrame:
    """``min(max_bins, rows)`` left-closed bins, the last one closed; empty
    bins are listed."""
    n = df.count()
    stats = _spread(df, [score_col]).first()
    if stats["n0"] == 0:
        return df.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    bins = min(max_bins, n)
    low, high = _limits(stats["lo0"], stats["hi0"])
    value = F.col(score_col).cast("double")
    counts = (
        df.where(value.isNotNull() & ~F.isnan(value))
        .groupBy(_left_closed_bin(value, low, high, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _with_empty_bins(counts, low, high, bins)


def _with_empty_bins(counts: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    width = (high - low) / bins
    every = counts.sparkSession.range(1, bins + 1).select(
        F.col("id").alias("bin"),
        (F.lit(low) + (F.col("id") - 1) * F.lit(width)).alias("lo"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("hi"),
    )
    return every.join(counts, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")
    )


def score_bins(df: DataFrame, score_col: str = "anomaly_score", bins: int = 20) -> DataFrame:
    """Equal-width right-closed bins; the lowest edge is widened by 0.1 % of
    the range so that the minimum falls into the first bin. A constant score
    goes into the middle bin of a range of 0.1 % around it."""
    stats = _spread(df, [score_col]).first()
    if stats["n0"] == 0:
        return df.sparkSession.createDataFrame([], "bin bigint, lo double, hi double, n bigint")
    low, high = stats["lo0"], stats["hi0"]
    constant = low == high
    if constant:
        reach = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - reach, high + reach
    width = (high - low) / bins
    value = F.col(score_col).cast("double")
    place = F.ceil((value - F.lit(low)) / F.lit(width))
    place = F.least(F.lit(bins).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), place))
    counts = (
        df.where(value.isNotNull() & ~F.isnan(value))
        .groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    listed = _with_empty_bins(counts, low, high, bins)
    first_edge = F.lit(low if constant else low - 0.001 * (high - low))
    return listed.withColumn("lo", F.when(F.col("bin") == 1, first_edge).otherwise(F.col("lo")))


def feature_histograms(
    features: DataFrame, columns: list[str] | None = None, *, first: int = 8
) -> DataFrame:
    """Left-closed bins of the first features: ``min(50, max(10, distinct))``.

    Distinct values are counted together with the ranges, by sketches of the
    smallest hashes, which are exact for as many values as matter here. So the
    table is read twice, whatever the number of columns.
    """
    names = [c for c in (columns or FEATURES) if c in features.columns][:first]
    shape = "place int, feature string, bin bigint, lo double, hi double"
    spark = features.sparkSession
    if not names:
        return spark.createDataFrame([], shape).drop("place").withColumn("n", F.lit(0).cast("bigint"))
    distinct = [
        F.theta_sketch_estimate(F.theta_sketch_agg(F.col(c).cast("double"), F.lit(_SKETCH_BITS))).alias(f"d{i}")
        for i, c in enumerate(names)
    ]
    spread = features.agg(*_spread_columns(names), *distinct).first()
    entries = []
    shapes = []
    for i, c in enumerate(names):
        if spread[f"n{i}"] == 0:
            continue
        bins = min(50, max(10, int(spread[f"d{i}"])))
        low, high = _limits(spread[f"lo{i}"], spread[f"hi{i}"])
        value = F.col(c).cast("double")
        entries.append(
            F.when(
                value.isNotNull() & ~F.isnan(value),
                (_left_closed_bin(value, low, high, bins) + F.lit(100 * i)).cast("int"),
            )
        )
        width = (high - low) / bins
        shapes += [
            (100 * i + b, c, b, low + (b - 1) * width, low + b * width) for b in range(1, bins + 1)
        ]
    every = spark.createDataFrame(shapes, shape)
    if not entries:
        return every.drop("place").withColumn("n", F.lit(0).cast("bigint"))
    counts = (
        features.select(F.explode(F.array(*entries)).alias("place"))
        .where(F.col("place").isNotNull())
        .groupBy("place")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return every.join(F.broadcast(counts), "place", "left").select(
        "feature", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n")
    )


def _moments(numbers: DataFrame, names: list[str], middle: list[float]) -> DataFrame:
    """(i, j, n, sx, sxx, sxy): sums over the rows where columns i and j are
    both present, of what is left of them without their ``middle``.

    Products of matrices of values and of presence: a task adds up its batches
    and sends one row for each pair, whatever the pattern of nulls.
    """
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, size, size))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            x = np.column_stack(columns) - middle
            there = (~np.isnan(x)).astype(float)
            x = np.where(there > 0, x, 0.0)
            sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        i, j = np.indices((size, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), *[pa.array(m.ravel()) for m in sums]],
            names=["i", "j", "n", "sx", "sxx", "sxy"],
        )

    return (
        numbers.select(*names)
        .mapInArrow(run, "i int, j int, n double, sx double, sxx double, sxy double")
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])
    )


def feature_correlation(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of features, in long form.

    A pair uses the rows where both are present; a constant column gives null,
    and so does a pair with an infinite value. Two passes: the columns' means,
    then all pairs' moments around them, so large values cost no digits.
    Rounding can't take a value beyond 1.
    """
    names = [c for c in (columns or FEATURES) if c in features.columns]
    shape = "feature_a string, feature_b string, correlation double"
    spark = features.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], shape)
    numbers = features.select(*[F.col(c).cast("double").alias(c) for c in names])
    numbers = numbers.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
    means = numbers.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]).first()
    middle = [means[f"m{i}"] if means[f"m{i}"] is not None else 0.0 for i in range(len(names))]
    infinite = [not math.isfinite(m) for m in middle]
    middle = [0.0 if bad else m for m, bad in zip(middle, infinite, strict=True)]
    cells = {(r["i"], r["j"]): r for r in _moments(numbers, names, middle).collect()}  # a row for each pair
    found = {}
    for i in range(len(names)):
        for j in range(i, len(names)):
            value = None
            if (i, j) in cells and not infinite[i] and not infinite[j]:
                value = _pearson(cells[i, j], cells[j, i], middle[i], middle[j])
            found[i, j] = found[j, i] = 1.0 if i == j and value is not None else value
    return spark.createDataFrame([(names[i], names[j], value) for (i, j), value in found.items()], shape)


#: What is left of a constant column's squares by rounding, as a share of its own.
_NO_SPREAD = 1e-24


def _pearson(one: Row, other: Row, middle: float, other_middle: float) -> float | None:
    """The correlation from the moments of a pair, seen from both sides."""
    n = one["n"]
    if not n:
        return None
    left = one["sxx"] / n - (one["sx"] / n) ** 2
    right = other["sxx"] / n - (other["sx"] / n) ** 2
    both = one["sxy"] / n - one["sx"] / n * (other["sx"] / n)
    if not left > _NO_SPREAD * middle**2 or not right > _NO_SPREAD * other_middle**2:
        return None
    value = both / math.sqrt(left) / math.sqrt(right)
    return max(-1.0, min(1.0, value)) if math.isfinite(value) else None


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count_if(F.col("is_attack") == 1).alias("positive"),
        F.count_if(F.col("is_attack") == 0).alias("negative"),
    )
