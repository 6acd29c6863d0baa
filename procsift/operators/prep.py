"""Preparation of unified events, and the sanity predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsift.functions.ids import numeric_id
from procsift.functions.text import base_name, keyword_match
from procsift.schema import COMPLETENESS, REQUIRED_COLUMNS, SUSPICIOUS_KEYWORDS


def complete_rows(
    df: DataFrame,
    required: Iterable[str] = tuple(REQUIRED_COLUMNS),
    threshold: float = COMPLETENESS,
) -> DataFrame:
    """Rows where at least ``threshold`` of the required columns are present.

    Columns the frame lacks are not counted; blank text counts as present.
    With the defaults (0.9 of five) all five must be there.
    """
    present = [c for c in required if c in df.columns]
    if not present:
        return df
    needed = threshold * len(present)
    if needed > len(present) - 1:
        # All of them: plain conjuncts, which reach the Parquet scan.
        condition = F.lit(True)
        for name in present:
            condition = condition & F.col(name).isNotNull()
        return df.where(condition)
    filled = sum((F.col(c).isNotNull().cast("int") for c in present), F.lit(0))
    return df.where(filled >= needed)


def prep_events(
    df: DataFrame,
    *,
    required: Iterable[str] = tuple(REQUIRED_COLUMNS),
    threshold: float = COMPLETENESS,
    path_mode: str = "compat",
) -> DataFrame:
    """Completeness filter, basenames, integer ids, event type as text."""
    kept = complete_rows(df, required, threshold)
    target = F.col("target_image") if "target_image" in df.columns else F.lit(None).cast("string")
    new = {
        "process_image_base": base_name(F.col("process_image"), path_mode),
        "parent_image_base": base_name(F.col("parent_image"), path_mode),
        "target_image_base": base_name(target, path_mode),
    }
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in ("pid", "ppid"):
        if name in kinds and not isinstance(kinds[name], T.LongType):
            new[name] = numeric_id(F.col(name))
    if "event_type" in kinds and not isinstance(kinds["event_type"], T.StringType):
        number = numeric_id(F.col("event_type")).cast("string")
        new["event_type"] = F.coalesce(number, F.col("event_type").cast("string"))
    return kept.withColumns(new)


def suspicious_match(
    df: DataFrame,
    column: str = "command_line",
    keywords: list[str] | None = None,
    *,
    literal: bool = False,
) -> Column:
    """Whether any keyword (a regex, case-insensitive) occurs in the column."""
    if column not in df.columns:
        return F.lit(False)
    return keyword_match(F.col(column), keywords or SUSPICIOUS_KEYWORDS, literal=literal)


def null_summary(df: DataFrame) -> DataFrame:
    """One row per column with its number of nulls."""
    counts = df.agg(
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("nulls"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(F.inline(entries))


def event_type_column(df: DataFrame) -> str | None:
    for name in ("event_type", "event_simpleName", "EventID"):
        if name in df.columns:
            return name
    return None


def event_type_counts(df: DataFrame) -> DataFrame:
    """Rows per event type, nulls left out, most frequent first."""
    name = event_type_column(df)
    if name is None:
        raise ValueError("no event-type column")
    kind = F.col(name).cast("string").alias("event_type")
    return (
        df.select(kind)
        .where(F.col("event_type").isNotNull())
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "event_type")
    )
