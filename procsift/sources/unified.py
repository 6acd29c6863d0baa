"""Raw frames to the unified event frame, and their union."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procsift.functions.ids import hex_id, numeric_id
from procsift.functions.times import from_epoch_millis, from_epoch_seconds, parse_utc
from procsift.schema import RAW_FILES, UNIFIED_SCHEMA
from procsift.session import BROADCAST_BYTES, store
from procsift.sources import rawlogs


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or a typed null where the frame lacks it."""
    if name in df.columns:
        return F.col(f"`{name}`")
    return F.lit(None).cast(kind)


def _first_usable(df: DataFrame, first: Column, second: Column, mode: str) -> Column:
    """Timestamp fallback: ``column`` takes ``second`` only if ``first`` is null
    in every row (one early-stopping look at the data), ``row`` decides row by
    row, which is the only choice on a stream."""
    if mode == "row":
        return F.coalesce(first, second)
    if mode != "column":
        raise ValueError(f"timestamp mode must be 'column' or 'row', not {mode!r}")
    absent = df.select(first.alias("t")).where(F.col("t").isNotNull()).isEmpty()
    return second if absent else first


def _unified(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(
        *[
            columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in UNIFIED_SCHEMA.fields
        ],
        *[c for c in df.columns if c in _PLACE],
    )


def normalize_ndjson(df: DataFrame, timestamp_mode: str = "column") -> DataFrame:
    seconds = column_or_null(df, "ProcessStartTime")
    millis = from_epoch_millis(column_or_null(df, "timestamp"))
    if timestamp_mode == "row":
        when = F.coalesce(from_epoch_seconds(seconds), millis)
    else:
        # Presence, not parseability, of the seconds column decides.
        present = not df.where(seconds.isNotNull()).isEmpty()
        when = from_epoch_seconds(seconds) if present else millis
    return _unified(
        df,
        timestamp=when,
        event_type=column_or_null(df, "event_simpleName"),
        process_image=column_or_null(df, "ImageFileName"),
        parent_image=column_or_null(df, "ParentBaseFileName"),
        command_line=column_or_null(df, "CommandLine"),
        pid=numeric_id(column_or_null(df, "RawProcessId")),
        ppid=numeric_id(column_or_null(df, "ParentProcessId")),
        source=F.lit("falcon"),
    )


def normalize_security(df: DataFrame, timestamp_mode: str = "column") -> DataFrame:
    return _unified(
        df,
        timestamp=parse_utc(column_or_null(df, "system_time")),
        event_type=F.lit("4688"),
        process_image=column_or_null(df, "NewProcessName"),
        parent_image=column_or_null(df, "ParentProcessName"),
        command_line=column_or_null(df, "CommandLine"),
        pid=hex_id(column_or_null(df, "NewProcessId")),
        ppid=hex_id(column_or_null(df, "ProcessId")),
        source=F.lit("security_4688"),
    )


def normalize_sysmon(df: DataFrame, timestamp_mode: str = "column") -> DataFrame:
    utc_time = parse_utc(column_or_null(df, "UtcTime"))
    created = parse_utc(column_or_null(df, "TimeCreated"))
    return _unified(
        df,
        timestamp=_first_usable(df, utc_time, created, timestamp_mode),
        event_type=column_or_null(df, "EventID"),
        process_image=F.coalesce(
            column_or_null(df, "Image"), column_or_null(df, "SourceImage")
        ),
        parent_image=column_or_null(df, "ParentImage"),
        command_line=column_or_null(df, "CommandLine"),
        pid=F.coalesce(
            numeric_id(column_or_null(df, "ProcessId")),
            numeric_id(column_or_null(df, "SourceProcessId")),
        ),
        ppid=numeric_id(column_or_null(df, "ParentProcessId")),
        source=F.lit("sysmon"),
        target_image=column_or_null(df, "TargetImage"),
        target_pid=numeric_id(column_or_null(df, "TargetProcessId")),
    )


NORMALIZERS = {
    "falcon": normalize_ndjson,
    "security_4688": normalize_security,
    "sysmon": normalize_sysmon,
}


def to_unified(df: DataFrame, source: str, timestamp_mode: str = "column") -> DataFrame:
    """Normalise the raw frame of a named source."""
    if source not in NORMALIZERS:
        raise ValueError(f"Unknown source: {source!r}")
    return NORMALIZERS[source](df, timestamp_mode)


def union_events(parts: list[DataFrame]) -> DataFrame:
    """All parts in one frame, aligned by column name."""
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined


# Where a row came from, on its way to an id.
_PLACE = ["_source", "_file", "_block", "_at"]


def with_places(lines: DataFrame, source: int) -> DataFrame:
    """Lines of a file scan with their source, file and split."""
    return lines.select(
        "*",
        F.lit(source).alias("_source"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def with_event_id(events: DataFrame) -> DataFrame:
    """``event_id`` in front, in the place of the place columns: 0, 1, 2, ...
    in the order of sources, files by name, and lines.

    Rows are counted for each split of a file; the running sum over the splits
    is where a split's ids begin. However the files are split, and whichever
    task reads a split, a row has the same id. The rows are stored once, and
    the table of splits is small: some hundred bytes for each of them.
    """
    rows = store(events, "numbered").df
    split = ["_source", "_file", "_block"]
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = store(
        rows.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
        .select(*split, "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")),
        "splits",
    )
    table = F.broadcast(starts.df) if starts.bytes <= BROADCAST_BYTES else starts.df
    event_id = F.col("_base") + F.col("_at") - F.col("_first")
    kept = [c for c in events.columns if c not in _PLACE]
    return rows.join(table, split).select(event_id.alias("event_id"), *kept)


def _existing_text(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def raw_lines(
    spark: SparkSession, data_dir: str, files: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Text lines of each source found in a directory; missing ones left out."""
    found = {}
    for source, name in (files or RAW_FILES).items():
        lines = _existing_text(spark, f"{data_dir.rstrip('/')}/{name}")
        if lines is not None:
            found[source] = lines
    return found


def combined_events(
    spark: SparkSession,
    data_dir: str,
    *,
    files: dict[str, str] | None = None,
    timestamp_mode: str = "column",
) -> DataFrame:
    """Every source of the directory, normalised and united, with ids."""
    lines = raw_lines(spark, data_dir, files)
    if not lines:
        return spark.createDataFrame([], UNIFIED_SCHEMA).select(
            F.lit(0).cast("bigint").alias("event_id"), "*"
        )
    parts = []
    for i, (source, frame) in enumerate(lines.items()):
        good = rawlogs.good_rows(rawlogs.PARSERS[source](with_places(frame, i)))
        # Counted behind the filter, so good rows have no gaps between them.
        counted = good.withColumn("_at", F.monotonically_increasing_id())
        parts.append(to_unified(counted, source, timestamp_mode))
    return with_event_id(union_events(parts))
