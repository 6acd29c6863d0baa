"""Scans of the three raw log formats: one text line per event.

``*_lines`` functions parse any DataFrame with a ``value`` text column, batch
or streaming, and keep every line: ``malformed`` marks those that are not one
well-formed event. ``read_*`` functions scan files and return good rows only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The declared fields of each format.
NDJSON_FIELDS = [
    "event_simpleName",
    "ProcessStartTime",
    "timestamp",
    "ImageFileName",
    "ParentBaseFileName",
    "CommandLine",
    "RawProcessId",
    "ParentProcessId",
]
SECURITY_FIELDS = [
    "NewProcessId",
    "NewProcessName",
    "ProcessId",
    "CommandLine",
    "ParentProcessName",
]
SYSMON_FIELDS = [
    "UtcTime",
    "Image",
    "ParentImage",
    "ProcessId",
    "ParentProcessId",
    "CommandLine",
    "SourceImage",
    "SourceProcessId",
    "TargetImage",
    "TargetProcessId",
]
PROCESS_CREATION = "ProcessRollup2"

_EVENT_XML = (
    "System struct<EventID: string, TimeCreated: struct<_SystemTime: string>>, "
    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>, "
    "_malformed string"
)
_XML_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_malformed",
    "ignoreSurroundingSpaces": "false",
}
_CLOSING = r"</([\w.-]+:)?Event\s*>"


def _once(lines: DataFrame, parsed: Column, name: str) -> DataFrame:
    """Add a parsed value, given as an array of one, through a generator.

    A filter on a projected column is pushed below it together with a copy of
    the expression, so every line would be parsed twice. No filter passes a
    generator.
    """
    return lines.select("*", F.explode_outer(parsed).alias(name))


def ndjson_lines(lines: DataFrame) -> DataFrame:
    """Parse JSON lines into the declared fields, all as text.

    A line is wrapped in brackets before parsing: trailing text, a second
    object, a non-object and a blank line then all fail to be a one-element
    array of objects.
    """
    record = ", ".join(f"{f}: string" for f in NDJSON_FIELDS)
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    parsed = F.from_json(
        wrapped, f"array<struct<{record}>>", {"allowSingleQuotes": "false"}
    )
    one = F.transform(
        F.array(parsed), lambda rows: F.when(F.size(rows) == 1, F.try_element_at(rows, F.lit(1)))
    )
    return (
        _once(lines, one, "_row")
        .select(
            "*",
            F.col("_row").isNull().alias("malformed"),
            *[F.col(f"_row.{f}").alias(f) for f in NDJSON_FIELDS],
        )
        .drop("_row")
    )


def _xml_events(lines: DataFrame) -> DataFrame:
    event = F.from_xml(F.col("value"), _EVENT_XML, _XML_OPTIONS)
    text = F.trim("value")
    single = text.endswith(">") & (F.regexp_count(text, F.lit(_CLOSING)) <= 1)
    items = F.reverse("_event.EventData.Data")
    return _once(lines, F.array(event), "_event").select(
        "*",
        (F.col("value").isNull() | F.col("_event._malformed").isNotNull() | ~single).alias("malformed"),
        items["_Name"].alias("_names"),
        items["_VALUE"].alias("_values"),
    )


def _data_item(name: str) -> Column:
    """The last ``Data`` item of that name; an empty element is null. Items are
    listed backwards, so it is the first that has the name."""
    place = F.nullif(F.array_position("_names", F.lit(name)), F.lit(0).cast("bigint"))
    return F.nullif(F.try_element_at("_values", place.cast("int")), F.lit(""))


def _event_id() -> Column:
    return F.trim("_event.System.EventID").try_cast("int")


def security_lines(lines: DataFrame) -> DataFrame:
    """Parse process-creation audit events (one ``<Event>`` per line)."""
    return (
        _xml_events(lines)
        .select(
            "*",
            F.col("_event.System.TimeCreated._SystemTime").alias("system_time"),
            _event_id().alias("EventID"),
            *[_data_item(f).alias(f) for f in SECURITY_FIELDS],
        )
        .drop("_event", "_names", "_values")
    )


def sysmon_lines(lines: DataFrame) -> DataFrame:
    """Parse system-monitor events (one ``<Event>`` per line)."""
    return (
        _xml_events(lines)
        .select(
            "*",
            _event_id().alias("EventID"),
            F.col("_event.System.TimeCreated._SystemTime").alias("TimeCreated"),
            *[_data_item(f).alias(f) for f in SYSMON_FIELDS],
        )
        .drop("_event", "_names", "_values")
    )


PARSERS = {
    "falcon": ndjson_lines,
    "security_4688": security_lines,
    "sysmon": sysmon_lines,
}


def good_rows(parsed: DataFrame) -> DataFrame:
    """Well-formed rows without the raw text."""
    return parsed.where(~F.col("malformed")).drop("value", "malformed")


def process_creation_only(lines: DataFrame) -> DataFrame:
    """Lines that can be a process-creation record, before any parsing.

    A line with a ``\\u`` escape may spell the name differently, so it stays.
    """
    return lines.where(
        F.contains("value", F.lit(PROCESS_CREATION)) | F.contains("value", F.lit("\\u"))
    )


def read_ndjson(
    spark: SparkSession, path: str, *, creation_only: bool = False, encoding: str = "utf-8"
) -> DataFrame:
    lines = spark.read.option("encoding", encoding).text(path)
    if not creation_only:
        return good_rows(ndjson_lines(lines))
    rows = good_rows(ndjson_lines(process_creation_only(lines)))
    return rows.where(F.col("event_simpleName") == PROCESS_CREATION)


def read_security(spark: SparkSession, path: str, *, encoding: str = "utf-8") -> DataFrame:
    return good_rows(security_lines(spark.read.option("encoding", encoding).text(path)))


def read_sysmon(
    spark: SparkSession,
    path: str,
    *,
    event_ids: Iterable[int] | None = None,
    encoding: str = "utf-8",
) -> DataFrame:
    rows = good_rows(sysmon_lines(spark.read.option("encoding", encoding).text(path)))
    if event_ids is None:
        return rows
    return rows.where(F.col("EventID").isin(list(event_ids)))


def malformed_counts(parsed_by_source: dict[str, DataFrame]) -> DataFrame:
    """Lines and malformed lines (blank ones included) per source."""
    counts = None
    for source, parsed in parsed_by_source.items():
        part = parsed.agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if("malformed").alias("malformed"),
        ).select(F.lit(source).alias("source"), "lines", "malformed")
        counts = part if counts is None else counts.unionByName(part)
    return counts


def quarantine(parsed: DataFrame) -> DataFrame:
    """The malformed lines themselves."""
    return parsed.where("malformed").select("value")
