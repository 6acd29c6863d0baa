"""The driver's ``events`` table as process events, and as raw log lines.

Integer arithmetic and literals only, so any SQL engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sample images and commands of the view.
IMAGES = [
    "C:/Windows/System32/cmd.exe",
    "C:/Windows/System32/WindowsPowerShell/v1.0/powershell.exe",
    "C:/Windows/System32/svchost.exe",
    "C:/Windows/explorer.exe",
    "C:/Windows/System32/services.exe",
    "C:/Windows/System32/conhost.exe",
    "C:/Windows/System32/lsass.exe",
    "C:/Tools/procdump.exe",
    "C:/Windows/System32/rundll32.exe",
    "C:/Windows/System32/certutil.exe",
    "C:/Program Files/App/app.exe",
    "C:\\Windows\\System32\\cmd.exe",
    "C:/Windows/System32/vssadmin.exe",
    "C:/Windows/System32/ntdsutil.exe",
    "notepad.exe",
    "C:/Temp/",
]
COMMANDS = [
    "cmd.exe /c whoami",
    "powershell -nop -w hidden -enc SQBFAFgA",
    "svchost.exe -k netsvcs",
    "notepad.exe readme.txt",
    "certutil -urlcache -f http://x/y",
    "procdump -ma lsass.exe out.dmp",
    "vssadmin create shadow /for=C:",
    "app.exe --run --fast --verbose --retry 3",
    "powershell -NoProfile -EncodedCommand AAAA",
    "a a a a",
    "",
    "explorer.exe",
]
EVENT_TYPES = {
    "view": ("1", "sysmon"),
    "click": ("4688", "security_4688"),
    "purchase": ("ProcessRollup2", "falcon"),
    "error": ("10", "sysmon"),
    "signup": ("8", "sysmon"),
}
LSASS_PATH = "C:/Windows/System32/lsass.exe"
NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _by_type(place: int) -> Column:
    chosen = F
    for kind, names in EVENT_TYPES.items():
        chosen = chosen.when(F.col("event_type") == kind, F.lit(names[place]))
    return chosen


def process_view(events: DataFrame) -> DataFrame:
    """One projection of ``events``: process fields plus the raw ``value``."""
    eid, uid = F.col("event_id"), F.col("user_id")
    suffix = F.when(uid % 2 == 0, F.concat(F.lit(" "), F.col("props"))).otherwise(F.lit(""))
    command = F.concat(_pick(COMMANDS, (eid * 5 + uid * 11) % 12), suffix)
    access = F.col("event_type").isin("error", "signup") & (uid % 5 == 0)
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        _by_type(0).alias("event_type"),
        _by_type(1).alias("source"),
        F.when(eid % 41 != 0, _pick(IMAGES, (eid * 7 + uid) % 16)).alias("process_image"),
        F.when(eid % 37 != 0, _pick(IMAGES, ((eid % 11) * (uid % 4) + 2) % 16)).alias(
            "parent_image"
        ),
        F.when(eid % 29 == 0, F.lit(None).cast("string"))
        .when(eid % 53 == 0, F.concat(F.lit("cmd.exe /c "), F.repeat(F.lit("A"), 600)))
        .otherwise(command)
        .alias("command_line"),
        (eid % 997 + 4).alias("pid"),
        F.when(eid % 43 != 0, ((eid % 997) * 7 + uid) % 1409 + 4).alias("ppid"),
        F.when(access, F.lit(LSASS_PATH)).alias("target_image"),
        F.lit(None).cast("bigint").alias("target_pid"),
        "value",
    )


def process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over the driver's table."""
    return process_view(spark.read.parquet(f"{sf_dir}/events.parquet"))


# --- raw lines, written from the view -----------------------------------------


def _micros(ts: Column) -> Column:
    """Microseconds since 1970 of a UTC wall-clock timestamp."""
    gap = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days, hours = F.extract(F.lit("DAY"), gap), F.extract(F.lit("HOUR"), gap)
    minutes, seconds = F.extract(F.lit("MINUTE"), gap), F.extract(F.lit("SECOND"), gap)
    whole = (days * 24 + hours) * 60 + minutes
    return whole.cast("bigint") * 60_000_000 + (seconds * 1_000_000).cast("bigint")


def _xml_text(text: Column) -> Column:
    escaped = F.replace(text, F.lit("&"), F.lit("&amp;"))
    escaped = F.replace(escaped, F.lit("<"), F.lit("&lt;"))
    return F.replace(escaped, F.lit(">"), F.lit("&gt;"))


def _data(name: str, text: Column) -> Column:
    item = F.concat(F.lit(f'<Data Name="{name}">'), _xml_text(text), F.lit("</Data>"))
    return F.coalesce(item, F.lit(""))


def _event_xml(event_id: Column, created: Column, items: list[Column]) -> Column:
    return F.concat(
        F.lit(f'<Event xmlns="{NAMESPACE}"><System><EventID>'),
        event_id,
        F.lit('</EventID><TimeCreated SystemTime="'),
        created,
        F.lit('"/></System><EventData>'),
        *items,
        F.lit("</EventData></Event>"),
    )


def _hex(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(number)))


def _utc_text(ts: Column) -> Column:
    return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def ndjson_text(view: DataFrame, *, second_time: bool = False) -> DataFrame:
    """JSON lines of the first source; every 97th event id adds a bad line.
    With ``second_time`` they have the milliseconds in place of the seconds."""
    rows = view.where(F.col("source") == "falcon")
    millis = (_micros(F.col("timestamp")) / 1000).cast("bigint").cast("string")
    seconds = (_micros(F.col("timestamp")).cast("decimal(24,6)") / 1_000_000).cast("decimal(20,6)")
    record = F.to_json(
        F.struct(
            F.col("event_type").alias("event_simpleName"),
            millis.alias("timestamp") if second_time else seconds.cast("string").alias("ProcessStartTime"),
            F.col("process_image").alias("ImageFileName"),
            F.col("parent_image").alias("ParentBaseFileName"),
            F.col("command_line").alias("CommandLine"),
            F.col("pid").cast("string").alias("RawProcessId"),
            F.col("ppid").alias("ParentProcessId"),
        )
    )
    return _with_bad_lines(rows, record, ["", "{broken", "[1]", '{"a": 1} extra'])


def security_text(view: DataFrame) -> DataFrame:
    rows = view.where(F.col("source") == "security_4688")
    line = _event_xml(
        F.lit("4688"),
        _utc_text(F.col("timestamp")),
        [
            _data("NewProcessId", _hex(F.col("pid"))),
            _data("NewProcessName", F.col("process_image")),
            _data("ProcessId", _hex(F.col("ppid"))),
            _data("CommandLine", F.col("command_line")),
            _data("ParentProcessName", F.col("parent_image")),
        ],
    )
    return _with_bad_lines(rows, line, ["", "<bad", "<Event></Evt>", "   "])


def sysmon_text(view: DataFrame, *, second_time: bool = False) -> DataFrame:
    """Event lines of the third source; with ``second_time`` without the item
    that has the time, so that only the record's creation time is left."""
    rows = view.where(F.col("source") == "sysmon")
    create = F.col("event_type") == "1"

    def when_create(name: str, other: str, text: Column) -> Column:
        return F.when(create, _data(name, text)).otherwise(_data(other, text))

    line = _event_xml(
        F.col("event_type"),
        _utc_text(F.col("timestamp")),
        [
            F.lit("") if second_time else _data("UtcTime", F.col("timestamp").cast("string")),
            _data("ParentImage", F.lit("overridden by the later item")),
            _data("ParentImage", F.coalesce(F.col("parent_image"), F.lit(""))),
            when_create("Image", "SourceImage", F.col("process_image")),
            when_create("ProcessId", "SourceProcessId", F.col("pid").cast("string")),
            _data("ParentProcessId", F.col("ppid").cast("string")),
            _data("CommandLine", F.col("command_line")),
            _data("TargetImage", F.col("target_image")),
        ],
    )
    return _with_bad_lines(rows, line, ["", "<bad", "<Event><System>", "no xml"])


def _with_bad_lines(rows: DataFrame, line: Column, bad: list[str]) -> DataFrame:
    """A bad line goes before the line of every event id divisible by 97."""
    extra = F.when(F.col("event_id") % 97 == 0, _pick(bad, (F.col("event_id") / 97).cast("bigint") % 4))
    return rows.select(
        F.explode(F.array_compact(F.array(extra, line))).alias("value")
    )


RAW_TEXT = {"falcon": ndjson_text, "security_4688": security_text, "sysmon": sysmon_text}
