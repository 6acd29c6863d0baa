"""Timestamps as UTC wall-clock TIMESTAMP_NTZ, whatever the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"(?i):.*(z|utc|gmt|[+-]\d{2}:?\d{2})\s*$"
_EPOCH = "1970-01-01 00:00:00"
# Seconds up to the end of the year 9999; a larger epoch is not a time.
_LAST_SECOND = 253402300799


def from_epoch_seconds(seconds: Column) -> Column:
    """DECIMAL or numeric text, in seconds since 1970, as UTC timestamp."""
    exact = seconds.try_cast("decimal(20,6)")
    bounded = F.when(F.abs(exact) <= F.lit(_LAST_SECOND), exact.cast("decimal(18,6)"))
    zero = F.lit(0)
    step = F.make_dt_interval(zero, zero, zero, bounded)
    return F.when(bounded.isNotNull(), F.lit(_EPOCH).cast("timestamp_ntz") + step)


def from_epoch_millis(millis: Column) -> Column:
    exact = millis.try_cast("decimal(24,6)")
    return from_epoch_seconds(exact / F.lit(1000))


def parse_utc(text: Column) -> Column:
    """Timestamp text as UTC: a zone suffix is applied, none means UTC."""
    micros = F.unix_micros(F.try_to_timestamp(text))
    instant = from_epoch_seconds(micros.cast("decimal(26,6)") / F.lit(1000000))
    return F.when(text.rlike(_ZONED), instant).otherwise(text.try_cast("timestamp_ntz"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """``later - earlier`` in seconds as DOUBLE, exact to the microsecond."""
    gap = later - earlier
    days = F.extract(F.lit("DAY"), gap) * 86400
    hours = F.extract(F.lit("HOUR"), gap) * 3600
    minutes = F.extract(F.lit("MINUTE"), gap) * 60
    seconds = F.extract(F.lit("SECOND"), gap)
    return (days + hours + minutes + seconds).cast("double")
