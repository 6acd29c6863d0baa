"""Process-id parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to fifteen hex digits always fit a signed 64-bit value, sixteen only with
# a leading digit of at most 7. ``conv`` fails on overflow, hence the guard.
_HEX = r"^0[xX]0*([1-7][0-9a-fA-F]{15}|[0-9a-fA-F]{1,15})$"


def numeric_id(value: Column) -> Column:
    """Number or numeric text as BIGINT, anything else as null.

    ``100``, ``"100"``, ``" 100 "`` and ``"100.0"`` give 100.
    """
    text = value.cast("string")
    exact = text.try_cast("bigint")
    wide = text.try_cast("decimal(38,6)")
    whole = F.when(wide == F.floor(wide), wide).try_cast("bigint")
    return F.coalesce(exact, whole)


def hex_id(value: Column) -> Column:
    """``0x..`` text as hexadecimal, other text as decimal, bad text as null."""
    text = F.trim(value.cast("string"))
    digits = F.when(text.rlike(_HEX), F.regexp_extract(text, _HEX, 1))
    return F.coalesce(
        F.conv(digits, 16, 10).cast("bigint"), text.try_cast("bigint")
    )
