"""Left joins of an event table with a table that has one row per key.

Three plans, picked by measured size, all with the same result:

* the table was measured while it was written and is small: broadcast it, the
  events are not shuffled;
* otherwise the values of the most frequent keys (a fixed number of them) are
  broadcast under a digest of the key, so that their size doesn't depend on how
  long keys are. Events are stored in two parts: those that are served by then,
  or have no key, and the rest. Only the rest, whose keys are rare, meets the
  table in a shuffle join; the others are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsift.session import BROADCAST_BYTES, Stored, store

HOT_KEYS = 10_000


@dataclass(frozen=True)
class LookupLimits:
    """Size limits of the plans; tests lower them to force each plan."""

    broadcast_bytes: int = BROADCAST_BYTES
    hot_keys: int = HOT_KEYS


DEFAULT_LIMITS = LookupLimits()


def _digest(keys: list[str]) -> Column:
    """128 bits that stand for the key columns together; null if one is null."""
    parts = []
    for k in keys:
        text = F.col(k).cast("string")
        parts += [F.octet_length(text).cast("string"), F.lit(":"), text]
    return F.unhex(F.md5(F.concat(*parts)))


def lookup(
    events: DataFrame,
    table: Stored,
    on: dict[str, str],
    values: dict[str, str],
    *,
    weight: str | None = None,
    limits: LookupLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add ``values`` (table column -> new name) to ``events``, null if absent.

    ``on`` maps event column -> table key column. ``weight`` names the table
    column that tells how many events carry the key; without it the key
    frequencies are counted from the events.
    """
    keys = {f"_k{i}": (left, right) for i, (left, right) in enumerate(on.items())}
    wanted = [F.col(right).alias(k) for k, (_, right) in keys.items()]
    wanted += [F.col(name).alias(f"_v_{new}") for name, new in values.items()]
    columns = events.columns
    left = events.select("*", *[F.col(l).alias(k) for k, (l, _) in keys.items()])

    if table.bytes <= limits.broadcast_bytes:
        joined = left.join(F.broadcast(table.df.select(*wanted)), list(keys), "left")
        return joined.select(*columns, *[F.col(f"_v_{n}").alias(n) for n in values.values()])

    if weight is not None:
        ranked = table.df.select(*wanted, F.col(weight).alias("_w"))
    else:
        frequency = left.select(_digest(list(keys)).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_w"))
        top = frequency.where(F.col("_key").isNotNull()).orderBy(F.desc("_w"), "_key").limit(limits.hot_keys)
        keyed = table.df.select(*wanted).withColumn("_key", _digest(list(keys)))
        ranked = keyed.join(F.broadcast(top), "_key").drop("_key")
    hot = (
        ranked.select(_digest(list(keys)).alias("_key"), "_w", *[f"_v_{n}" for n in values.values()])
        .where(F.col("_key").isNotNull())
        .orderBy(F.desc("_w"), "_key")
        .limit(limits.hot_keys)
        .drop("_w")
        .withColumnsRenamed({f"_v_{n}": f"_h_{n}" for n in values.values()})
        .withColumn("_hot", F.lit(1))
    )
    served = left.withColumn("_key", _digest(list(keys))).join(F.broadcast(hot), "_key", "left").drop("_key")

    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    # Written once, in a folder for each kind: the rows of the one are read on
    # without an exchange, only the other kind's meet the table in a shuffle.
    parted = store(served.withColumn("_cold", F.col("_hot").isNull() & has_key), "lookup", parts="_cold").df
    warm = parted.where(~F.col("_cold")).select(
        *columns, *[F.col(f"_h_{n}").alias(n) for n in values.values()]
    )
    cold = parted.where("_cold").join(table.df.select(*wanted), list(keys), "left").select(
        *columns, *[F.col(f"_v_{n}").alias(n) for n in values.values()]
    )
    return warm.unionAll(cold)
