"""Event ids on a stream of files: the same in any micro-batch, split and replay.

A file is read whole within one micro-batch, so a row's number within its file
follows from the counts of the file's splits. Rows are taken in pages of 2**20;
an id is 43 bits of a digest of file and page, and the row's place in the page.
No state is needed for that. What a digest can't promise, that no two pages
meet, a ledger of pages (a row for each) checks: of two that meet, the later
one takes the next digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procsift.session import BROADCAST_BYTES, store
from procsift.sources.publish import names_in

PAGE_BITS, DIGEST_BITS = 20, 43

_PAGE = ["_source", "_file", "_page"]
LEDGER = "_source int, _file string, _page bigint, salt int, digest bigint"


def page_digest(salt: Column, bits: int = DIGEST_BITS) -> Column:
    """``bits`` bits for a file's page."""
    return F.shiftrightunsigned(F.xxhash64("_source", "_file", "_page", salt), 64 - bits)


def numbered_in_files(events: DataFrame) -> DataFrame:
    """Rows of whole files with ``_row``, their number within the file.

    ``events`` has the place columns and ``_at``, which rises within a split.
    """
    rows = store(events, "stream-rows").df
    split = ["_source", "_file", "_block"]
    before = (
        Window.partitionBy("_source", "_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = store(
        rows.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
        .select(*split, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")),
        "stream-splits",
    )
    table = F.broadcast(starts.df) if starts.bytes <= BROADCAST_BYTES else starts.df
    return rows.join(table, split).withColumn("_row", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_block")


def read_ledger(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """The pages of the batches before a given one."""
    names = [n for n in names_in(spark, folder) if n.startswith("batch=") and int(n[6:]) < before]
    schema = T.StructType.fromDDL(LEDGER)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in names])


def place_pages(pages: DataFrame, ledger: DataFrame, bits: int = DIGEST_BITS) -> DataFrame:
    """The ledger's rows for new ``pages``: each with a digest that no other page has.

    Usually one round. A page whose digest an earlier page has, or one before
    it among the new ones, takes the digest of the next salt.
    """
    waiting, done = pages.select(*_PAGE).withColumn("salt", F.lit(0)), None
    while True:
        tried = waiting.withColumn("digest", page_digest(F.col("salt"), bits))
        taken = ledger.select("digest") if done is None else ledger.select("digest").unionAll(done.select("digest"))
        first = F.row_number().over(Window.partitionBy("digest").orderBy(*_PAGE)) == 1
        tried = store(
            tried.withColumn("_first", first)
            .join(taken.distinct().withColumn("_taken", F.lit(True)), "digest", "left")
            .withColumn("_free", F.col("_first") & F.col("_taken").isNull()),
            "stream-pages",
        ).df
        won = tried.where("_free").select(*_PAGE, "salt", "digest")
        done = won if done is None else done.unionAll(won)
        lost = tried.where(~F.col("_free"))
        if lost.isEmpty():
            return done
        waiting = lost.select(*_PAGE, (F.col("salt") + 1).alias("salt"))


def with_stream_ids(rows: DataFrame, placed: DataFrame, page_bits: int = PAGE_BITS) -> DataFrame:
    """``event_id`` in front, in the place of the place columns."""
    event_id = F.shiftleft("digest", page_bits) + F.col("_row").bitwiseAND(F.lit((1 << page_bits) - 1))
    kept = [c for c in rows.columns if c not in ("_source", "_file", "_row")]
    return (
        rows.withColumn("_page", F.shiftright("_row", page_bits))
        .join(placed.select(*_PAGE, "digest"), _PAGE)
        .select(event_id.alias("event_id"), *kept)
    )
