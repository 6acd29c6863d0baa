"""Incremental ingest of log folders with Structured Streaming.

Parsing and normalising are row-local, so batch and stream share them. On a
stream the timestamp fallback is decided per row, because no look at the whole
column is possible. Ids follow from file and line (``streaming.ids``), so the
table can be the source of the alert stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from procsift.session import scratch_scope
from procsift.sources.publish import exists, publish_table
from procsift.sources.rawlogs import PARSERS, good_rows
from procsift.sources.unified import to_unified, union_events, with_places
from procsift.streaming import ids


def stream_source(
    spark: SparkSession, source: str, folder: str, *, max_files: int | None = None, place: int | None = None
) -> DataFrame:
    """New files of one source as unified events; ``max_files`` per batch.
    ``place`` adds where each row came from, under that number of its source."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(folder)
    if place is not None:
        lines = with_places(lines, place)
    return to_unified(good_rows(PARSERS[source](lines)), source, "row")


def stream_events(
    spark: SparkSession, folders: dict[str, str], *, max_files: int | None = None, places: bool = False
) -> DataFrame:
    """All sources in one stream; ``folders`` maps source name to its folder."""
    return union_events(
        [
            stream_source(spark, s, f, max_files=max_files, place=i if places else None)
            for i, (s, f) in enumerate(folders.items())
        ]
    )


def write_batch(batch: DataFrame, batch_id: int, output: str, *, page_bits: int = ids.PAGE_BITS, digest_bits: int = ids.DIGEST_BITS) -> None:
    """One micro-batch of placed events to ``output/batch=<id>``, with ids.

    The ledger's part is published before the rows, both at once each. A batch
    that is run again takes what it published the first time.
    """
    spark, name = batch.sparkSession, f"batch={batch_id}"
    if exists(spark, f"{output}/{name}"):
        return
    with scratch_scope(spark):
        rows = ids.numbered_in_files(batch.withColumn("_at", F.monotonically_increasing_id()))
        pages = rows.select("_source", "_file", F.shiftright("_row", page_bits).alias("_page")).distinct()
        ledger = f"{output}/_ledger"
        placed = ids.place_pages(pages, ids.read_ledger(spark, ledger, batch_id), digest_bits)
        publish_table(placed.coalesce(1), ledger, name)  # a row for each file and million lines
        placed = ids.read_ledger(spark, ledger, batch_id + 1)
        publish_table(ids.with_stream_ids(rows, placed, page_bits), output, name, "source")


def start_ingest(
    spark: SparkSession,
    folders: dict[str, str],
    output: str,
    checkpoint: str,
    *,
    max_files: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append unified events with ids to a Parquet table, each file exactly once.

    Every micro-batch is a folder of its own that appears whole, so a stream
    that reads the table never meets half a batch, nor one twice.
    """
    writer = (
        stream_events(spark, folders, max_files=max_files, places=True)
        .writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, output))
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
