"""CSV files whose quoted values hold line breaks, read in splits.

Whether a split begins inside a quoted value follows from the number of quotes
before it: they are counted for each split, and a running sum over the splits
tells every task the state in which it starts. Records that end in another
split are put together from their fragments, at most two for each split that
is not inside of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procsift.session import BROADCAST_BYTES, Stored, store

_BATCH = 5_000
# A record whose quotes all stand at the ends of values, or doubled inside.
_VALUE = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
REGULAR = rf"\A{_VALUE}(?:,{_VALUE})*+\z"


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"')))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines by split; a carriage return stays at the end of its line."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _states(lines: DataFrame) -> Stored:
    """(file, block, inside): whether a split begins inside a quoted value."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").agg(F.sum(_quotes(F.col("value"))).alias("quotes"))
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    return store(counts.select("file", "block", inside.alias("inside")), "csv-states")


_PIECES = "file string, block bigint, at bigint, kind string, text string"


def _pieces(lines: DataFrame, states: Stored) -> DataFrame:
    """(file, block, at, kind, text): whole records, and the head, tail or
    middle that a split has of a record that goes on elsewhere; ``at`` counts
    them within their split."""
    if states.bytes > BROADCAST_BYTES:  # a join that moves rows would lose their order
        raise ValueError("too many splits for their states to be sent to every task")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[str, int] | None = None
        inside, started, held, at = False, True, [], 0
        out: list[tuple[str, int, int, str, str]] = []

        def rest() -> None:
            """What is open at the end of a split."""
            if held:
                out.append((*place, at, "tail" if started else "middle", "\n".join(held)))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["file", "block", "at", "kind", "text"]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )
            out.clear()
            return batch

        for batch in batches:
            for file, block, begins_inside, value, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != place:
                    rest()
                    place, inside, started, held, at = (file, block), begins_inside, not begins_inside, [], 0
                inside ^= odd
                if not held and not inside and started:
                    out.append((file, block, at, "record", value))
                    at += 1
                else:
                    held.append(value)
                    if not inside:
                        out.append((file, block, at, "record" if started else "head", "\n".join(held)))
                        started, held, at = True, [], at + 1
                if len(out) >= _BATCH:
                    yield rows()
        rest()
        yield rows()

    odd = (_quotes(F.col("value")) % 2 == 1).alias("odd")
    placed = lines.join(F.broadcast(states.df), ["file", "block"])
    return placed.select("file", "block", "inside", "value", odd).mapInArrow(cut, _PIECES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text) of every record by where it begins, the header's
    included; blank ones are left out."""
    lines = _lines(spark, path)
    pieces = store(_pieces(lines, _states(lines)), "csv-pieces").df
    begun = F.last(F.when(F.col("kind") == "tail", F.col("block")), ignorenulls=True)
    up_to_here = Window.partitionBy("file").orderBy("block", F.col("kind") == "tail")
    # A head closes what an earlier split began; a tail begins, after the head of its split.
    own = up_to_here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fragments = pieces.where("kind <> 'record'").withColumn("first", begun.over(own))
    joined = fragments.groupBy("file", F.col("first").alias("block")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == "tail").alias("t"), "text"))), lambda p: p["text"]),
            "\n",
        ).alias("text"),
        F.max(F.when(F.col("kind") == "tail", F.col("at"))).alias("at"),
    )
    whole = pieces.where("kind = 'record'").select("file", "block", "at", "text")
    return whole.unionAll(joined.select("file", "block", "at", "text")).where(F.trim(F.replace("text", F.lit("\r"))) != "")


def read_broken_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of a CSV file or folder with headers, every column as text.

    None where the split states can't be told from quotes alone: a quote within
    an unquoted value, a carriage return within a line that is not the end of
    one, or files of different headers. Such files must be read whole.
    """
    found = store(records(spark, path), "csv-records").df
    text = F.rtrim(F.col("text"), F.lit("\r"))
    odd = ~F.rlike(text, F.lit(REGULAR)) | F.rlike(F.col("text"), F.lit(r"\r(?!\n|\z)"))
    heads = found.where("block = 0").groupBy("file").agg(F.min_by(F.struct("at", "text"), "at").alias("h"))
    heads = store(heads.select("file", "h.*"), "csv-heads").df
    names = [r["text"].rstrip("\r") for r in heads.select("text").distinct().limit(2).collect()]
    if len(names) != 1 or not found.where(odd).isEmpty():
        return None
    columns = spark.read.csv(spark.sparkContext.parallelize(names, 1), header=True, escape='"').columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    ends = heads.select(F.col("file").alias("_file"), F.col("at").alias("_head"), F.endswith("text", F.lit("\r")).alias("_crlf"))
    body = found.join(F.broadcast(ends), F.col("file") == F.col("_file")).where("block > 0 or at <> _head")
    # Inside values a line break is one character, as in a file that is read whole.
    value = F.when(F.col("_crlf"), F.replace(text, F.lit("\r\n"), F.lit("\n"))).otherwise(text)
    parsed = F.from_csv(value, schema, {"escape": '"', "maxCharsPerColumn": "-1"})
    return body.select(F.explode(F.array(parsed)).alias("row")).select("row.*")

