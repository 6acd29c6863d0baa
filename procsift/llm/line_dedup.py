"""Line dedup: lines that many documents share stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsift.llm.common import WHITE, ascii_lower, fresh, stored, text_of

MIN_CHARS = 20
MIN_DOCS = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, key): the long lines with a 128-bit key of their
    stripped, lower-case form. ``row`` tells rows of one doc_id apart."""
    lines = docs.select("doc_id", "row", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    bare = F.trim(F.col("line"), F.lit(WHITE))
    lines = lines.select("doc_id", "row", "pos", bare.alias("line"))
    return lines.where(F.char_length("line") >= min_chars).select(
        "doc_id", "row", "pos", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("key")
    )


def drop_shared_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Every row of ``docs`` with its text cut down to the lines that stay.

    A line's key is the line stripped of white space and in ASCII lower case.
    Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose all their lines, except in the document with the largest
    doc_id. Adds ``n_lines`` and ``n_dropped``; all other columns stay.

    Lines are exploded, hashed (128 bits) and counted in two steps, first by
    key and document, then by key, so that a line of a third of all documents
    is counted by all tasks. The join of lines with the shared keys has no
    state above it, so Spark can split a hot key. Reassembly is by position.

    Null or empty text is one empty line. Rows that repeat a doc_id count as
    one document and are all rewritten. A null doc_id is a document of its own
    that never wins against another. An empty table stays empty.
    """
    base = docs.select("doc_id", text_of(docs).alias("text")).withColumn(
        "row", F.xxhash64("text")
    )
    keyed = _keyed_lines(base, min_chars)
    shared = stored(
        keyed.groupBy("key", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("key", "keeper"),
        "shared-lines",
    )
    names = {n: fresh(docs, f"_{n}") for n in ("doc", "row", "gone", "hash")}
    dropped = (
        keyed.join(shared, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "row")
        .agg(F.collect_set("pos").alias(names["gone"]))
        .withColumnsRenamed({"doc_id": names["doc"], "row": names["row"]})
    )
    rows = docs.select(
        *[docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.xxhash64(text_of(docs)).alias(names["hash"]),
    )
    joined = rows.join(
        dropped,
        rows["doc_id"].eqNullSafe(dropped[names["doc"]]) & (rows[names["hash"]] == dropped[names["row"]]),
        "left",
    )
    text, gone = F.coalesce(F.col("text"), F.lit("")), F.col(names["gone"])
    lines = _lines(text)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(gone.isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    out = [kept.alias(c) if c == "text" else F.col(c) for c in rows.columns if c != names["hash"]]
    return joined.select(
        *out,
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
