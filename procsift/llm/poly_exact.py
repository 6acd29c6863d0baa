"""Exact dedup by composable polynomial fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsift.llm.common import WHITE, stored, text_of

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525173)
CHUNK_BYTES = 1 << 16
HUGE_BYTES = 1 << 23

_powers: dict[int, list[np.ndarray]] = {}


def _power_tables(size: int) -> list[np.ndarray]:
    """base**0 .. base**(size-1) modulo each prime."""
    if size not in _powers:
        tables = []
        for prime, base in zip(PRIMES, BASES, strict=True):
            powers = np.ones(1, dtype=np.uint64)
            while len(powers) < size:  # doubling: the second half is the first, shifted
                step = np.uint64(pow(base, len(powers), prime))
                powers = np.concatenate([powers, powers * step % np.uint64(prime)])
            tables.append(powers[:size].copy())
        _powers[size] = tables
    return _powers[size]


def chunk_fingerprint(chunk: bytes, size: int = CHUNK_BYTES) -> tuple[int, int]:
    """sum(byte[j] * base**j) modulo each prime."""
    values = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64)
    return tuple(
        int(np.dot(values, powers[: len(values)]) % np.uint64(prime))
        for powers, prime in zip(_power_tables(size), PRIMES, strict=True)
    )


def shifted(print_: int, by: int, which: int) -> int:
    """The share of a chunk that starts ``by`` bytes into its document."""
    return print_ * pow(BASES[which], by, PRIMES[which]) % PRIMES[which]


def _chunk_rows(docs: DataFrame, chunk: int) -> DataFrame:
    """A row for each chunk of the text without white space."""
    bare = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.char_length("text").cast("bigint").alias("n_points"),
        F.translate("text", WHITE, "").cast("binary").alias("bare"),
    )
    cut = F.expr(
        f"transform(sequence(0, greatest(0, (octet_length(bare) - 1) div {chunk})), "
        f"i -> substring(bare, cast(i * {chunk} + 1 as int), {chunk}))"
    )
    # The digest is the same for all chunks and is carried by the first.
    return bare.select(
        "doc_id", "row", "n_points", F.sha2("bare", 256).alias("sha"), F.posexplode(cut).alias("at", "chunk")
    ).withColumn("sha", F.when(F.col("at") == 0, F.col("sha")))


def document_fingerprints(
    docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES
) -> DataFrame:
    """(doc_id, n_points, sha, n_bytes, h1, h2) of every row.

    Chunks are hashed apart from each other; a document's fingerprint is the
    sum of its chunks' hashes, each shifted by its offset, so partial sums
    combine in any order. Chunks of documents over ``huge`` bytes are dealt out
    to all tasks first. How a text is cut does not change its fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, chunks = batch.column("at").to_pylist(), batch.column("chunk")
            shares: list[list[int]] = [[], []]
            for i, place in enumerate(at):
                for which, value in enumerate(chunk_fingerprint(chunks[i].as_py(), chunk)):
                    shares[which].append(shifted(value, place * chunk, which))
            sizes = [len(x.as_py()) for x in chunks]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "row", "n_points", "sha")]
                + [pa.array(x, pa.int64()) for x in (sizes, *shares)],
                names=["doc_id", "row", "n_points", "sha", "n", "s1", "s2"],
            )

    base = docs.select(F.col("doc_id").cast("bigint"), text_of(docs).alias("text"))
    large = F.octet_length("text") > huge
    schema = "doc_id bigint, row bigint, n_points bigint, sha string, n bigint, s1 bigint, s2 bigint"
    usual = _chunk_rows(base.where(~large), chunk).mapInArrow(run, schema)
    spread = _chunk_rows(base.where(large), chunk).repartition("row", "at").mapInArrow(run, schema)
    parts = usual.withColumn("huge", F.lit(False)).unionAll(spread.withColumn("huge", F.lit(True)))
    return (
        parts.groupBy("huge", "row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_points").alias("n_points"),
            F.max("sha").alias("sha"),
            F.sum("n").alias("n_bytes"),
            (F.sum("s1") % PRIMES[0]).alias("h1"),
            (F.sum("s2") % PRIMES[1]).alias("h2"),
        )
        .drop("huge", "row")
    )


_KEY = ["n_bytes", "h1", "h2"]


def _differing(docs: DataFrame, prints: DataFrame, repeated: DataFrame, chunk: int) -> DataFrame:
    """The fingerprints of ``repeated`` whose texts aren't all equal.

    Chunk by chunk, all texts of a group are equal if the smallest and the
    largest chunk are. Tasks combine that before the shuffle, so a group of a
    third of all rows is no hot spot, and no pair of texts is ever formed.
    """
    members = prints.join(repeated, _KEY).select("doc_id", *_KEY).distinct()
    base = docs.select(F.col("doc_id").cast("bigint"), text_of(docs).alias("text"))
    texts = base.join(members, base["doc_id"].eqNullSafe(members["doc_id"])).select(
        members["doc_id"], "text", *_KEY
    )
    chunks = _chunk_rows_with(texts, chunk)
    return (
        chunks.groupBy(*_KEY, "at")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .where("low <> high")
        .select(*_KEY)
        .distinct()
    )


def _chunk_rows_with(texts: DataFrame, chunk: int) -> DataFrame:
    """Chunks of texts of the group's own length; a doc_id's other rows go."""
    bare = texts.select(*_KEY, F.translate("text", WHITE, "").cast("binary").alias("bare")).where(
        F.octet_length("bare") == F.col("n_bytes")
    )
    cut = F.expr(
        f"transform(sequence(0, greatest(0, (octet_length(bare) - 1) div {chunk})), "
        f"i -> substring(bare, cast(i * {chunk} + 1 as int), {chunk}))"
    )
    return bare.select(*_KEY, F.posexplode(cut).alias("at", "chunk"))


def exact_duplicates(
    docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal if they are after deleting white space. Of equal texts the
    row with the most code points, then the smallest doc_id, stays. Groups of
    equal fingerprints are compared chunk by chunk; one whose texts differ is
    split by the texts' digests.

    Null text is empty text. A row that repeats a doc_id counts in group_size,
    and repeats of the row that stays are kept with it. A null doc_id sorts last.
    """
    prints = stored(document_fingerprints(docs, chunk, huge), "poly")
    repeated = prints.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEY)
    mixed = stored(_differing(docs, prints, repeated, chunk), "mixed")
    mixed = mixed.withColumn("split", F.lit(True))
    classed = prints.join(mixed, _KEY, "left").withColumn(
        "part", F.when(F.col("split"), F.col("sha")).otherwise(F.lit(""))
    )
    key = [*_KEY, "part"]
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = classed.groupBy(*key).agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    joined = classed.join(groups, key)
    keep = F.col("first.doc_id")
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
