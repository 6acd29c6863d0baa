"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsift.llm.common import components, fresh, sieve, stored, text_of

SHINGLE_WORDS = 3
RADIUS = 2
SEGMENTS = 2
BUCKET_LIMIT = 64
_BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """The 64-bit SimHash of one UTF-8 text, as a signed number.

    ASCII lower case, words between ASCII white space, ``words``-word shingles
    with repeats. A bit is set if over half of the shingle hashes have it. No
    word: zero. Memory is one number per shingle of a block.
    """
    parts = text.lower().split()  # of bytes: ASCII case and white space only
    if not parts:
        return 0
    last = max(1, len(parts) - words + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, last, _BLOCK):
        hashes = np.array(
            [digest(join(parts[i : i + words]), seed) for i in range(start, min(last, start + _BLOCK))],
            dtype=">u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(texts[i].as_py(), words) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select(
        F.col("doc_id").cast("bigint"), text_of(docs).cast("binary").alias("text")
    ).mapInArrow(run, "doc_id bigint, fp bigint")


def _masks(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` ones."""
    return [
        sum(1 << i for i in at) for k in range(radius + 1) for at in combinations(range(width), k)
    ]


def _segments(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment.

    Two fingerprints within ``radius`` bits differ by at most the segment's
    own radius in at least one segment, as the radii sum up to
    radius - segments + 1 (else every segment would exceed its radius by one,
    and the whole its own). Segments whose radius would be negative are left out.
    """
    total, out, shift = radius - segments + 1, [], 0
    for i in range(segments):
        width = 64 * (i + 1) // segments - shift
        own = (total + segments - 1 - i) // segments if total >= 0 else (0 if i <= radius else -1)
        out.append((shift, width, own))
        shift += width
    return [x for x in out if x[2] >= 0]


def _ball(part: int, value: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(mask).alias("value"))


def links(
    prints: DataFrame,
    radius: int = RADIUS,
    segments: int = SEGMENTS,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``prints``
    (one column ``fp``, distinct) at ``radius`` or fewer differing bits.

    Each fingerprint is entered in one table per segment. Each also probes the
    tables with all values within its segment's small radius; what it meets is
    verified over the whole 64 bits.

    A bucket of more than ``bucket_limit`` fingerprints isn't paired up. Those
    that are in it or probe it are linked over centres instead: two
    fingerprints are within the radius exactly if some 64-bit value is within
    half of it from both. A centre has no more neighbours than its ball has
    values (65 at radius 2), so this is exact and bounded for any group.
    """
    prints = prints.select("fp")
    parts = _segments(segments, radius)
    entries, probes = [], []
    for i, (shift, width, own) in enumerate(parts):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        entries.append(F.struct(F.lit(i).alias("part"), value.alias("value")))
        masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(width, own)])
        probes.append(F.transform(masks, _ball(i, value)))
    entry = prints.select("fp", F.explode(F.array(*entries)).alias("k")).select("k.part", "k.value", "fp")
    probe = prints.select("fp", F.explode(F.flatten(F.array(*probes))).alias("k")).select(
        "k.part", "k.value", F.col("fp").alias("other")
    )
    sizes = entry.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    crowded = stored(sizes.where(F.col("n") > bucket_limit).select("part", "value"), "crowded")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    # Spark sizes both sides as the table they are exploded from, and would broadcast
    # the probes, 34 of each fingerprint, where that table fits.
    cold = (
        entry.join(crowded, ["part", "value"], "left_anti")
        .join(probe.hint("merge"), ["part", "value"])
        .where((F.col("other") > F.col("fp")) & near)
        .select(F.col("other").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )
    members = probe.join(crowded, ["part", "value"], "left_semi").select(F.col("other").alias("fp")).distinct()
    inner, outer = radius // 2, (radius + 1) // 2
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in _masks(64, outer)])
    centres = members.select("fp", F.explode(masks).alias("m")).select(
        F.col("fp").bitwiseXOR(F.col("m")).alias("centre"),
        "fp",
        F.when(F.bit_count("m") <= inner, F.col("fp")).alias("close"),
    )
    balls = centres.groupBy("centre").agg(
        F.min("close").alias("b"), F.collect_set("fp").alias("all"), F.count(F.lit(1)).alias("n")
    )
    hot = (
        balls.where("n > 1 and b is not null")
        .select(F.explode("all").alias("a"), "b")
        .where("a <> b")
        .distinct()
    )
    return cold.unionAll(hot)


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    segments: int = SEGMENTS,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprints at ``radius`` or
    fewer differing bits are linked, component_id is the smallest doc_id that
    is reachable.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows that repeat a doc_id keep one result each; with different texts they
    link the classes of those texts only by fingerprint. Null doc_ids are
    ignored as component ids, and a component of null ids has a null id.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    owners = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("owner")), "owners")
    roots = components(links(owners.select("fp"), radius, segments, bucket_limit), "simhash")
    named = (
        owners.join(roots, owners["fp"] == roots["node"], "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "owner")
    )
    smallest = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    classes = stored(named.join(smallest, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their class, with all
    their columns. Of rows that repeat a doc_id the least one stays; rows
    without a doc_id all stay."""
    return smallest_of_each(docs, near_duplicates(docs, **options))


def smallest_of_each(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """What one_of_each gives, by the ``classes`` (doc_id, component_id) of the rows."""
    found = stored(classes, "near-copy-classes")
    away = fresh(docs, "_away")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    repeated = stored(
        found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("doc_id"),
        "repeated-ids",
    )
    apart = stored(gone.unionAll(repeated).distinct().withColumnRenamed("doc_id", away), "away-ids")
    # Rows that surely stay don't go through the join.
    likely, surely = sieve(apart, away).parted(docs, "doc_id")
    single = likely.join(apart, F.col("doc_id") == F.col(away), "left_anti").unionAll(surely)
    if repeated.isEmpty():
        return single
    again = repeated.join(gone, "doc_id", "left_anti").withColumnRenamed("doc_id", away)
    several = (
        likely.join(again, F.col("doc_id") == F.col(away), "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct(*docs.columns)).alias("row"))
        .select("row.*")
    )
    return single.unionAll(several)
