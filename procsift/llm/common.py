"""What several operators share: null-safe text, ASCII case, scratch tables, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsift.session import scratch_path

#: The white space of every contract here: space, tab, \n, \v, \f, \r.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(docs[column], F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(column, UPPER, LOWER)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared scratch folder and read back: cuts the lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that a task in Python has in hand at a time.
SLICE_ROWS = 128


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, without copies: a batch of Spark's has up
    to 10,000 texts, and what a step makes of all of them would be held at once,
    by the worker and, as one batch of results, by the executor."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


_UNIT = 1 << 52


def hash_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, those of the smallest hash of the keys: the same
    on any layout. A large table is thinned by that hash first, to twice as
    many rows as are wanted, so that what meets in one task is bounded."""
    n = df.count()
    place = F.pmod(F.xxhash64(*keys, F.lit(3)), F.lit(_UNIT))
    if n > 2 * most:
        df = df.where(place < F.lit(_UNIT * 2 * most // n))
    return df.orderBy(place, *keys).limit(most)


#: Bits of the largest sieve, 16 MB in all, and of one of its blocks.
MOST_SLOTS, BLOCK_SLOTS = 1 << 27, 1 << 15


@dataclass(frozen=True)
class Sieve:
    """A bitmap of hashed ids in blocks of 4 KB: every id that went in passes,
    and of others about one in seventeen, more where MOST_SLOTS are too few."""

    blocks: DataFrame
    slots: int

    def parted(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """The rows of ``df`` that pass by the id in ``column``, and the others."""
        block, bits, tested = (fresh(df, name) for name in ("_block", "_bits", "_passed"))
        slot = _slot(F.col(column), self.slots)
        position = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(F.col(bits), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        passed = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
        blocks = self.blocks.select(F.col("block").alias(block), F.col("bits").alias(bits))
        rows = df.join(F.broadcast(blocks), F.bitmap_bucket_number(slot) == F.col(block), "left").select(
            *[df[c] for c in df.columns], passed.alias(tested)
        )
        return rows.where(tested).drop(tested), rows.where(~F.col(tested)).drop(tested)


def _slot(column: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(column.cast("bigint"), F.lit(11)), F.lit(slots)) + 1


def sieve(ids: DataFrame, column: str) -> Sieve:
    """A sieve of the ids in ``column``, which are read twice: it keeps rows that
    surely match none out of a join, and so out of its shuffle."""
    blocks = -(-16 * ids.count() // BLOCK_SLOTS)
    slots = min(MOST_SLOTS, BLOCK_SLOTS * max(1, blocks))
    slot = _slot(F.col(column), slots)
    found = ids.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    return Sieve(stored(found, "sieve"), slots)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@dataclass(frozen=True)
class _Mark:
    rows: int
    digest: int


def _mark(edges: DataFrame) -> _Mark:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest"),
    ).first()
    return _Mark(int(row["n"]), int(row["digest"] or 0))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected links (a, b) of bigint nodes.

    Returns (node, root), root being the smallest node of the component, for
    every node that has a link. Alternating large-star and small-star steps:
    the number of rounds grows with the logarithm of the graph, every round
    writes one table of links, and nothing but two numbers reaches the driver.
    Self links are ignored.
    """
    current = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    mark = _mark(current)
    while True:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(smallest, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        large = stored(large, label)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        current = stored(small, label)
        then, mark = mark, _mark(current)
        if then == mark:
            break
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
