"""Near copies: min-hash bands propose pairs, their five-word shingles decide; fingerprints add theirs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsift.llm import simhash_index
from procsift.llm.common import components, sieve, slices, stored, text_of

SHINGLE_WORDS = 5
#: Texts are near copies from this many hundredths of their shingles in common on.
SIMILARITY = 80
#: A pair is met if all ROWS minima of one of the BANDS agree: all but one in 56,000
#: pairs at 0.8 are, and more the more alike they are.
BANDS, ROWS = 36, 6
#: Up to so many nodes of a bucket are compared each with each.
BUCKET_LIMIT = 16
#: How many nodes of its larger buckets a node is compared with, first and then.
LEADERS = (8, 64)
#: Bits of a bitmap of shingles, which tells most pairs apart without their sets.
BITS = 1 << 10
_BLOCK = 1 << 8

_draw = np.random.default_rng(17)
_FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, in ASCII lower case and with
    words between ASCII white space. A shorter text is one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    last = max(1, len(parts) - words + 1)
    return np.unique(np.fromiter((digest(join(parts[i : i + words])) for i in range(last)), np.uint64, last))


def bands(found: np.ndarray) -> list[int]:
    """One signed number for each band of a set of shingles; an empty set has none."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(found), _BLOCK):
        mixed = found[start : start + _BLOCK, None] * _FACTORS + _OFFSETS
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def _node(found: np.ndarray) -> int:
    """Names a set of shingles; texts of equal sets are one node."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes())], dtype=np.uint64).view(np.int64)[0])


def bitmap(found: np.ndarray) -> np.ndarray:
    """BITS bits as signed numbers, one set for each shingle at least; where two
    bitmaps differ, so do the sets, in as many shingles or more."""
    bits = np.zeros(BITS, dtype=bool)
    bits[(found % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _signatures(docs: DataFrame, fingerprints: bool = False) -> DataFrame:
    """(doc_id, node, size, keys) of every row, and its fingerprint ``fp`` if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [text.as_py() for text in batch.column(1)]
            found = [shingles(text) for text in texts]
            columns = {
                "doc_id": batch.column(0),
                "node": pa.array([_node(s) for s in found], pa.int64()),
                "size": pa.array([len(s) for s in found], pa.int64()),
                "keys": pa.array([bands(s) for s in found], pa.list_(pa.int64())),
            }
            if fingerprints:
                columns["fp"] = pa.array([simhash_index.fingerprint(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, node bigint, size bigint, keys array<bigint>"
    return _bytes(docs).mapInArrow(run, schema + ", fp bigint" * fingerprints)


def _sets(docs: DataFrame) -> DataFrame:
    """(node, shingles, bits) of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_node(s) for s in found], pa.int64()),
                    pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                    pa.array([bitmap(s) for s in found], pa.list_(pa.int64())),
                ],
                names=["node", "shingles", "bits"],
            )

    return _bytes(docs).mapInArrow(run, "node bigint, shingles array<bigint>, bits array<bigint>").dropDuplicates(
        ["node"]
    )


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), text_of(docs).cast("binary").alias("text"))


def _as_similar(both: Column, one: Column, other: Column) -> Column:
    """Whether ``both`` common shingles are SIMILARITY hundredths of all, in whole numbers."""
    return both * 100 >= (one + other - both) * SIMILARITY


def _fitting(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs of entries x and y, once each, b the smaller; without those
    whose sizes alone keep them apart: what two sets can share is the smaller one."""
    one, other = F.col("x.size"), F.col("y.size")
    first, second = F.struct("x.owner", "x.node"), F.struct("y.owner", "y.node")
    return (
        pairs.where((F.col("x.node") != F.col("y.node")) & _as_similar(F.least(one, other), one, other))
        .select(
            F.greatest(first, second)["node"].alias("a"), F.least(first, second)["node"].alias("b")
        )
        .distinct()
    )


def _likely(pairs: DataFrame) -> DataFrame:
    """(x, y) of pairs of entries with bitmaps, without the bitmaps and without
    those pairs whose bitmaps keep them apart. A pair at SIMILARITY always stays:
    of the shingles of both sets at least as many are in one only as bits differ."""
    one, other = F.col("x.size"), F.col("y.size")
    apart = F.lit(0).cast("bigint")
    for i in range(BITS // 64):
        apart = apart + F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i]))
    both = F.least(one, other, F.shiftright(one + other - apart, 1))
    return pairs.where(_as_similar(both, one, other)).select(
        *[F.struct(*[F.col(f"{e}.{name}") for name in ("owner", "node", "size")]).alias(e) for e in ("x", "y")]
    )


def _few_of_each(pairs: DataFrame, most: int) -> DataFrame:
    """(x, y): for each x the ``most`` smallest of its distinct y."""
    place = F.row_number().over(Window.partitionBy("x").orderBy("y"))
    found = pairs.select("x", "y").where("x <> y").distinct()
    return found.withColumn("_place", place).where(F.col("_place") <= most).select("x", "y")


def _smallest(entries: DataFrame, most: int) -> DataFrame:
    """(key, y): the ``most`` entries of smallest owner of each bucket."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("x"))
    return entries.select("key", "x").withColumn("_place", place).where(F.col("_place") <= most).select(
        "key", F.col("x").alias("y")
    )


def _decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingles are as similar as near copies are."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    both = F.size(F.array_intersect("one", "other"))
    linked = pairs.join(left, "a").join(right, "b").where(_as_similar(both, F.size("one"), F.size("other")))
    return stored(linked.select("a", "b"), "near-links")


def _alike(prints: DataFrame) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints are of one class of the SimHash
    index: each with the smallest node of its class."""
    pairs = stored(prints.where("doc_id is not null").select("node", "fp").distinct(), "near-fingerprints")
    fps = stored(pairs.select("fp").distinct(), "near-distinct-fingerprints")
    roots = components(simhash_index.links(fps), "near-simhash").withColumnRenamed("node", "_fp")
    named = pairs.join(roots, F.col("fp") == F.col("_fp"), "left").select("node", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("node").alias("b"))
    alike = named.join(smallest, "root").select(F.col("node").alias("a"), "b").where("a <> b")
    return stored(alike.distinct(), "near-alike")


def _together(links: list[DataFrame]) -> DataFrame:
    found = links[0]
    for more in links[1:]:
        found = found.unionAll(more)
    return found


def _apart(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries of buckets whose nodes aren't all in one class yet, with their
    class ``root`` and whether it is the bucket's ``main`` one, of most entries."""
    named = crowded.join(roots.withColumnRenamed("node", "_node"), F.col("x.node") == F.col("_node"), "left")
    named = named.select("key", "x", F.coalesce("root", F.col("x.node")).alias("root"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = (
        sizes.groupBy("key")
        .agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "root")).alias("m"))
        .where("classes > 1")
        .select("key", F.col("m.root").alias("_main"))
    )
    return stored(
        named.join(main, "key").select("key", "x", "root", (F.col("root") == F.col("_main")).alias("main")), "near-apart"
    )


def near_copies(
    docs: DataFrame,
    bucket_limit: int = BUCKET_LIMIT,
    leaders: tuple[int, int] = LEADERS,
    fingerprints: bool = False,
) -> DataFrame:
    """(doc_id, component_id) of every row: texts that share 0.8 or more of their
    distinct five-word shingles (of all that either has) are linked, component_id
    is the smallest doc_id that is reachable. With ``fingerprints`` so are the texts
    that ``simhash_index`` links, those whose SimHash differs by two bits at most.

    Equal sets of shingles are one node. Min-hash bands propose pairs of nodes
    that meet in a bucket; every pair is then decided by the shingles
    themselves, so none of them below 0.8 is linked. In buckets of more than
    ``bucket_limit`` nodes a bitmap of each node's shingles goes with it, which
    bounds what two nodes can share; pairs that it keeps below 0.8 are dropped
    where they meet, before their sets are brought together.

    In a bucket of up to ``bucket_limit`` nodes all are compared. In a larger
    one the same classes are found with fewer comparisons, in three rounds.
    First a node is compared with the smallest nodes of its buckets, at most
    ``leaders[0]`` of them. Then those outside a bucket's main class, the one of
    most of its nodes, with ``leaders[1]`` nodes of main classes at most. Last,
    those that are still outside with all nodes of other classes: of two nodes
    in different classes one is outside the main class, so no link between
    classes is lost. A family of copies takes work in proportion to its size;
    only a bucket of many nodes that share a band, and are no copies of each
    other, is compared in full, by bitmaps.

    Texts are shingled twice: all for the bands, those that meet another for
    the comparison. Null and empty texts are copies of each other. A null
    doc_id links no texts.
    """
    prints = stored(_signatures(docs, fingerprints), "near-signatures")
    owners = (
        prints.where("doc_id is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("owner"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    )
    nodes = stored(owners, "near-nodes")
    entry = nodes.select(F.explode("keys").alias("key"), F.struct("owner", "node", "size").alias("x"))
    buckets = stored(entry.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    met = stored(entry.join(buckets, "key").select("key", "x", "n"), "near-entries")
    ids = stored(met.select(F.col("x.owner").alias("_owner")).distinct(), "near-ids")
    likely, _ = sieve(ids, "_owner").parted(docs.select("doc_id", "text"), "doc_id")
    sets = stored(_sets(likely.join(ids, F.col("doc_id") == F.col("_owner"), "left_semi")), "near-sets")

    cold = met.where(F.col("n") <= bucket_limit).select("key", "x")
    marked = sets.select(F.col("node").alias("_node"), "bits")
    crowded = met.where(F.col("n") > bucket_limit).join(marked, F.col("x.node") == F.col("_node"))
    crowded = stored(crowded.select("key", F.struct("x.owner", "x.node", "x.size", "bits").alias("x")), "near-crowded")
    others = cold.select("key", F.col("x").alias("y"))
    beside = cold.join(others, "key").where(F.col("x") > F.col("y")).select("x", "y")
    least = crowded.groupBy("key").agg(F.min("x").alias("y"))
    led = _few_of_each(_likely(crowded.join(least, "key")), leaders[0])
    links = [_decided(_fitting(beside.unionAll(led)), sets)]
    if fingerprints:
        links.append(_alike(prints))
    roots = components(_together(links), "near-copies")
    if not crowded.isEmpty():
        for most in (leaders[1], None):
            apart = _apart(crowded, roots)
            outside = apart.where(~F.col("main"))
            if apart.isEmpty():
                break
            if most is not None:
                pairs = _few_of_each(_likely(outside.join(_smallest(apart.where("main"), most), "key")), most)
            else:
                every = apart.select("key", F.col("x").alias("y"), F.col("root").alias("_root"))
                pairs = _likely(outside.join(every, "key").where(F.col("root") != F.col("_root")))
            links.append(_decided(_fitting(pairs), sets))
            if links[-1].isEmpty():
                continue
            roots = components(_together(links), "near-copies")
    named = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        "node", "owner", F.coalesce("root", "node").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    classes = stored(named.join(smallest, "root").select("node", "component_id"), "near-classes")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return prints.select("doc_id", "node").join(classes, "node", "left").select("doc_id", own.alias("component_id"))


def one_of_each(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their class of near
    copies, with all their columns. Of rows that repeat a doc_id the least one
    stays; rows without a doc_id all stay."""
    return simhash_index.smallest_of_each(docs, near_copies(docs, **options))
