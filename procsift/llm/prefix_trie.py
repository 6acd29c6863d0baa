"""Prefix trie of conversations by van Emde Boas recursion: cut at half depth, name, recurse, graft."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsift.llm.common import stored

#: Names are as many bytes of a SHA-256.
NAME_BYTES = 16
ROOT = bytearray(NAME_BYTES)

#: A conversation takes its first turns, fewer than SHARED, from the first of its hundred.
SHARED, BASES = 6, 100


def _name(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, NAME_BYTES)


def _item(role: Column, text: Column) -> Column:
    """Names a turn: role and text, with the role's length so that none can run into the other."""
    size = F.octet_length(role).cast("string").cast("binary")
    return _name(size, F.lit(b":"), role.cast("binary"), text.cast("binary"))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, d, item, chars): the d-th turn of each conversation, from 1.

    By turn, null first, then by content. Rows without a conv_id take no part.
    Places come from a range-sorted table and the number of rows of each of its
    parts, so a conversation of any length is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        _item(role, text).alias("item"),
        F.char_length(text).cast("bigint").alias("chars"),
    )
    order = ["conv_id", "turn", "item"]
    placed = stored(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "trie-turns",
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("conv_id", "part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
        .select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    )
    return placed.join(starts, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") + F.col("shift") + 1).alias("d"), "item", "chars"
    )


def rebuilt(turns: DataFrame, shared: int = SHARED, bases: int = BASES) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, item, chars) and (conv_id, len) of the rebuilt conversations.

    A conversation c starts with the first h turns of c - c % bases, where h is
    crc32(c) % shared; its own turns after its first h follow.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("bigint")
    base = F.col("conv_id") - F.col("conv_id") % bases
    heads = (
        turns.where((F.col("conv_id") % bases == 0) & (F.col("d") < shared))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("d", "item", "chars"))).alias("head"))
    )  # fewer than ``shared`` turns each
    sizes = (
        turns.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("own"))
        .withColumn("h", h)
        .withColumn("base", base)
        .join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<d:bigint,item:binary,chars:bigint>>")), F.lit(1), F.col("h").cast("int")))
        .withColumn("taken", F.size("head").cast("bigint"))
        .withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("conv_id", "h", "taken", "head", "len")
    )
    sizes = stored(sizes, "trie-sizes")
    first = sizes.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    rest = (
        turns.join(sizes.select("conv_id", "h", "taken"), "conv_id")
        .where(F.col("d") > F.col("h"))
        .select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "item", "chars")
    )
    return first.unionAll(rest), sizes.select("conv_id", "len")


def _parts(paths: list[DataFrame]) -> DataFrame:
    out = paths[0]
    for more in paths[1:]:
        out = out.unionAll(more)
    return out


def _named(sequences: DataFrame, levels: int) -> DataFrame:
    """(conv_id, d, name) of every prefix.

    Upwards, neighbouring blocks of 2**k turns become one of twice the length.
    Downwards, all ranges of 2**(k+1) depths are cut at half at once: a cut
    prefix is named by its range's root and the block between. So each depth is
    cut in one range only, and what follows a name is a lower forest of its own.
    """
    blocks = [sequences.select("conv_id", (F.col("d") - 1).alias("i"), F.col("item").alias("block"))]
    for k in range(1, levels):
        half = blocks[-1]
        left = half.where("i % 2 = 0").select("conv_id", F.shiftright("i", 1).alias("i"), F.col("block").alias("a"))
        right = half.where("i % 2 = 1").select("conv_id", F.shiftright("i", 1).alias("i"), F.col("block").alias("b"))
        blocks.append(stored(left.join(right, ["conv_id", "i"]).select("conv_id", "i", _name("a", "b").alias("block")), f"trie-blocks-{k}"))
    cuts: list[DataFrame] = []
    known = None  # names of the depths that are multiples of 2**(k+1), as (conv_id, i, name)
    for k in reversed(range(levels)):
        upper = blocks[k].where("i % 2 = 0").select("conv_id", F.shiftright("i", 1).alias("i"), "block")
        level = F.lit(b"%d:" % k)
        # The range that begins at depth 0 has the root above it.
        cut = upper.where("i = 0").select("conv_id", "i", _name(level, F.lit(ROOT), "block").alias("name"))
        if known is not None:
            deeper = upper.where("i > 0").join(known, ["conv_id", "i"])
            cut = cut.unionAll(deeper.select("conv_id", "i", _name(level, "name", "block").alias("name")))
        cut = stored(cut.select("conv_id", ((2 * F.col("i") + 1) * (1 << k)).alias("d"), "name"), f"trie-names-{k}")
        cuts.append(cut)
        known = _parts(cuts).select("conv_id", F.shiftright("d", k).alias("i"), "name")
    return _parts(cuts)


def _level(x: Column) -> Column:
    """The exponent of the largest power of two in x; -1 for 0."""
    lowest = x.bitwiseAND(-x)
    return F.when(x == 0, -1).otherwise(F.round(F.log2(lowest)).cast("int")).cast("int")


def _graft(tree: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """(name, n_leaves, saved) over each node's subtree, the root's left out.

    From small ranges to large: the totals of the forest below a cut at depth
    c, an odd multiple of 2**k, go to the cut and to the nodes above it as far
    as the range's root, 2**k of them. Of a node and one below it exactly one
    cut lies between, so every total arrives once.
    """
    own = tree.select(
        "name", "parent", "depth", "conv_id",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        _level(F.col("depth") - 1).alias("level"),
    )
    grafts: list[DataFrame] = []
    sums = F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    for k in range(levels):
        below = _parts([own, *grafts]).where(F.col("level") == k)
        forests = below.groupBy("parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums)
        above = forests.select(
            "conv_id", "leaves", "saved", F.explode(F.sequence(F.col("depth") - (1 << k), F.col("depth") - 1)).alias("d")
        )
        grafts.append(
            stored(
                above.join(paths, ["conv_id", "d"])
                .groupBy("name", "parent", F.col("d").alias("depth"))
                .agg(F.min("conv_id").alias("conv_id"), *sums)
                .withColumn("level", _level(F.col("depth") - 1)),
                f"trie-grafts-{k}",
            )
        )
    return _parts([own, *grafts]).groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of the ascending, comma-joined conv_ids of each name.

    The lists are put into text in parallel, in sorted pieces; the digest, a
    chain by its definition, takes one piece at a time.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            pieces = [",".join(map(str, ids[a:b])) for a, b in zip(edges, [*edges[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[a] for a in edges], pa.binary()),
                    pa.array([ids[a] for a in edges], pa.int64()),
                    pa.array(pieces, pa.string()),
                ],
                names=["name", "first", "piece"],
            )

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, chain = None, hashlib.sha256()

        def row(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.binary()), pa.array([h for _, h in found], pa.string())],
                names=["name", "ends_sha256"],
            )

        for batch in batches:
            done = []
            for own, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != name:
                    if name is not None:
                        done.append((name, chain.hexdigest()))
                    name, chain = own, hashlib.sha256(piece.encode())
                else:
                    chain.update(b"," + piece.encode())
            yield row(done)
        if name is not None:
            yield row([(name, chain.hexdigest())])

    pieces = (
        ends.select("name", "conv_id")
        .repartitionByRange("name", "conv_id")
        .sortWithinPartitions("name", "conv_id")
        .mapInArrow(listed, "name binary, first bigint, piece string")
    )
    return (
        pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digested, "name binary, ends_sha256 string")
    )


def trie(sequences: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of ``sequences`` (conv_id, d, item, chars).

    ``sizes`` (conv_id, len) names every conversation once, turnless ones too;
    d runs from 1 to len. A node is a distinct prefix: conv_id is its smallest
    member, n_convs counts its members, n_children its children, n_leaves the
    childless nodes and saved_tokens the (n_convs - 1) times chars of its
    subtree, itself included; ends_sha256 is of the members that end there.
    Without a conversation there is no node, not even the root.
    """
    sequences, sizes = stored(sequences, "trie-sequences"), stored(sizes, "trie-lengths")
    longest = sizes.agg(F.max("len")).first()[0] or 0
    levels = max(1, int(longest).bit_length())
    names = stored(_named(sequences, levels), "trie-names")
    parents = names.select("conv_id", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    paths = stored(
        names.join(parents, ["conv_id", "d"], "left")
        .join(sequences.select("conv_id", "d", "chars"), ["conv_id", "d"])
        .select("conv_id", "d", "name", F.coalesce("parent", F.lit(ROOT)).alias("parent"), "chars"),
        "trie-paths",
    )
    nodes = stored(
        paths.groupBy("name", "parent", F.col("d").alias("depth"), "chars").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
        ),
        "trie-nodes",
    )
    children = stored(nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    tree = stored(
        nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))),
        "trie-tree",
    )
    totals = stored(_graft(tree, paths.select("conv_id", "d", "name", "parent"), levels), "trie-totals")
    first = totals.join(nodes.where("depth = 1").select("name"), "name").agg(
        F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved")
    )
    root = (
        sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        .where("n_convs > 0")
        .crossJoin(first)  # one row each
        .crossJoin(children.agg(F.coalesce(F.sum(F.when(F.col("name") == F.lit(ROOT), F.col("n_children"))), F.lit(0)).alias("n_children")))
        .select(
            F.lit(ROOT).alias("name"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(0).cast("bigint").alias("depth"),
            "conv_id", "n_convs", "n_children", "n_leaves", "saved",
        )
    )
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = sizes.agg(F.min("conv_id")).first()[0]
    below = (
        tree.where("depth > 1")
        .join(above, "parent")
        .unionByName(tree.where("depth = 1").withColumn("parent_conv_id", F.lit(top).cast("bigint")))
        .join(totals, "name")
        .select("name", "parent_conv_id", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved")
    )
    ends = names.join(sizes, ["conv_id"]).where("d = len").select("name", "conv_id")
    ends = ends.unionAll(sizes.where("len = 0").select(F.lit(ROOT).alias("name"), "conv_id"))
    return (
        below.unionByName(root)
        .join(_end_digests(ends), "name", "left")
        .select(
            "conv_id",
            F.col("depth").cast("bigint").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("n_leaves").cast("bigint").alias("n_leaves"),
            F.col("saved").cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text).

    Null role or text counts as empty; turns are ordered with null first, equal
    turn numbers by content. Rows without a conv_id take no part, repeated rows
    are turns of their own. Any length of conversation and of text is taken.
    """
    return trie(*rebuilt(stored(turns_in_order(conversations), "trie-ordered")))
