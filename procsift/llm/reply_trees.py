"""Chat formatting of reply trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsift.llm.common import stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escaped(column: Column) -> Column:
    """A backslash after each ``<``, ``[`` and backslash: no control string of
    this template or of one in square or pointed brackets is left."""
    return F.regexp_replace(column, r"([<\[\\])", r"$1\\")


def unescaped(column: Column) -> Column:
    return F.regexp_replace(column, r"([<\[\\])\\", "$1")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """What stands above each node, by doubling.

    Returns (tree, node, total, steps), the sum and number of scores on the
    way up to the root, and for each k the table (tree, node, up) of 2**k-th
    ancestors. Each round joins the table with itself.
    """
    at, above = nodes.alias("at"), nodes.select("tree", "node").alias("above")
    state = stored(
        at.join(
            above,
            _same(F.col("at.tree"), F.col("above.tree")) & (F.col("at.parent") == F.col("above.node")),
            "left",
        ).select(
            F.col("at.tree").alias("tree"),
            F.col("at.node").alias("node"),
            F.col("above.node").alias("up"),
            F.col("at.score").alias("total"),
            F.lit(1).cast("bigint").alias("steps"),
        ),
        "climb",
    )
    levels, most = [], nodes.count()
    while True:
        going = state.where("up is not null")
        n = going.count()
        if not n:
            break
        if 1 << len(levels) > most:  # what still climbs is on a ring, or below one
            state = state.where("up is null")
            break
        levels.append(going.select("tree", "node", "up"))
        low, high = going.alias("low"), state.alias("high")
        moved = low.join(
            high, _same(F.col("low.tree"), F.col("high.tree")) & (F.col("low.up") == F.col("high.node"))
        ).select(
            F.col("low.tree").alias("tree"),
            F.col("low.node").alias("node"),
            F.col("high.up").alias("up"),
            (F.col("low.total") + F.col("high.total")).alias("total"),
            (F.col("low.steps") + F.col("high.steps")).alias("steps"),
        )
        state = stored(state.where("up is null").unionAll(moved), "climb")
    return state.select("tree", "node", "total", "steps"), levels


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, turn, node) of the ``top`` root-to-leaf paths of each tree.

    ``nodes`` has tree, node, parent, score. Branches rank by the mean score of
    their nodes, then by length, then by the smaller leaf. Self-joins double the
    reach of each round, so a path of n turns takes log2(n) of them; rows grow
    with the turns of the chosen paths only.

    A parent that doesn't exist makes its node a root. Nodes on a ring, or
    below one, have no root and no path. A null score counts as zero.
    """
    nodes = stored(
        nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")),
        "nodes",
    )
    climbed, levels = _jumps(nodes)
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    c, p = climbed.alias("c"), parents.alias("p")
    leaves = c.join(
        p, _same(F.col("c.tree"), F.col("p.tree")) & (F.col("c.node") == F.col("p.node")), "left_anti"
    )
    by = Window.partitionBy("tree").orderBy(
        (F.col("total") / F.col("steps")).desc(), F.col("steps").desc(), F.col("node")
    )
    path = (
        leaves.withColumn("rank", F.row_number().over(by))
        .where(F.col("rank") <= top)
        .select("tree", F.col("node").alias("leaf"), "rank", "steps", "node", F.lit(0).cast("bigint").alias("above"))
    )
    for k in reversed(range(len(levels))):
        low, jump = path.alias("low"), levels[k].alias("jump")
        here = F.struct(F.col("low.node").alias("node"), F.col("low.above").alias("above"))
        there = F.struct(F.col("jump.up").alias("node"), (F.col("low.above") + (1 << k)).alias("above"))
        path = (
            low.join(
                jump,
                _same(F.col("low.tree"), F.col("jump.tree")) & (F.col("low.node") == F.col("jump.node")),
                "left",
            )
            .select(
                *[F.col(f"low.{c}").alias(c) for c in ("tree", "leaf", "rank", "steps")],
                F.explode(F.when(F.col("jump.up").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x"),
            )
            .select("tree", "leaf", "rank", "steps", "x.node", "x.above")
        )
    return stored(
        path.select("tree", "leaf", "rank", (F.col("steps") - F.col("above") - 1).alias("turn"), "node"),
        "paths",
    )


def format_trees(nodes: DataFrame, top: int = 1, learned_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, loss) of each chosen path.

    ``nodes`` has tree, node, parent, role, text, score. ``formatted`` is the
    whole conversation: for each turn START role SEP text END and a line break,
    role and text escaped. ``loss`` is the spans (start, length, in code points
    of ``formatted``) of the texts of ``learned_role``.

    Null role and text are empty. Rows without a node id are left out, of rows
    that repeat one the least stays. A null tree is a tree like any other.
    """
    nodes = stored(
        nodes.where("node is not null")
        .groupBy("tree", "node")
        .agg(
            F.min(
                F.struct(
                    "parent",
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                    "score",
                )
            ).alias("x")
        )
        .select("tree", "node", "x.*"),
        "turns",
    )
    paths = best_paths(nodes, top).alias("p")
    said = nodes.alias("n")
    head = F.concat(F.lit(START), escaped(F.col("n.role")), F.lit(SEP))
    body = escaped(F.col("n.text"))
    tail = F.lit(f"{END}\n")
    turns = paths.join(
        said, _same(F.col("p.tree"), F.col("n.tree")) & (F.col("p.node") == F.col("n.node"))
    ).select(
        F.col("p.tree").alias("tree"),
        "leaf",
        "rank",
        "turn",
        F.concat(head, body, tail).alias("piece"),
        F.char_length(head).alias("head"),
        F.char_length(body).alias("body"),
        (F.col("n.role") == learned_role).alias("learned"),
    )
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0))
    placed = turns.select(
        "tree", "leaf", "rank", "turn", "piece", "learned", (offset + F.col("head")).alias("start"), "body"
    )
    parts = F.sort_array(F.collect_list(F.struct("turn", "piece", "learned", "start", "body")))
    return (
        placed.groupBy("tree", "leaf", "rank")
        .agg(parts.alias("parts"))
        .select(
            "tree",
            "leaf",
            "rank",
            F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("formatted"),
            F.transform(
                F.filter("parts", lambda x: x["learned"]),
                lambda x: F.struct(
                    x["start"].cast("bigint").alias("start"), x["body"].cast("bigint").alias("length")
                ),
            ).alias("loss"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    cut = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(
        F.slice(cut, 2, F.size(cut)),
        lambda x: F.struct(
            unescaped(F.substring_index(x, SEP, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(x, SEP, -1), END, 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The learned texts of a formatted conversation, put together."""
    return F.array_join(
        F.transform(
            loss,
            lambda s: unescaped(
                F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
            ),
        ),
        "",
    )


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Each conversation as a tree of one branch: a turn replies to the one before.

    Turns of equal number follow by role and text; a null turn comes first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("bigint")
    return conversations.select(
        F.col("conv_id").alias("tree"),
        node.alias("node"),
        F.nullif(node - 1, F.lit(0)).cast("bigint").alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
