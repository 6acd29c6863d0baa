"""The process graph: one node per pid, at most one parent edge per node.

Depth is the number of new processes met while walking pid -> parent pid, at
most 20 hops. A parent without an edge of its own still counts as a hop; a
process that was met before ends the walk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsift.operators.lookup import DEFAULT_LIMITS, LookupLimits, lookup
from procsift.schema import MAX_DEPTH
from procsift.session import Stored, store


def process_nodes(events: DataFrame) -> DataFrame:
    """One row per id seen as pid or ppid, in one shuffle with partial sums.

    ``parent``: the ppid of the pid's last event (by ``event_id``) that has
    both ids. ``first_seen``: the pid's smallest timestamp. ``n_events`` and
    ``n_children``: events with the id as pid and as ppid.
    """
    both = F.col("pid").isNotNull() & F.col("ppid").isNotNull()
    roles = F.array(
        F.struct(
            F.col("pid").alias("id"),
            F.col("timestamp").alias("seen"),
            F.when(both, F.col("ppid")).alias("parent"),
            F.when(both, F.col("event_id")).alias("order"),
            F.lit(True).alias("own"),
        ),
        F.struct(
            F.col("ppid").alias("id"),
            F.lit(None).alias("seen"),
            F.lit(None).alias("parent"),
            F.lit(None).alias("order"),
            F.lit(False).alias("own"),
        ),
    )
    return (
        events.select(F.inline(roles))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(
            F.max_by("parent", "order").alias("parent"),
            F.min("seen").alias("first_seen"),
            F.count_if("own").alias("n_events"),
            F.count_if(~F.col("own")).alias("n_children"),
        )
    )


def distinct_steps(path: Column) -> Column:
    """Depth from the start node and the hops taken from it."""
    return (F.size(F.array_distinct(path)) - 1).cast("bigint")


def _extend(
    paths: Stored, by: DataFrame, by_size: Stored, hops: int, limits: LookupLimits
) -> DataFrame:
    """Append to each full path the hops already known from its last node."""
    last = F.when(F.size("hops") == hops, F.element_at("hops", -1))
    ahead = lookup(
        paths.df.withColumn("_last", last),
        Stored(by, by_size.path, by_size.rows, by_size.bytes),
        {"_last": "id"},
        {"hops": "_ahead"},
        limits=limits,
    )
    grown = F.concat("hops", F.coalesce("_ahead", F.array().cast("array<bigint>")))
    return ahead.select("id", grown.alias("hops"))


def node_depths(nodes: Stored, limits: LookupLimits = DEFAULT_LIMITS) -> DataFrame:
    """``id, depth`` for every node of a stored node table.

    Paths double in length: 1, 2, 4, 8, 16 hops, then 4 more to reach 20, so
    five joins do instead of twenty. While the paths stay small the joins are
    broadcast joins inside one job; a large graph is written out after each
    round and joined with the hot-key split.
    """
    has_edge = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(
        F.array().cast("array<bigint>")
    )
    first = nodes.df.select("id", has_edge.alias("hops"))
    # Every id with its 20 hops, the most a path can take.
    small = nodes.rows * 8 * (MAX_DEPTH + 4) <= limits.broadcast_bytes
    current = Stored(first, nodes.path, nodes.rows, 0 if small else nodes.rows * 40)
    if not small:
        current = store(first, "hops")
    known = {1: current}
    taken = 1
    for step in (1, 2, 4, 8, 4):
        grown = _extend(current, known[step].df, known[step], taken, limits)
        taken += step
        if small:
            current = Stored(grown, nodes.path, nodes.rows, 0)
        else:
            current = store(grown, "hops")
        known[taken] = current
    walked = F.concat(F.array("id"), F.col("hops"))
    return current.df.select("id", distinct_steps(walked).alias("depth"))


def graph_table(events: DataFrame, limits: LookupLimits = DEFAULT_LIMITS) -> Stored:
    """The node table with depths, stored: the lookup side of two features."""
    nodes = store(process_nodes(events), "nodes")
    depths = node_depths(nodes, limits)
    if nodes.bytes <= limits.broadcast_bytes:
        full = nodes.df.join(F.broadcast(depths), "id", "left")
    else:
        # Unique keys on both sides: an even shuffle join.
        full = nodes.df.join(depths, "id", "left")
    return store(full, "graph")


def pid_depth(
    events: DataFrame, graph: Stored, limits: LookupLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Add ``pid_depth``; null only where pid is null."""
    return lookup(
        events, graph, {"pid": "id"}, {"depth": "pid_depth"}, weight="n_events", limits=limits
    )


def parent_first_seen(
    events: DataFrame, graph: Stored, limits: LookupLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Add ``parent_seen``, the first timestamp of the parent pid, or null."""
    return lookup(
        events,
        graph,
        {"ppid": "id"},
        {"first_seen": "parent_seen"},
        weight="n_children",
        limits=limits,
    )
