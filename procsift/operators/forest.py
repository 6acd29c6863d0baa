"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) as Spark jobs.

Sampling, tree growth and scoring are distributed. The model is a table of
tree nodes, at most ``trees * (2 * sample_size - 1)`` rows whatever the size of
the data. Every random choice follows from (seed, event_id, tree), so the
forest does not depend on partitioning and survives recomputed tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procsift.operators.quantiles import exact_quantiles
from procsift.schema import FEATURES, TRACE_COLUMNS
from procsift.session import store
from procsift.sources.artifacts import model_matrix, read_optional

# The default settings of the detector.
CONTAMINATION = 0.05
TREES = 150
SAMPLE_SIZE = 256
SEED = 42
AUTO_OFFSET = -0.5

# The node table goes to the driver and to every task; its size depends on the
# settings alone and is checked against this before the fit.
MAX_NODES = 4_000_000

# The matrix is written in small row groups, some ten thousand rows each: walking
# all trees costs far more than reading a row, so a scan must be able to give
# every core a part of a table that Parquet would keep in one group.
MATRIX_GROUP_BYTES = 512 * 1024

NODE_SCHEMA = "tree int, node int, feature int, cut double, size bigint, depth int"
_UNIT = 1 << 52
_EULER = 0.5772156649015329


def average_path(size: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``size`` points."""
    n = np.asarray(size, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        general = 2.0 * (np.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, general))


def _hash_below(rate: float, *parts):
    return F.pmod(F.xxhash64(*parts), F.lit(_UNIT)) < F.lit(int(rate * _UNIT))


def tree_samples(matrix: DataFrame, n: int, trees: int, size: int, seed: int) -> DataFrame:
    """``tree`` and the matrix columns: ``size`` rows per tree, drawn without
    replacement.

    One hash per row thins a large table to a pool whose size depends on the
    settings only. A pool row is a candidate for as many trees, drawn by hash,
    as it takes to give every tree about ``4 * size`` candidates, of which it
    keeps those of smallest hash.
    """
    candidates = 4 * size + 64
    pool_rate = min(1.0, 2.0 * candidates * trees / n)
    pool = matrix
    if pool_rate < 1.0:
        pool = matrix.where(_hash_below(pool_rate, "event_id", F.lit(seed)))
    slots = math.ceil(candidates * trees / (n * pool_rate))
    if 4 * slots < trees:
        chosen = F.array_distinct(
            F.array(
                *[
                    F.pmod(F.xxhash64("event_id", F.lit(seed + 2 + j)), F.lit(trees)).cast("int")
                    for j in range(slots)
                ]
            )
        )
    else:
        chosen = F.sequence(F.lit(0), F.lit(trees - 1))
    drawn = pool.select(F.explode(chosen).alias("tree"), "*").withColumn(
        "_draw", F.xxhash64("event_id", "tree", F.lit(seed + 1))
    )
    # A stated number of partitions: growing a tree costs far more than its few
    # bytes suggest, so the partitions must not be merged by size.
    drawn = drawn.repartition(max(1, trees // 4), "tree")
    order = Window.partitionBy("tree").orderBy(F.pmod("_draw", F.lit(_UNIT)), "event_id")
    return (
        drawn.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= size)
        .drop("_draw", "_place")
    )


def _grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree in heap numbering; feature -1 marks a leaf."""
    nodes = []
    waiting = [(0, 0, points)]
    while waiting:
        node, depth, part = waiting.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth == limit or len(usable) == 0:
            nodes.append((node, -1, math.nan, len(part), depth))
            continue
        feature = int(rng.choice(usable))
        cut = rng.uniform(low[feature], high[feature])
        if cut >= high[feature]:
            cut = low[feature]
        left = part[:, feature] <= cut
        nodes.append((node, feature, float(cut), len(part), depth))
        waiting.append((2 * node + 2, depth + 1, part[~left]))
        waiting.append((2 * node + 1, depth + 1, part[left]))
    return nodes


def grow_trees(samples: DataFrame, features: list[str], limit: int, seed: int) -> DataFrame:
    """One tree per group; a group is one bounded sample."""

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        points = rows.sort_values("event_id")[features].to_numpy(dtype=float)
        nodes = _grow(points, limit, np.random.default_rng([seed, tree]))
        table = pd.DataFrame(nodes, columns=["node", "feature", "cut", "size", "depth"])
        table.insert(0, "tree", tree)
        return table

    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def check_size(trees: int, sample_size: int, max_nodes: int = MAX_NODES) -> None:
    """Refuse a forest whose node table could be too large to send around."""
    bound = trees * (2 * sample_size - 1)
    if bound > max_nodes:
        raise ValueError(
            f"{trees} trees of {sample_size} samples can have {bound} "
            f"nodes, more than the {max_nodes} that may be sent to every task"
        )


@dataclass(frozen=True)
class Forest:
    """The node table with what is needed to apply it."""

    nodes: DataFrame
    trees: int
    sample_size: int
    features: list[str]
    offset: float
    contamination: str

    @property
    def height(self) -> int:
        return math.ceil(math.log2(max(self.sample_size, 2)))

    @cached_property
    def node_frame(self) -> pd.DataFrame:
        check_size(self.trees, self.sample_size)
        return self.nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Split feature and cut per inner heap slot, path length per bottom
        slot. A leaf above the bottom passes every row down to its left."""
        frame, height = self.node_frame, self.height
        inner, bottom = 2**height - 1, 2**height
        feature = np.zeros((self.trees, inner), dtype=np.int64)
        cut = np.full((self.trees, inner), np.inf)
        length = np.zeros((self.trees, bottom))
        split = frame[frame["feature"] >= 0]
        feature[split["tree"], split["node"]] = split["feature"]
        cut[split["tree"], split["node"]] = split["cut"]
        leaf = frame[frame["feature"] < 0]
        down = height - leaf["depth"].to_numpy()
        slot = (leaf["node"].to_numpy() + 1) * 2**down - 1 - inner
        length[leaf["tree"], slot] = leaf["depth"] + average_path(leaf["size"])
        return feature, cut, length


def matrix_of(columns: tuple[pd.Series, ...] | pd.Series) -> np.ndarray:
    """The batch as a float matrix, missing values as 0. A lone column comes
    without its tuple."""
    if isinstance(columns, pd.Series):
        columns = (columns,)
    return np.nan_to_num(
        np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
    )


# Rows that are walked together: their arrays fit the processor's cache.
_BLOCK = 4096


def _mean_path(points: np.ndarray, tables: tuple, height: int) -> np.ndarray:
    features, cuts, lengths = tables
    result = np.empty(len(points))
    inner = cuts.shape[1]
    for start in range(0, len(points), _BLOCK):
        part = points[start : start + _BLOCK]
        rows = len(part)
        flat = np.ascontiguousarray(part.T).ravel()
        columns = features * rows
        at = np.arange(rows)
        total = np.zeros(rows)
        for column, cut, length in zip(columns, cuts, lengths):
            # All rows start at the root, so the first step is one comparison.
            first = column[0]
            node = (flat[first : first + rows] > cut[0]).astype(np.int64)
            node += 1
            for _ in range(height - 1):
                value = flat.take(column.take(node) + at)
                right = value > cut.take(node)
                node += node
                node += 1
                node += right
            node -= inner
            total += length.take(node)
        result[start : start + rows] = total / len(cuts)
    return result


def raw_scores(df: DataFrame, forest: Forest, name: str = "raw_score") -> DataFrame:
    """Add the raw score: minus ``2 ** (-mean path / c(sample size))``.

    The walk of all trees is vectorised over an Arrow batch.
    """
    tables, height = forest.tables(), forest.height
    scale = float(average_path(forest.sample_size))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            mean = _mean_path(matrix_of(columns), tables, height)
            ratio = mean / scale if scale > 0 else np.ones_like(mean)
            yield pd.Series(-np.exp2(-ratio))

    inputs = [F.col(c).cast("double") for c in forest.features]
    return df.withColumn(name, score(*inputs))


def scored_matrix(matrix: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """Raw scores of a stored matrix, split by split: no row is moved."""
    return raw_scores(matrix, forest).select(
        "event_id", "raw_score", *[F.col(f"_keep_{c}").alias(c) for c in keep]
    )


def _decide(raw: DataFrame, offset: float) -> DataFrame:
    """Decision value, lower is more anomalous, and its 0/1 prediction."""
    decision = F.col("raw_score") - F.lit(float(offset))
    return raw.withColumn("anomaly_score", decision).withColumn(
        "is_anomaly", (F.col("anomaly_score") < 0).cast("int")
    ).drop("raw_score")


def fit_and_score(
    features: DataFrame,
    *,
    contamination: float | str = CONTAMINATION,
    trees: int = TREES,
    max_samples: int | str = SAMPLE_SIZE,
    seed: int = SEED,
    columns: list[str] | None = None,
    keep: list[str] | None = None,
    max_nodes: int = MAX_NODES,
) -> tuple[Forest, DataFrame]:
    """Fit the forest; also return ``event_id, anomaly_score, is_anomaly`` of
    the training rows, whose raw scores the fit needs anyway for its offset.

    ``keep`` names columns of ``features`` to carry along, so that what follows
    needs no join; features among them keep their own values. Settings whose
    forest could have more than ``max_nodes`` nodes are refused at once.
    """
    names = columns or FEATURES
    wanted = SAMPLE_SIZE if max_samples == "auto" else int(max_samples)
    check_size(trees, wanted, max_nodes)
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep or []]
    matrix = store(model_matrix(features, names, kept), "matrix", group_bytes=MATRIX_GROUP_BYTES).df
    n = matrix.count()
    if n == 0:
        raise ValueError("no rows to fit")
    size = min(wanted, n)
    limit = math.ceil(math.log2(max(size, 2)))
    samples = tree_samples(matrix.select("event_id", *names), n, trees, size, seed)
    nodes = store(grow_trees(samples, names, limit, seed), "forest")
    draft = Forest(nodes.df, trees, size, names, 0.0, str(contamination))
    scored = store(scored_matrix(matrix, draft, keep or []), "raw").df
    if contamination == "auto":
        offset = AUTO_OFFSET
    else:
        offset = exact_quantiles(scored, "raw_score", [float(contamination)])[0]
    forest = Forest(nodes.df, trees, size, names, offset, str(contamination))
    return forest, _decide(scored, offset)


def fit(features: DataFrame, **settings) -> Forest:
    return fit_and_score(features, **settings)[0]


def score(features: DataFrame, forest: Forest) -> DataFrame:
    """Add ``anomaly_score`` and ``is_anomaly`` to any frame with the features."""
    return _decide(raw_scores(features, forest), forest.offset)


def with_trace(scores: DataFrame, events: DataFrame | None) -> DataFrame:
    """Scores with the trace columns of their events, by ``event_id``; without
    events the columns are there and null."""
    if events is None:
        missing = {c: F.lit(None).cast("string") for c in TRACE_COLUMNS if c not in scores.columns}
        if "timestamp" in missing:
            missing["timestamp"] = F.lit(None).cast("timestamp_ntz")
        return scores.withColumns(missing)
    extra = [c for c in TRACE_COLUMNS if c in events.columns and c not in scores.columns]
    return scores.join(events.select("event_id", *extra), "event_id", "left")


def save_forest(forest: Forest, path: str) -> None:
    """Node table and one settings row, as two Parquet tables."""
    forest.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    settings = [
        (forest.trees, forest.sample_size, forest.features, float(forest.offset), forest.contamination)
    ]
    forest.nodes.sparkSession.createDataFrame(
        settings,
        "trees int, sample_size int, features array<string>, offset double, contamination string",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_forest(spark: SparkSession, path: str) -> Forest | None:
    """The stored forest, or none where it is absent or broken."""
    nodes = read_optional(spark, f"{path}/nodes")
    settings = read_optional(spark, f"{path}/settings")
    if nodes is None or settings is None:
        return None
    row = settings.first()
    if row is None or not {"tree", "node", "feature", "cut"} <= set(nodes.columns):
        return None
    return Forest(
        nodes, row["trees"], row["sample_size"], list(row["features"]), row["offset"], row["contamination"]
    )
