"""Feature attribution of flagged rows: exact Shapley values of a forest.

The path-dependent tree game of Lundberg et al. (2020): a feature outside the
coalition follows both branches in proportion to the training rows there. A
leaf's share of the game is a product over the features on its path, and the
Shapley value of a product game is an integral of a polynomial

    phi_j = value * integral over t in (0, 1) of
            (o_j - z_j) * product over i != j of ((1 - t) z_i + t o_i)

with o_i telling whether the row meets the path's conditions on feature i, and
z_i the share of rows that does. Gauss-Legendre nodes integrate it exactly.
Values explain the mean path length, so negative ones speak for an anomaly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsift.functions.topk import top_features
from procsift.operators.forest import Forest, average_path, matrix_of
from procsift.schema import NOT_FLAGGED
from procsift.session import dealt_out, store

_ROWS = 512
# Of a leaf with up to so many features the values of all combinations are held.
_TABLE_BITS = 8
# Flagged rows that one task explains.
ROWS_PER_PART = 2000


def _leaf_tables(forest: Forest) -> list[dict[str, np.ndarray]]:
    """Per tree and leaf: the path's features with their value interval and
    share of rows, padded with a feature that changes nothing."""
    result = []
    for _, tree in forest.node_frame.groupby("tree"):
        nodes = {r.node: r for r in tree.itertuples()}
        paths = []
        for leaf in nodes.values():
            if leaf.feature >= 0:
                continue
            box: dict[int, list[float]] = {}
            child = leaf.node
            while child > 0:
                up = nodes[(child - 1) // 2]
                entry = box.setdefault(up.feature, [-np.inf, np.inf, 1.0])
                if child % 2:
                    entry[1] = min(entry[1], up.cut)
                else:
                    entry[0] = max(entry[0], up.cut)
                entry[2] *= nodes[child].size / up.size
                child = up.node
            paths.append((leaf.depth + float(average_path(leaf.size)), box))
        slots = max(1, max(len(box) for _, box in paths))
        shape = (len(paths), slots)
        table = {
            "feature": np.zeros(shape, dtype=np.int64),
            "low": np.full(shape, -np.inf),
            "high": np.full(shape, np.inf),
            "share": np.ones(shape),
            "value": np.array([v for v, _ in paths]),
        }
        for i, (_, box) in enumerate(paths):
            for k, (feature, (low, high, share)) in enumerate(sorted(box.items())):
                table["feature"][i, k] = feature
                table["low"][i, k], table["high"][i, k] = low, high
                table["share"][i, k] = share
        result.append(table)
    return result


def _prepared(forest: Forest) -> list[dict]:
    """Per tree: the cuts of each feature, ``marks`` telling for each interval
    between them which leaves' conditions on the feature hold, and the leaves
    by the number of features on their path with the constants of the
    quadrature.

    Bit ``k`` of a leaf's mark stands for the ``k``-th feature on its path.
    """
    prepared = []
    for t in _leaf_tables(forest):
        real = (t["low"] > -np.inf) | (t["high"] < np.inf)
        marks = []
        for f in np.unique(t["feature"][real]):
            own = real & (t["feature"] == f)
            leaf, slot = np.nonzero(own)
            low, high = t["low"][own], t["high"][own]
            cuts = np.unique(np.concatenate([low, high]))
            cuts = cuts[np.isfinite(cuts)]
            # Interval i holds the values over cuts[i - 1] and up to cuts[i].
            first = np.searchsorted(cuts, low, "right")
            last = np.searchsorted(cuts, high, "left")
            place = np.arange(len(cuts) + 1)[:, None]
            mark = np.zeros((len(cuts) + 1, len(real)), dtype=np.int32)
            mark[:, leaf] = ((place >= first) & (place <= last)).astype(np.int32) << slot.astype(np.int32)
            marks.append((int(f), cuts, mark))
        width = real.sum(axis=1)
        groups = []
        for k in np.unique(width[width > 0]):
            leaves = np.flatnonzero(width == k)
            point, weight = np.polynomial.legendre.leggauss((k + 1) // 2)
            point, weight = (point + 1.0) / 2.0, weight / 2.0
            z = t["share"][leaves, :k, None]
            met, unmet = (1.0 - point) * z + point, (1.0 - point) * z
            scaled = t["value"][leaves, None, None] * weight
            when_met, when_unmet = scaled * (1.0 - z) / met, -scaled * z / unmet
            groups.append(
                {
                    "leaves": leaves,
                    "feature": t["feature"][leaves, :k],
                    "log_unmet": np.log(unmet).sum(axis=1),
                    "log_gain": np.log(met) - np.log(unmet),
                    "unmet": when_unmet.transpose(0, 2, 1).copy(),
                    "gain": (when_met - when_unmet).transpose(0, 2, 1).copy(),
                }
            )
        prepared.append({"marks": marks, "leaves": len(real), "groups": groups})
    return prepared


def _bits(marks: np.ndarray, k: int) -> np.ndarray:
    return ((marks[..., None] >> np.arange(k)) & 1).astype(float)


def _leaf_values(held: np.ndarray, group: dict) -> np.ndarray:
    """What each leaf gives to its features, where ``held`` tells which of its
    conditions are met."""
    product = np.exp(np.matmul(held, group["log_gain"]) + group["log_unmet"][:, None, :])
    return np.matmul(product, group["unmet"]) + held * np.matmul(product, group["gain"])


def _wide(values: np.ndarray, group: dict, features: int) -> np.ndarray:
    """Leaf values with a column for every feature."""
    wide = np.zeros((*values.shape[:2], features))
    wide[np.arange(len(values))[:, None], :, group["feature"]] = values.transpose(0, 2, 1)
    return wide


def _shapley(points: np.ndarray, prepared: list[dict]) -> np.ndarray:
    """A leaf's values depend on a row only by which conditions it meets: they
    are worked out once for every combination and looked up for the rows.

    Leaves with more than _TABLE_BITS features are worked out row by row.
    """
    total = np.zeros_like(points)
    features = points.shape[1]
    for t in prepared:
        looked_up, direct = [], []
        for group in t["groups"]:
            k = group["feature"].shape[1]
            if k > _TABLE_BITS:
                direct.append(group)
                continue
            table = _wide(_leaf_values(_bits(np.arange(2**k), k), group), group, features)
            looked_up.extend(zip(group["leaves"].tolist(), table))
        for start in range(0, len(points), _ROWS):
            part, out = points[start : start + _ROWS], total[start : start + _ROWS]
            marks = np.zeros((len(part), t["leaves"]), dtype=np.int32)
            for f, cuts, mark in t["marks"]:
                marks += mark.take(np.searchsorted(cuts, part[:, f], "left"), axis=0)
            marks = marks.T.astype(np.intp)
            for leaf, table in looked_up:
                out += table.take(marks[leaf], axis=0)
            for group in direct:
                held = _bits(marks[group["leaves"]], group["feature"].shape[1])
                out += _wide(_leaf_values(held, group), group, features).sum(axis=0)
    return total / len(prepared)


def base_value(forest: Forest) -> float:
    """Mean path length without knowing any feature."""
    return float(
        np.mean([(t["value"] * t["share"].prod(axis=1)).sum() for t in _leaf_tables(forest)])
    )


def attributions(df: DataFrame, forest: Forest, name: str = "attribution") -> DataFrame:
    """Add an array with one value per feature; meant for few rows."""
    prepared = _prepared(forest)

    @F.pandas_udf("array<double>")
    def shapley(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            points = matrix_of(columns)
            yield pd.Series(list(_shapley(points, prepared)))

    inputs = [F.col(c).cast("double") for c in forest.features]
    return df.withColumn(name, shapley(*inputs))


def append_attributions(
    gated: DataFrame, forest: Forest | None, *, top_k: int = 3
) -> DataFrame:
    """Append the strongest features to the explanations of flagged rows.

    The gated rows are stored once; nothing before this step runs twice. A
    Python function inside ``when`` would run on every row, so the flagged part
    of what was stored is explained on its own and united with the rest. Those
    rows are few (under the gate's quantile) and take up to a millisecond
    each, so they are dealt out evenly. Without a model or the needed columns
    the frame comes back as it is.
    """
    if forest is None or not {"explanation", "flagged"} <= set(gated.columns):
        return gated
    if not set(forest.features) <= set(gated.columns):
        return gated
    flagged = F.coalesce(F.col("flagged"), F.lit(False)) & (
        F.coalesce("explanation", F.lit(NOT_FLAGGED)) != NOT_FLAGGED
    )
    suffix = top_features(F.col("_attribution"), forest.features, top_k)
    gated = store(gated, "gated").df
    alerts = gated.where(flagged)
    explained = (
        attributions(dealt_out(alerts, alerts.count(), ROWS_PER_PART, "event_id"), forest, "_attribution")
        .withColumn("explanation", F.concat("explanation", F.coalesce(suffix, F.lit(""))))
        .drop("_attribution")
    )
    return explained.unionByName(gated.where(~flagged))
