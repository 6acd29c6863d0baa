"""Exact quantiles with linear interpolation, for columns of any size.

``percentile`` keeps one counter per distinct value and merges them in one
task: right for columns of few values, not for the scores of a whole fleet.
Here a bounded sketch proposes two values around each wanted rank, exact counts
decide between which of them the rank lies, and so on until few enough distinct
values remain to count them one by one. Every pass is one aggregate over one
column with constant memory per task; a value that holds a large share of all
rows is decided by the counts alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_VALUES = 200_000
_SKETCH = 10_000
_MARGIN = 5.0 / _SKETCH


@dataclass(frozen=True)
class _Open:
    """The rank lies strictly between ``low`` and ``high``, which are None where
    there is no bound yet: an infinite score is a value like any other.
    ``upto`` rows are at or under ``low`` and ``rows`` rows are between."""

    low: float | None
    high: float | None
    upto: int
    rows: int
    distinct: float = math.inf

    def contains(self, value: Column) -> Column:
        inside = value.isNotNull()
        if self.low is not None:
            inside = inside & (value > F.lit(self.low))
        if self.high is not None:
            inside = inside & (value < F.lit(self.high))
        return inside


def exact_quantiles(
    df: DataFrame, column: str, probs: list[float], *, max_values: int = MAX_VALUES
) -> list[float | None]:
    """The quantiles as Python floats; null and NaN are left out, an empty
    column gives ``None`` for each.

    Two passes over the frame: one counts and sketches, one counts the values
    around the wanted ranks and the rows between. Only where more than
    ``max_values`` values may lie around them does the search narrow further.
    """
    value = F.col(column).cast("double").alias("v")
    data = df.select(value).where(F.col("v").isNotNull() & ~F.isnan("v"))
    edges = sorted({e for p in probs for e in (max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0))})
    size = data.agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct("v", 0.02).alias("d"),
        F.percentile_approx("v", edges, _SKETCH).alias("edges"),
    ).first()
    n = size["n"]
    if n == 0:
        return [None] * len(probs)
    places = {}
    for p in probs:
        position = (n - 1) * p
        k = int(math.floor(position))
        places[p] = (k, min(k + 1, n - 1), position - k)
    wanted = sorted({r for lower, upper, _ in places.values() for r in (lower, upper)})
    found = dict(zip(edges, size["edges"], strict=True))
    around = [(found[max(p - _MARGIN, 0.0)], found[min(p + _MARGIN, 1.0)]) for p in probs]
    values = {}
    if min(size["d"], 2 * _MARGIN * n * len(probs)) <= max_values:
        values = _counted_around(data, _merged(around), wanted)
    if len(values) < len(wanted):
        values = _order_statistics(data, n, wanted, max_values, size["d"])
    result = []
    for p in probs:
        lower, upper, share = places[p]
        a, b = values[lower], values[upper]
        result.append(_between(a, b, share))
    return result


def _merged(ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The ranges in order, those that touch as one."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _counted_around(data: DataFrame, ranges: list[tuple[float, float]], ranks: list[int]) -> dict[int, float]:
    """The values at those of the ``ranks`` that lie inside the ranges, in one pass.

    Every row counts: inside a range under its own value, else under the number
    of ranges below it. So the rows before a value are known without a second look.
    """
    v = F.col("v")
    below, inside = F.lit(0), F.lit(False)
    for low, high in ranges:
        below = below + (v > F.lit(high)).cast("int")
        inside = inside | v.between(F.lit(low), F.lit(high))
    counts = (
        data.groupBy(below.alias("cell"), F.when(inside, v).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # In a cell the rows outside its range come before those inside: they are
    # above the range before and under this one. What is sorted here is bounded.
    end = F.sum("n").over(Window.orderBy("cell", F.asc_nulls_first("v")))
    upto, before = F.col("upto"), F.col("upto") - F.col("n")
    reached = F.array_compact(F.array(*[F.when((upto > r) & (before <= r), F.lit(r).cast("bigint")) for r in ranks]))
    listed = counts.withColumn("upto", end).where("v is not null")
    rows = listed.select("v", F.explode(reached).alias("rank")).collect()  # a row for each rank
    return {r["rank"]: r["v"] for r in rows}


def _between(a: float, b: float, share: float) -> float:
    """Linear interpolation; a rank on a value is that value, infinite or not."""
    if a == b or share == 0:
        return a
    return (1 - share) * a + share * b


def _order_statistics(
    data: DataFrame, n: int, ranks: list[int], max_values: int, distinct: int
) -> dict[int, float]:
    """The values at 0-based ranks of the sorted column."""
    found: dict[int, float] = {}
    open_ranks = {r: _Open(None, None, 0, n, distinct) for r in ranks}
    while open_ranks:
        small = {r: o for r, o in open_ranks.items() if o.distinct <= max_values}
        found.update(_count_out(data, small))
        large = {r: o for r, o in open_ranks.items() if r not in small}
        open_ranks = {}
        for r, step in _narrow(data, large).items():
            if isinstance(step, _Open):
                open_ranks[r] = step
            else:
                found[r] = step
    return found


def _narrow(data: DataFrame, large: dict[int, _Open]) -> dict[int, _Open | float]:
    """One sketch pass and one counting pass for all ranks."""
    if not large:
        return {}
    # Ranks between the same two values share one sketch.
    shared: dict[tuple[float | None, float | None], list[int]] = {}
    for r, o in large.items():
        shared.setdefault((o.low, o.high), []).append(r)
    sketches = []
    for i, ranks in enumerate(shared.values()):
        o = large[ranks[0]]
        around = []
        for r in ranks:
            share = (r - o.upto) / max(o.rows - 1, 1)
            around += [max(share - _MARGIN, 0.0), min(share + _MARGIN, 1.0)]
        inside = F.when(o.contains(F.col("v")), F.col("v"))
        sketches.append(F.percentile_approx(inside, around, _SKETCH).alias(f"c{i}"))
    row = data.agg(*sketches).first()
    cuts = {}
    for i, ranks in enumerate(shared.values()):
        for j, r in enumerate(ranks):
            cuts[r] = (row[f"c{i}"][2 * j], row[f"c{i}"][2 * j + 1])

    counts = []
    for r, o in large.items():
        c1, c2 = cuts[r]
        v = F.col("v")
        between = F.when((v > F.lit(c1)) & (v < F.lit(c2)), v)
        counts += [
            F.count_if(v < F.lit(c1)).alias(f"under1_{r}"),
            F.count_if(v <= F.lit(c1)).alias(f"upto1_{r}"),
            F.count_if(v < F.lit(c2)).alias(f"under2_{r}"),
            F.count_if(v <= F.lit(c2)).alias(f"upto2_{r}"),
            F.approx_count_distinct(between, 0.02).alias(f"d_{r}"),
        ]
    row = data.agg(*counts).first()

    steps: dict[int, _Open | float] = {}
    for r, o in large.items():
        c1, c2 = cuts[r]
        under1, upto1 = row[f"under1_{r}"], row[f"upto1_{r}"]
        under2, upto2 = row[f"under2_{r}"], row[f"upto2_{r}"]
        if r < under1:
            steps[r] = _Open(o.low, c1, o.upto, under1 - o.upto)
        elif r < upto1:
            steps[r] = c1
        elif r < under2:
            steps[r] = _Open(c1, c2, upto1, under2 - upto1, row[f"d_{r}"])
        elif r < upto2:
            steps[r] = c2
        else:
            steps[r] = _Open(c2, o.high, upto2, o.upto + o.rows - upto2)
    return steps


def _count_out(data: DataFrame, small: dict[int, _Open]) -> dict[int, float]:
    """Read ranks from running counts over a bounded number of distinct values."""
    if not small:
        return {}
    matches = [
        F.when(
            o.contains(F.col("v")),
            F.struct(F.lit(r).cast("bigint").alias("rank"), F.lit(o.upto).cast("bigint").alias("upto")),
        )
        for r, o in small.items()
    ]
    running = F.sum("n").over(Window.partitionBy("rank").orderBy("v"))
    reached = (
        data.select("v", F.inline(F.array_compact(F.array(*matches))))
        .groupBy("rank", "upto", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("covered", F.col("upto") + running)
        .where(F.col("covered") > F.col("rank"))
        .groupBy("rank")
        .agg(F.min("v").alias("v"))
    )
    return {row["rank"]: row["v"] for row in reached.collect()}  # one row per rank
