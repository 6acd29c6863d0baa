"""What is exploded isn't sent to the driver, however small its table looks."""

from __future__ import annotations

import random
import re

import pytest

from procsift.llm import simhash_index


@pytest.mark.parametrize("limit", [64, 2])
def test_probes_are_not_broadcast(spark, tmp_path, limit):
    """A branch below a broadcast holds no exploded rows, so at most those of a stored table."""
    draw = random.Random(4)
    prints = {base ^ 1 << draw.randrange(63) ^ 1 << draw.randrange(63) for base in [5, 1 << 40, 77 << 30] for _ in range(60)}
    spark.createDataFrame([(fp,) for fp in sorted(prints)], "fp long").write.parquet(str(tmp_path / "fp"))
    links = simhash_index.links(spark.read.parquet(str(tmp_path / "fp")), bucket_limit=limit)
    below = None
    for line in links._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[ :+-]*", line)[0])
        if below is not None and depth <= below:
            below = None
        if below is None and "BroadcastExchange" in line:
            below = depth
        assert below is None or "Generate explode" not in line, line[:200]
    near = {(a, b) for a in prints for b in prints if a > b and (a ^ b).bit_count() <= 2}
    assert near and _roots(prints, near) == _roots(prints, {tuple(r) for r in links.collect()})


def _roots(nodes, pairs):
    root = {n: n for n in nodes}
    while True:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
