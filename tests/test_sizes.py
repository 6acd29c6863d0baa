"""What may not grow with the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd

from procsift.operators import attribution, forest


class Nodes:
    def __init__(self, frame):
        self.frame = frame

    def toPandas(self):
        return self.frame


def grown(trees=6, size=64, seed=5):
    rng = np.random.default_rng(seed)
    nodes = [(t, *n) for t in range(trees) for n in forest._grow(rng.random((size, 4)).round(1), 6, rng)]
    frame = pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "size", "depth"])
    return forest.Forest(Nodes(frame), trees, size, list("abcd"), 0.0, "auto")


def test_leaf_values_are_worked_out_once_for_any_number_of_rows(monkeypatch):
    prepared, seen, real = attribution._prepared(grown()), [], attribution._leaf_values
    monkeypatch.setattr(attribution, "_leaf_values", lambda held, g: seen.append(held.size) or real(held, g))
    work = []
    for n in (3, 3000):
        seen.clear()
        attribution._shapley(np.random.default_rng(n).random((n, 4)), prepared)
        work.append(sum(seen))
    assert work[0] == work[1] > 0


def test_looked_up_values_are_those_of_each_row(monkeypatch):
    model = grown()
    points = np.random.default_rng(2).random((700, 4))
    cuts = model.node_frame["cut"].dropna().to_numpy()
    points[:200] = cuts[np.arange(800) % len(cuts)].reshape(200, 4)  # values at the cuts themselves
    prepared = attribution._prepared(model)
    looked_up = attribution._shapley(points, prepared)
    monkeypatch.setattr(attribution, "_TABLE_BITS", 0)
    assert np.allclose(looked_up, attribution._shapley(points, prepared), atol=1e-12)
    scale = forest.average_path(64)
    paths = forest._mean_path(points, model.tables(), model.height)
    assert scale > 0 and np.allclose(looked_up.sum(axis=1) + attribution.base_value(model), paths)
