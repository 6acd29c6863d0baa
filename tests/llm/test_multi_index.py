"""The inverted multi-index against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from procsift.llm import multi_index, queries

SCHEMA = "vec_id bigint, embedding array<float>, vec string, h int, class string, cell string"


def brute(rows, asked, nearest=5):
    """(query_id, rank) -> (vec_id, score) over all other rows."""
    fine = [
        (i, np.array(v, dtype=np.float64))
        for i, v in rows
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    out = []
    for at, (i, x) in enumerate(fine):
        if not asked(i):
            continue
        others = [(-float((x @ y) / np.sqrt(x @ x) / np.sqrt(y @ y)), j) for k, (j, y) in enumerate(fine) if k != at]
        others.sort(key=lambda o: (round(o[0], 12), o[1]))
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(others[:nearest], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, "b", "c") for i, v in rows], SCHEMA)


def found(spark, rows, every=5):
    got = multi_index.nearest_neighbours(frame(spark, rows), F.col("vec_id") % every == 0).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def agree(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def test_small_tables_are_exact(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.standard_normal(8).astype(np.float32).tolist()) for i in range(120)]
    agree(found(spark, rows), brute(rows, lambda i: i % 5 == 0))


def test_awkward_vectors(spark):
    one, two = [1.0, 0.0, 2.0], [2.0, 0.0, 4.0]
    rows = [
        (0, one), (5, two), (5, two), (10, None), (15, [0.0, 0.0, 0.0]), (20, [1.0, None, 0.0]),
        (25, [float("nan"), 1.0, 0.0]), (30, [float("inf"), 1.0, 0.0]), (None, one), (31, [-1.0, 0.0, -2.0]),
        (32, one), (33, [0.0, 1e-30, 0.0]), (35, [0.0, 3e38, 0.0]), (40, []),
    ]
    agree(found(spark, rows), brute(rows, lambda i: i % 5 == 0))


def test_other_lengths_take_no_part(spark):
    rows = [(i, [1.0, float(i)]) for i in range(7)] + [(50, [1.0]), (55, [1.0, 2.0, 3.0])]
    assert {r[0] for r in found(spark, rows)} == {0, 5}


def test_few_and_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0])]) == []
    assert found(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    agree(found(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), [(0, 1, 1, 0.0)])


def test_many_equal_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)]
    rows += [(i, draw.standard_normal(3).astype(np.float32).tolist()) for i in range(300, 330)]
    agree(found(spark, rows), brute(rows, lambda i: i % 5 == 0))


def _recall(got, want):
    true = {(r[0], r[2]) for r in want}
    return len(true & {(r[0], r[2]) for r in got}) / len(true)


@pytest.mark.parametrize("clusters", [1, 40])
def test_recall_and_shards(spark, monkeypatch, clusters):
    draw = np.random.default_rng(clusters)
    centres = 3 * draw.standard_normal((clusters, 16))
    vectors = (centres[draw.integers(0, clusters, 3000)] + draw.standard_normal((3000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    want = brute(rows, lambda i: i % 20 == 0)
    got = found(spark, rows, 20)
    assert _recall(got, want) >= 0.9
    exact = {r[:3:2]: r[3] for r in want}
    assert all(abs(r[3] - exact[r[0], r[2]]) < 1e-12 for r in got if (r[0], r[2]) in exact)
    # Small shards and few queries in one task give the same rows.
    monkeypatch.setattr(multi_index, "SHARD_VECTORS", 37)
    monkeypatch.setattr(multi_index, "SHARD_QUERIES", 11)
    assert found(spark, rows, 20) == got


def test_cells_come_in_order_of_summed_distance():
    draw = np.random.default_rng(4)
    for size in (2, 5, 9):
        one, two = draw.random(size), draw.random(size)
        counts = draw.integers(0, 3, size * size)
        away = (one[:, None] + two[None, :]).ravel()
        order = [c for c in np.argsort(away) if counts[c]]
        assert multi_index.traverse(one, two, counts, int(counts.sum())) == order
        part = multi_index.traverse(one, two, counts, 4)
        assert part == order[: len(part)] and counts[part].sum() >= min(4, counts.sum())
        assert counts[part[:-1]].sum() < 4


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op11_multi_index(spark, folder).collect()]
    want = brute(rows, lambda i: i % 50 == 0)
    assert len(got) == len(want)
    assert _recall(got, want) >= 0.9
