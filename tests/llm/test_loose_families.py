"""A family of texts that share bands without being near copies: classes, and pairs whose sets are compared."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from procsift.llm import near_copies


def family(seed, n, changes):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(150)]
    out = {}
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(150), rng.randint(*changes)):
            text[at] = word()
        out[i] = " ".join(text)
    return out


def test_loose_family(spark, monkeypatch):
    rows = family(3, 500, (1, 8))
    sets = {i: near_copies.shingles(t.encode()) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i, j in combinations(rows, 2):
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            linked += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert linked > 100 and len({find(i) for i in rows}) > 200
    compared = []
    monkeypatch.setattr(
        near_copies, "_decided", lambda pairs, sets, f=near_copies._decided: (compared.append(pairs.count()), f(pairs, sets))[1]
    )
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    print(compared, linked)
    assert sum(got[i] != find(i) for i in rows) <= 2  # 0.1 % of pairs at 0.8 meet in no bucket
    assert sum(compared) < 20 * len(rows)


def test_bitmaps_never_part_a_pair_at_the_limit():
    rng = np.random.default_rng(7)
    for size in (1, 5, 40, 300, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: -(-len(a) * 9 // 10)], rng.integers(0, 1 << 64, size // 10, dtype=np.uint64)]))
            differ = np.bitwise_count((near_copies.bitmap(a) ^ near_copies.bitmap(b)).view(np.uint64)).sum()
            assert differ <= len(np.setxor1d(a, b))
