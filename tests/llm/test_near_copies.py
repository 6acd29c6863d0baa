"""The pipeline's near-copy stage against brute-force pairs of five-word shingles."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from procsift.llm import near_copies, simhash_index


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def texts(seed, groups, copies, changes):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(200)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, changes)):
                text[rng.randrange(200)] = word()
            out.append(" ".join(text))
    return dict(enumerate(out))


@pytest.mark.parametrize("limit", [64, 16, 3])
def test_near_copies_against_brute_force(spark, limit):
    rows = texts(5, 12, 5, 6)
    docs = spark.createDataFrame([*rows.items(), (90, None), (91, ""), (None, rows[0])], "doc_id long, text string")
    sets = {i: grams(t) for i, t in rows.items()}
    pairs = [(i, j) for i, j in combinations(rows, 2) if alike(sets[i], sets[j])]
    assert len(pairs) > 20
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, bucket_limit=limit).collect()}
    assert got[90] == got[91] == 90 and got[None] is None
    assert {i: got[i] for i in rows} == classes(rows, pairs)


def classes(rows, pairs):
    root = {i: i for i in rows}
    while True:
        before = dict(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


@pytest.mark.parametrize("changes", [12, 40])
def test_a_crowded_bucket_of_many_texts(spark, monkeypatch, changes):
    """Five hundred texts of one family, and how many tables that takes."""
    rows = texts(11, 1, 500, changes)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    written = []
    monkeypatch.setattr(near_copies, "stored", lambda df, label, f=near_copies.stored: (written.append(label), f(df, label))[1])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    sets = {i: grams(t) for i, t in rows.items()}
    assert got == classes(rows, [(i, j) for i, j in combinations(rows, 2) if alike(sets[i], sets[j])])
    assert len(written) <= 14


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_over_whole_tables(spark, sf):
    """Pairs at 0.8 or more that share one of their rarest shingles, which all such pairs do."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    sets = {r["doc_id"]: near_copies.shingles((r["text"] or "").encode()) for r in docs.collect()}
    distinct = {}
    for i, s in sets.items():
        distinct.setdefault(s.tobytes(), (i, s))
    values, counts = np.unique(np.concatenate([s for _, s in distinct.values()]), return_counts=True)
    by_shingle, pairs = {}, set()
    for i, s in distinct.values():
        order = s[np.lexsort((s, counts[np.searchsorted(values, s)]))]
        for x in order[: len(s) - -(-4 * len(s) // 5) + 1].tolist():
            for j in by_shingle.setdefault(x, []):
                pairs.add((j, i))
            by_shingle[x].append(i)
    true = []
    for i, j in pairs:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            true.append((i, j))
    joined = sum(found[i] == found[j] for i, j in true)
    print(sf, joined, len(true))
    assert len(true) >= 5 and joined >= 0.98 * len(true)
    # Nothing else is joined: classes are those of the pairs.
    roots = classes(sets, true + [(distinct[s.tobytes()][0], i) for i, s in sets.items()])
    assert sum(roots[i] != c for i, c in found.items()) <= 0.02 * len(true)


def test_stage_removes_copies_with_changed_words(spark):
    rows = texts(6, 1, 40, 3)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    sets = {i: grams(t) for i, t in rows.items()}
    near = {i for i in rows if i and alike(sets[0], sets[i])}
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert near and 0 in kept and not kept & near


def test_stage_removes_what_the_simhash_index_links(spark):
    """Long texts of few words: their fingerprints are near where their shingles aren't. The
    ids that both kinds of links lead to are one group; a repeated id joins no groups."""
    rng = random.Random(8)
    common = " ".join(["red green blue"] * 300)
    tails = [" ".join(rng.choice("abcdefgh") * 4 + str(rng.randrange(99)) for _ in range(40)) for _ in range(5)]
    rows = [(3, f"{common} {tails[0]}"), (9, f"{common} {tails[1]}"), (2, f"{common} {tails[1]} more"), (7, tails[2]), (5, tails[3])]
    rows += [(20, f"{common} {tails[4]}"), (20, tails[2] + " end"), (None, tails[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [simhash_index.fingerprint(t.encode()) for _, t in rows[:3]]
    assert max((a ^ b).bit_count() for a, b in combinations(fps, 2)) <= 2
    assert not alike(grams(rows[0][1]), grams(rows[1][1])) and alike(grams(rows[1][1]), grams(rows[2][1]))
    apart = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect() if r["doc_id"] in (2, 3, 9)}
    assert apart == {2: 2, 3: 3, 9: 2}
    got = {(r["doc_id"], r["component_id"]) for r in near_copies.near_copies(docs, fingerprints=True).collect()}
    assert got == {(2, 2), (3, 2), (9, 2), (7, 7), (5, 5), (20, 2), (20, 7), (None, None)}
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(map(str, kept)) == ["2", "5", "7", "None"]


def test_bands_miss_next_to_none_at_the_similarity():
    draw, missed = np.random.default_rng(6), 0
    for _ in range(3000):
        both = draw.integers(0, 1 << 63, 160, dtype=np.uint64)
        own = draw.integers(0, 1 << 63, (2, 20), dtype=np.uint64)
        one, other = (near_copies.bands(np.sort(np.concatenate([both, x]))) for x in own)
        missed += not set(one) & set(other)
    assert missed == 0
