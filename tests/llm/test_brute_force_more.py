"""Whole tables and random trees against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from procsift.llm import binary_packing, near_copies, reply_trees, simhash_index, token_secrets

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = text.lower().split()
    ones, n = [0] * 64, max(1, len(words) - 2)
    for i in range(n if words else 0):
        h = xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if words and 2 * ones[bit] > n)


def test_fingerprints_of_many_shingles():
    draw = random.Random(2)
    texts = ["", "one", "one two", "A b\tC d e", "x x x x x x"]
    texts += [" ".join(draw.choice(["red", "Green", "blue", "é"]) for _ in range(draw.randrange(4, 400))) for _ in range(60)]
    for text in texts:
        assert simhash_index.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text.encode())


def test_secrets_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    encoding = token_secrets._encoding(binary_packing.default_vocabulary(), binary_packing.default_pattern())
    assign = re.compile(
        r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
    )
    got = {r["doc_id"]: {tuple(s) for s in r["spans"]} for r in token_secrets.scan(docs).collect()}
    n = 0
    for r in docs.collect():
        text = r["text"] or ""
        want = {("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[1]) >= 8}
        want |= {("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16}
        want |= {("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32}
        base = list(want)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            if any(a < m.end() and m.start() < b for _, a, b in base) or token_secrets.is_known(m[0], encoding):
                continue
            if len(m[0]) / len(encoding.encode_ordinary(m[0])) < token_secrets.MAX_RATIO:
                want.add(("random", m.start(), m.end()))
        assert got[r["doc_id"]] == want
        n += len(want)
    assert n > 10


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_of_random_trees(spark, seed):
    draw, rows = random.Random(seed), []
    for tree in range(25):
        n = draw.randrange(1, 40)
        for node in range(n):
            parent = None if node == 0 else draw.choice([draw.randrange(node), node - 1, 99] if node > 3 else [node - 1])
            rows.append((tree, node, parent, draw.choice([None, 0.0, 0.5, 1.0])))
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {}
    for r in reply_trees.best_paths(nodes, top=3).collect():
        got.setdefault((r["tree"], r["rank"]), []).append((r["turn"], r["node"]))
    want = {}
    for tree in range(25):
        own = {n: (p, s or 0.0) for t, n, p, s in rows if t == tree}
        paths = []
        for leaf in own:
            if any(p == leaf for p, _ in own.values()):
                continue
            path, at = [], leaf
            while at in own:
                path.append(at)
                at = own[at][0]
            paths.append(path[::-1])
        paths.sort(key=lambda p: (-sum(own[n][1] for n in p) / len(p), -len(p), p[-1]))
        want |= {(tree, i): list(enumerate(p)) for i, p in enumerate(paths[:3], 1)}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_near_copies_of_awkward_rows(spark, awkward, nothing):
    got = near_copies.near_copies(awkward).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in awkward.collect())
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert near_copies.near_copies(nothing).collect() == []


def test_last_stage_on_awkward_rows(spark, awkward, nothing):
    import corpus_pipeline

    rows = corpus_pipeline.pack(spark, awkward, SF).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
    assert corpus_pipeline.pack(spark, nothing, SF).collect() == []


def test_bands_meet_at_the_similarity():
    """Pairs at 0.8 that no band proposes: one in a thousand by calculation."""
    draw, missed = np.random.default_rng(5), 0
    for _ in range(400):
        both = draw.integers(0, 1 << 63, 160, dtype=np.uint64)
        own = draw.integers(0, 1 << 63, (2, 20), dtype=np.uint64)
        one, other = (near_copies.bands(np.sort(np.concatenate([both, x]))) for x in own)
        missed += not set(one) & set(other)
    assert missed <= 4
