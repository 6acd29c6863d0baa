"""Line, near and exact dedup against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from procsift.llm import common, line_dedup, poly_exact, simhash_index

STRIP = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"{'Shared' if i % 2 else 'sHARED'} line number {i} éÉ" for i in range(12)] + ["short", "", "  "]
    docs = [
        (i, "\n".join(rng.choice((" ", "", "\t")) + rng.choice(pool) + rng.choice(("", " ")) for _ in range(rng.randint(1, 9))))
        for i in range(40)
    ]
    holders = defaultdict(set)
    key = lambda line: line.strip(STRIP).translate(LOWER)
    for i, text in docs:
        for line in text.split("\n"):
            holders[key(line)].add(i)
    got = {r["doc_id"]: r for r in line_dedup.drop_shared_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        lines = text.split("\n")
        kept = [
            x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i
        ]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == (
            "\n".join(kept), len(lines), len(lines) - len(kept),
        )


def classes(prints, radius):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for p in prints:
        groups[find(p)].add(p)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize(("radius", "segments", "limit"), [(2, 2, 64), (2, 2, 2), (3, 2, 3), (3, 2, 64), (2, 4, 64)])
def test_links_against_all_pairs(spark, radius, segments, limit):
    rng = random.Random(radius * 100 + limit)
    prints = {0, -1 & (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash_index.links(spark.createDataFrame(signed, "fp long"), radius, segments, limit)
    groups = defaultdict(set)
    for r in common.components(found).collect():
        groups[r["root"]].add(r["node"] & (1 << 64) - 1)
    assert {frozenset(g) for g in groups.values()} == classes(prints, radius)


def test_segment_radii_cover_every_split():
    for radius in range(5):
        for segments in range(2, 6):
            parts = simhash_index._segments(segments, radius)
            if len(parts) == segments:
                assert sum(r for _, _, r in parts) == max(0, radius - segments + 1)
            else:
                assert len(parts) == radius + 1


def test_fingerprint_of_one_shingle_is_its_hash():
    import xxhash

    for text, shingle in ((b"One two", b"one two"), (b" a\tB\nc ", b"a b c")):
        want = xxhash.xxh64_intdigest(shingle, 42)
        assert simhash_index.fingerprint(text) & (1 << 64) - 1 == want
    assert simhash_index.fingerprint(b" \n") == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_chunks_compose():
    data = bytes(range(256)) * 9
    whole = poly_exact.chunk_fingerprint(data, 4096)
    for size in (1, 7, 100, 2304):
        for which in (0, 1):
            total = sum(
                poly_exact.shifted(poly_exact.chunk_fingerprint(data[i : i + size], 4096)[which], i, which)
                for i in range(0, len(data), size)
            )
            assert total % poly_exact.PRIMES[which] == whole[which]


TEXTS = [
    (5, "a b c"), (3, "abc"), (4, "a bc "), (9, None), (8, ""), (7, " \n"), (1, "x" * 5000), (2, "x" * 5000 + " "),
    (6, "x" * 5001), (10, "é è"), (11, "éè"), (12, "solo"),
]


def expected():
    bare = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in TEXTS}
    size = {i: len(t or "") for i, t in TEXTS}
    out = {}
    for i, _ in TEXTS:
        same = [j for j in bare if bare[j] == bare[i]]
        keep = min(same, key=lambda j: (-size[j], j))
        out[i] = (keep, len(same), keep == i)
    return out


@pytest.mark.parametrize(("chunk", "huge"), [(1 << 16, 1 << 23), (64, 1 << 23), (64, 100)])
def test_exact_against_brute_force(spark, chunk, huge):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = poly_exact.exact_duplicates(docs, chunk, huge).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == expected()


def test_equal_fingerprints_of_different_texts_are_split(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = poly_exact.document_fingerprints
    monkeypatch.setattr(
        poly_exact,
        "document_fingerprints",
        lambda *a: real(*a).withColumn("h1", F.lit(0).cast("long")).withColumn("h2", F.lit(0).cast("long")),
    )
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = poly_exact.exact_duplicates(docs).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == expected()


def test_one_of_each_class_stays(spark):
    text = lambda i: " ".join(f"w{i}{j}" for j in range(60))
    rows = [(1, text(1)), (2, text(1)), (3, text(3)), (3, text(3)), (4, text(4)), (4, text(5)), (None, text(3)), (6, text(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in simhash_index.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == [1, 3, 4, 6, None]
    few = docs.where("doc_id in (1, 2, 6)")
    assert sorted(r["doc_id"] for r in simhash_index.one_of_each(few).collect()) == [1, 6]
