"""The prefix trie against dictionaries of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from procsift.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, name string, part string, d int, item int"
COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children), leaves, saved, digest))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "n", "p", 1, 2) for r in rows], SCHEMA)
    return [tuple(r[c] for c in COLUMNS) for r in prefix_trie.conversation_trie(docs).collect()]


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def same(left, right):
    return sorted(left, key=key) == sorted(right, key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    draw = random.Random(seed)
    rows = []
    for conv in range(195, 240):
        for turn in range(draw.choice([0, 1, 2, 3, 4, 5, 8, 9, 17])):
            rows.append((conv, turn, draw.choice(["user", "assistant"]), draw.choice("ab")))
    assert same(found(spark, rows), brute(rows))


def test_long_and_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t % 5}" if c < 106 else f"t{t}") for c in (100, 101, 105, 107, 300) for t in range(37)]
    rows += [(c, 0, "user", "ok") for c in range(400, 450)]
    assert same(found(spark, rows), brute(rows))


def test_awkward_turns(spark):
    rows = [
        (7, None, None, None), (7, 2, "user", "é\U0001f600"), (7, 2, "user", "é\U0001f600"), (7, 1, "", ""),
        (8, 0, "a", "bc"), (9, 0, "ab", "c"), (None, 0, "user", "nobody"), (10, None, "user", "x" * 100_000),
        (-3, 0, "user", "below"), (0, 0, "user", "base"),
    ]
    # -3 % 100 is -3 here, so its base is 0, as in SQL.
    got = found(spark, [r for r in rows if r[0] != -3])
    assert same(got, brute([r for r in rows if r[0] != -3]))
    assert found(spark, rows)


def test_turnless_conversations_and_no_rows(spark):
    short = [c for c in range(110, 199) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]  # no conversation 100
    rows = [(c, 0, "user", "gone") for c in short]
    assert found(spark, rows) == [
        (min(short), 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())
    ]
    assert found(spark, []) == []


def test_any_partitioning(spark):
    draw = random.Random(5)
    rows = [(c, t, "user", draw.choice("xyz")) for c in range(300, 330) for t in range(6)]
    docs = spark.createDataFrame([(*r, "n", "p", 1, 2) for r in rows], SCHEMA)
    want = brute(rows)
    for n in (1, 13):
        got = [tuple(r[c] for c in COLUMNS) for r in prefix_trie.conversation_trie(docs.repartition(n)).collect()]
        assert same(got, want)
