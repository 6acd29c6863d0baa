"""The language model, packing and chat formatting."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from procsift.llm import binary_packing, queries, recurrent_lm, reply_trees

SF = "/root/testdata/sf0.001"


class _Flat:
    own = recurrent_lm.CLASSES * recurrent_lm.WIDTH
    own_counts = np.ones(own)
    tail_tokens = np.ones(12)


def test_gradients():
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) * 3 for k, v in recurrent_lm.first_weights(_Flat).items()}
    ids, targets = (rng.integers(0, _Flat.own + 12, (5, 3)) for _ in range(2))
    state = rng.standard_normal((3, recurrent_lm.HIDDEN)) * 0.1

    def loss(w):
        states, _ = recurrent_lm._run_window(w, ids, state, keep=False)
        states = states.astype(np.float64).reshape(-1, recurrent_lm.HIDDEN)
        return -recurrent_lm.log_probabilities(w, states, targets.ravel()).sum()

    trainer = recurrent_lm.Trainer({k: v.copy() for k, v in weights.items()}, rate=0.0)
    trainer.window(ids, targets, np.ones((5, 3), bool), state)
    for name, value in weights.items():
        grad = trainer.grads[name]
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        up, down = ({k: v.copy() for k, v in weights.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert math.isclose((loss(up) - loss(down)) / 2e-2, grad[at], rel_tol=0.02), name
        assert value.shape == recurrent_lm.shapes_of_weights()[name]


def test_next_token_shares_add_up_to_one():
    rng = np.random.default_rng(1)
    weights = recurrent_lm.first_weights(_Flat)
    targets = np.arange(_Flat.own + 12)
    state = np.tile(rng.standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32), (len(targets), 1))
    logs = recurrent_lm.log_probabilities(weights, state, targets)
    assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-4)


def test_state_is_carried_over_windows():
    """A text's score doesn't depend on the window, the lanes or its neighbours."""
    lexicon = recurrent_lm.Lexicon(
        {b"a": 0, b"b": 1, recurrent_lm.END: 2}, np.log10([11, 6, 3]), np.zeros(3, dtype=int), 3,
        np.array([10.0, 5, 2]), np.zeros(12), np.zeros(12), 17, 3,
    )
    weights = recurrent_lm.first_weights(lexicon)
    texts = [b"a b a a b " * n for n in (1, 40, 0, 13)]
    encoded = [recurrent_lm.encode(t, lexicon) for t in texts]
    together = {k: v for k, _, v in recurrent_lm.score_documents(weights, iter(enumerate(encoded)))}
    for i, document in enumerate(encoded):
        states, _ = recurrent_lm._run_window(
            weights, document.inputs[:, None], np.zeros((1, recurrent_lm.HIDDEN), np.float32), keep=False
        )
        alone = recurrent_lm.log_probabilities(weights, states[:, 0], document.targets).sum()
        assert math.isclose(alone, together[i], rel_tol=1e-4)


def test_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), " "] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    every = sum(counts.values()) + len(counts) + 1
    gained = 0.0
    for i, own in tokens.items():
        r = rows[i]
        base = sum(math.log10((counts[w] + 1) / every) for w in own)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[i], len(own), sum(counts.values()))
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        gained += r["score"] - base if out[i] else 0
    assert gained > 0  # better than the unigram on texts it hasn't seen


def ids_of(texts):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def own_ids(text):
    encode = binary_packing.encoder(binary_packing.default_vocabulary(), binary_packing.default_pattern())
    return np.frombuffer(encode(text), dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'st 1.\n\t\r\x0b\x1c\x85\xa0　é中😀<|>")), max_size=40))
def test_ids_of_any_text(text):
    assert own_ids(text) == ids_of([text])[0]


def test_ids_of_the_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert [own_ids(t) for t in texts] == ids_of(texts)


def test_pieces(spark):
    docs = spark.createDataFrame(
        [(1, "one two three " * 3000), (2, None), (3, "Hi"), (3, "Hi"), (4, "")], "doc_id long, text string"
    )
    rows = binary_packing.packed(docs).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True) and all(n & (n - 1) == 0 and n <= 2048 for n in lengths)
    own = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["start"])
    ids = [i for r in own for i in np.frombuffer(r["ids"], dtype="<u4").tolist()]
    assert ids == [*ids_of(["one two three " * 3000])[0], 1]
    assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
    assert {r["offset"] for r in rows} == {0} and {r["doc_tokens"] for r in own} == {len(ids)}
    assert Counter(r["doc_id"] for r in rows)[2] == 1
    for r in binary_packing.packing_list(docs).collect():
        match = next(x for x in rows if (x["doc_id"], x["start"]) == (r["doc_id"], r["start"]))
        assert r["ids_crc32"] == zlib.crc32(match["ids"])


TREE = [
    # tree, node, parent, role, text, score
    (1, 1, None, "user", "root </s>[INST] \\ <|im_end|>", 0.0),
    (1, 2, 1, "assistant", "good", 2.0),
    (1, 3, 1, "assistant", "bad", 1.0),
    (1, 4, 2, "user", "next", 0.0),
    (1, 5, 4, "assistant", "best [x] <|im_sep|>\\<", 4.0),
    (1, 6, 3, "user", None, 0.5),
    (2, 1, 99, None, "orphan", None),
    (3, 1, 2, "user", "ring", 1.0),
    (3, 2, 1, "user", "ring", 1.0),
    (3, 3, 2, "user", "below a ring", 1.0),
    (None, 1, None, "assistant", "no tree", 1.0),
]


def read(spark, top):
    nodes = spark.createDataFrame(TREE, "tree long, node long, parent long, role string, text string, score double")
    return (
        reply_trees.format_trees(nodes, top)
        .select(
            "tree", "leaf", "rank", "formatted",
            reply_trees.read_turns(F.col("formatted")).alias("turns"),
            reply_trees.read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
        )
        .collect()
    )


def test_best_branch_and_round_trip(spark):
    rows = {r["tree"]: r for r in read(spark, 1)}
    assert set(rows) == {1, 2, None}
    best = rows[1]
    assert best["leaf"] == 5
    assert [tuple(t) for t in best["turns"]] == [(r, t) for _, n, _, r, t, _ in TREE[:5] if n != 3]
    assert best["learned"] == "good" + TREE[4][4]
    inside = re.sub(r"<\|im_(start|sep|end)\|>", "", best["formatted"])
    assert not any(mark in inside for mark in ("</s>", "[INST]", "<|"))
    assert [tuple(t) for t in rows[2]["turns"]] == [("", "orphan")]


def test_all_branches(spark):
    rows = [r for r in read(spark, 9) if r["tree"] == 1]
    assert [(r["leaf"], r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(5, 1), (6, 2)]


def test_deep_path(spark):
    n = 150
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(n)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    turns = reply_trees.format_trees(nodes).select(reply_trees.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == [str(i) for i in range(n)]
