"""Every training document reaches the gradient passes of the network."""

from __future__ import annotations

import numpy as np

from procsift.llm import recurrent_lm


def test_every_document_moves_the_weights(spark):
    lexicon = recurrent_lm.Lexicon(
        {b"a": 0, b"b": 1, recurrent_lm.END: 2}, np.log10([11, 6, 3]), np.zeros(3, dtype=int), 3,
        np.array([10.0, 5, 2]), np.zeros(12), np.zeros(12), 17, 3,
    )
    first = recurrent_lm.flat(recurrent_lm.first_weights(lexicon))
    for i in range(4):
        docs = spark.createDataFrame([(i, b"a b a a b")], "doc_id long, text binary")
        assert not np.allclose(recurrent_lm.flat(recurrent_lm.train(docs, lexicon)), first)


def test_rounds_share_out_all_documents(spark):
    docs = spark.range(300).selectExpr("id doc_id", "cast('a b' as binary) text")
    sizes = {r["round"]: r["count"] for r in recurrent_lm.rounds_of(docs).groupBy("round").count().collect()}
    assert set(sizes) == set(range(recurrent_lm.ROUNDS)) and sum(sizes.values()) == 300


def test_texts_taken_apart_once_train_as_before(spark):
    lexicon = recurrent_lm.Lexicon(
        {b"a": 0, b"b": 1, recurrent_lm.END: 2}, np.log10([11, 6, 3]), np.zeros(3, dtype=int), 3,
        np.array([10.0, 5, 2]), np.zeros(12), np.zeros(12), 17, 3,
    )
    texts = ["", "A b a", "a\tq.  b", "b " * 3000, "é a"]
    docs = spark.createDataFrame([(i, False, t.encode()) for i, t in enumerate(texts)], "doc_id bigint, held_out boolean, text binary").coalesce(1)
    kept = recurrent_lm.encoded(docs, lexicon)
    for row in kept.collect():
        want, got = recurrent_lm.encode(texts[row["doc_id"]].encode(), lexicon), recurrent_lm._again(row["ids"])
        assert got.targets.tolist() == want.targets.tolist() and got.inputs.tolist() == want.inputs.tolist()
        assert (row["n_tokens"], row["n_known"], row["base"], row["fixed"]) == (want.n_tokens, want.n_known, want.base, want.fixed)
        assert [bytes(x) for x in row["rare"]] == want.rare
    one, two = (recurrent_lm.flat(recurrent_lm.train(x, lexicon)) for x in (docs.select("doc_id", "text"), kept.select("doc_id", "ids")))
    assert (one == two).all() and not np.allclose(one, recurrent_lm.flat(recurrent_lm.first_weights(lexicon)))


def test_weights_too_large_to_skip_the_scaling():
    rng = np.random.default_rng(4)
    w = {n: (30 * rng.standard_normal(size)).astype(np.float32) for n, size in recurrent_lm.shapes_of_weights().items()}
    states, targets = rng.uniform(-1, 1, (5000, recurrent_lm.HIDDEN)).astype(np.float32), rng.integers(0, 1036, 5000)
    assert not recurrent_lm._safe(w["wc"], w["bc"]) and not recurrent_lm._safe(w["wo"], w["bo"])
    got = recurrent_lm.log_probabilities(w, states, targets)

    def share(x, at):
        return x[at] - x.max() - np.log(np.exp(x - x.max()).sum())

    for i in range(0, 5000, 50):
        group, place = (int(x[0]) for x in recurrent_lm._groups(targets[i : i + 1]))
        parts = [share(states[i].astype(float) @ w["wc"] + w["bc"], group)]
        if place >= 0:
            parts.append(share(states[i].astype(float) @ w["wo"][group] + w["bo"][group], place))
        want = sum(np.log(np.exp(x) + float(recurrent_lm._TINY)) for x in parts)
        assert np.isclose(got[i], want, rtol=1e-3, atol=0.05)
