"""Classes of benchmark items, and matches against a plain matcher."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from procsift.llm import templates
from procsift.llm.templates import MIN_LITERALS, NAME, NUMBER, RUN_WORDS, UNIT, WHOLE_LITERALS, WINDOW


def test_one_row_for_each_document_of_a_class(spark):
    draw = random.Random(1)
    text = "Anna has {} apples and buys {} more before she gives {} of them away"
    items = [(i, text.format(*(draw.randrange(100, 999) for _ in range(3)))) for i in range(40)]
    docs = [(i, "Well then. " + text.format(*(draw.randrange(1000, 9999) for _ in range(3))) + ".") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    rows = templates.contamination(docs, items).collect()
    assert len(rows) == 40
    assert {(r["item_id"], r["n_items"], r["coverage"]) for r in rows} == {(0, 40, 1.0)}
    members = templates.template_members(items).collect()
    assert len(members) == 40 and len({r["template"] for r in members}) == 1


def test_equal_slots_make_another_class(spark):
    texts = [
        "take 5 apples and then 5 pears and then go home", "take 7 apples and then 7 pears and then go home",
        "take 7 apples and then 8 pears and then go home", "take 7 apples and then 8 pears and then go home",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(1, "take 2 apples and then 2 pears and then go home")], "doc_id long, text string")
    rows = {r["item_id"]: r["n_items"] for r in templates.contamination(docs, items).collect()}
    # Unequal slots of an item may have equal values in a document, not the other way round.
    assert rows == {0: 2, 2: 2}


def test_items_of_few_literals_need_their_own_values(spark):
    items = [(i, f"add {i} 5 7 {i + 1} 9 {i + 2}") for i in range(100, 160)]
    docs = [(1, "so add 107 5 7 108 9 109 now"), (2, "so add 999 5 7 998 9 997 now"), (3, items[3][1]), (4, items[3][1])]
    rows = templates.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_items"]) for r in rows) == [(1, 107, 1), (3, 103, 1), (4, 103, 1)]


def test_short_items_by_parameter(spark):
    items = spark.createDataFrame([(1, "Name Pi to 5"), (2, "7 9")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "please name pi to 5"), (2, "here 7 9"), (3, "here 7 8")], "doc_id long, text string")
    assert templates.contamination(docs, items).collect() == []
    got = {(r["doc_id"], r["item_id"]) for r in templates.contamination(docs, items, min_words=1).collect()}
    assert (2, 2) in got and (3, 2) not in got


def _canonical(spark, rows):
    frame = spark.createDataFrame(rows, "key long, text string")
    found = templates.with_slots(templates.with_template(frame, "key"), "key").collect()
    return {r["key"]: (r["words"], {s["pos"]: s["value"] for s in r["slots"]}) for r in found}


def matched(doc, item):
    """Whether a text holds an item, window by window, in plain Python."""
    (dw, ds), (iw, isl) = doc, item
    if len(iw) < templates.MIN_WORDS:
        return False
    length = min(WINDOW, len(iw))
    literal = lambda w: w not in (NUMBER, NAME, UNIT)
    by_shift = defaultdict(list)
    for p in range(len(iw) - length + 1):
        for q in range(len(dw) - length + 1):
            if iw[p : p + length] == dw[q : q + length]:
                by_shift[q - p].append(p)
    n, covered, aligned = len(iw) - length + 1, set(), 0
    for shift, places in by_shift.items():
        slots = sorted({s for p in places for s in isl if p <= s < p + length})
        pairs = {(isl[s], ds[s + shift]) for s in slots}
        if len(pairs) != len({a for a, _ in pairs}):
            continue
        strong = any(sum(map(literal, iw[p : p + length])) >= min(MIN_LITERALS, length) for p in places)
        whole = len(places) == n and sum(map(literal, iw)) >= WHOLE_LITERALS
        if strong or whole or all(a == b for a, b in pairs):
            covered |= set(places)
            aligned = max(aligned, len(places))
    return len(covered) >= 0.5 * n and bool(covered) or aligned > RUN_WORDS - WINDOW


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_matcher(spark, seed):
    draw = random.Random(seed)
    words = ["add", "the", "10", "7", "7", "then", "km", "Maria", "Olga", "go", "home", "old", "12.5", "of"]
    phrase = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, phrase(draw.choice([4, 5, 6, 8, 9, 14, 20]))) for i in range(60)]
    docs = []
    for i in range(60):
        own = draw.choice(items)[1].split()
        changed = [draw.choice(["10", "7", "3"]) if w[0].isdigit() and draw.random() < 0.3 else w for w in own]
        docs.append((i, f"x {phrase(draw.randrange(6))} , {' '.join(changed[draw.randrange(3):])} . {phrase(3)}"))
    canon_items, canon_docs = _canonical(spark, items), _canonical(spark, docs)
    want = {(d, i) for d in canon_docs for i in canon_items if matched(canon_docs[d], canon_items[i])}
    frames = [spark.createDataFrame(r, f"{n} long, text string") for r, n in ((docs, "doc_id"), (items, "item_id"))]
    rows = templates.contamination(*frames).collect()
    assert {r["doc_id"] for r in rows} == {d for d, _ in want}
    assert {(r["doc_id"], r["item_id"]) for r in rows} <= want and len(want) > 10
    # Every match is of an item that its class row counts.
    counted = defaultdict(int)
    for r in rows:
        counted[r["doc_id"]] += r["n_items"]
    for d in counted:
        assert counted[d] >= sum(x == d for x, _ in want)
