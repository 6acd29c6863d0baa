"""Runs of names and numbers that are longer than a thread's stack is deep."""

from __future__ import annotations

from procsift.llm import templates
from procsift.llm.templates import NAME, NUMBER

NAMES, NUMBERS = " Anna Marie" * 20_000, "7" + ",1/2:3" * 20_000


def test_a_run_is_one_slot(spark):
    rows = [(1, f"then{NAMES} went home"), (2, f"it has {NUMBERS} in it"), (3, "von Anna, Otto Ab. Cd 1,2 3. 4,")]
    frame = spark.createDataFrame(rows, "key long, text string")
    found = templates.with_slots(templates.with_template(frame, "key"), "key").collect()
    got = {r["key"]: (r["words"], [(s["pos"], s["value"]) for s in r["slots"]]) for r in found}
    assert got[1] == (["then", NAME, "went", "home"], [(1, NAMES.strip().lower())])
    assert got[2] == (["it", "has", NUMBER, "in", "it"], [(2, NUMBERS)])
    words = ["von", NAME, NAME, "cd", NUMBER, NUMBER, NUMBER]
    assert got[3] == (words, [(1, "anna"), (2, "otto ab"), (4, "1,2"), (5, "3"), (6, "4")])


def test_items_beside_a_run_are_found(spark):
    item = "Which of the rivers in the north has seven bridges today"
    docs = spark.createDataFrame([(1, f"von{NAMES}. {item}"), (2, f"von{NAMES}. {NUMBERS}")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in templates.contamination(docs, items).collect()] == [(1, 5)]
