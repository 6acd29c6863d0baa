"""Benchmark items that are mostly numbers, and rows that repeat an item."""

from __future__ import annotations

import pytest

from procsift.llm import templates

ITEMS = [
    "What is 12 plus 34?",
    "Solve 3x + 5 = 20 for x.",
    "Compute 17 * 24 - 9 + 6 now please.",
    "Find the sum of 3, 5, 7, 9 and 11.",
]
OTHER_NUMBERS = [
    "What is 56 plus 71?",
    "Solve 8x + 2 = 90 for x.",
    "Compute 31 * 42 - 8 + 5 now please.",
    "Find the sum of 2, 4, 6, 8 and 10.",
]


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in templates.contamination(docs, bench).collect()}


@pytest.mark.parametrize("copies", [ITEMS, OTHER_NUMBERS])
def test_items_of_numbers(spark, copies):
    texts = [f"Here it goes. {c} That was all." for c in copies]
    assert found(spark, texts, list(enumerate(ITEMS))) == {(i, i) for i in range(len(ITEMS))}


def test_rows_of_numbers_alone_need_the_same_numbers(spark):
    texts = ["table: 1 2 3 4 5 6 7 8 9 10", "table: 21 22 23 24 25 26 27 28 29 30"]
    assert found(spark, texts, [(0, "1 2 3 4 5 6 7 8 9 10")]) == {(0, 0)}


def test_repeated_rows_of_an_item_count_once(spark):
    item = "the quick brown fox jumps over a lazy dog"
    texts = [f"so: {item}, yes", "nothing of the kind is here at all today"]
    assert found(spark, texts, [(7, item)] * 3) == {(0, 7)}
    other = "every good text of this item id says something else entirely today"
    assert found(spark, [*texts, other], [(7, item), (7, item), (7, other)]) == {(0, 7), (2, 7)}
