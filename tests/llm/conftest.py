"""A session and awkward tables for the llm operators."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, row string, key string, spans string, _gone string, n_lines int"


def awkward_rows():
    """Nulls, empty and very long texts, repeated rows, and columns with the operators' own names."""
    long = "lorem ipsum dolor sit amet consectetur " * 4000
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t"),
        (4, "One shared line of some length.\nAnd an own line"),
        (5, "ONE SHARED LINE OF SOME LENGTH. \nanother own line"),
        (6, "\tone shared line of some length.\none shared line of some length."),
        (6, "\tone shared line of some length.\none shared line of some length."),
        (7, long),
        (8, long + "x"),
        (9, "héé ünï çode text \U0001f600 here"),
        (None, "a row without an id"),
        (None, None),
        (10, "word"),
    ]
    return [(a, b, "r", "k", "s", "g", 3) for a, b in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
