"""Scalar expressions against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from procsift.functions.ids import hex_id, numeric_id
from procsift.functions.text import base_name, keyword_match, token_entropy
from procsift.functions.times import from_epoch_millis, from_epoch_seconds, parse_utc, seconds_between
from procsift.functions.topk import top_features


def values(spark, inputs, expression, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.select(expression(F.col("x")), "i").orderBy("i").collect()]


def test_hex_ids(spark):
    got = values(
        spark,
        ["0x3e8", "0X3E8", " 0x1f4 ", "1000", "+7", "", None, "0xZZ", "abc", "100.0",
         "0x0000000000000004", "0x7fffffffffffffff", "0xffffffffffffffff"],
        hex_id,
    )
    assert got == [1000, 1000, 500, 1000, 7, None, None, None, None, None, 4, 2**63 - 1, None]


def test_numeric_ids(spark):
    got = values(spark, ["100", " 100 ", "100.0", "1e2", "100.5", "x", "", None, "9" * 30], numeric_id)
    assert got == [100, 100, 100, 100, None, None, None, None, None]


def test_base_names(spark):
    paths = [None, "  ", "CMD.exe", r"C:\Windows\CMD.exe", r"C:\a/B.EXE", "a/", "/x/Y.exe ", "\u00a0q\u00a0"]
    assert values(spark, paths, base_name) == [
        "", "", "cmd.exe", r"c:\windows\cmd.exe", "b.exe", "", "y.exe", "q",
    ]
    windows = values(spark, paths, lambda c: base_name(c, "windows"))
    assert windows[3:5] == ["cmd.exe", "b.exe"]
    with pytest.raises(ValueError):
        base_name(F.col("x"), "other")


def plain_entropy(text):
    tokens = re.split(r"\s+", (text or "").strip()) if (text or "").strip() else []
    return -sum(c / len(tokens) * math.log2(c / len(tokens)) for c in Counter(tokens).values()) + 0.0


def test_token_entropy(spark):
    texts = ["", None, "   ", "one", "a a a a", "a b c d", "a a b b c d e f", "a\tb\u00a0c\u2003a\nb",
             "A a", " x  y   x ", "w " * 1000 + "v", " ".join(f"t{i % 37}" for i in range(5000))]
    got = values(spark, texts, token_entropy)
    assert got == pytest.approx([plain_entropy(t) for t in texts])
    assert all(math.copysign(1, g) > 0 for g in got)
    assert got[5] == 2.0 and got[6] == 2.5


def test_times(spark):
    def text(column):
        return column.cast("string")

    got = values(spark, ["1658910730.111", "1658910730", "x", "1e300", None, "0"],
                 lambda c: text(from_epoch_seconds(c)))
    assert got == ["2022-07-27 08:32:10.111", "2022-07-27 08:32:10", None, None, None, "1970-01-01 00:00:00"]
    assert values(spark, ["1658910730111"], lambda c: text(from_epoch_millis(c))) == [
        "2022-07-27 08:32:10.111"
    ]
    stamps = ["2022-07-27T08:31:21.1234567Z", "2022-07-27 08:31:21.123", "2022-07-27T10:31:21+02:00",
              "2024-01-01", "not a date", None]
    want = ["2022-07-27 08:31:21.123456", "2022-07-27 08:31:21.123", "2022-07-27 08:31:21",
            "2024-01-01 00:00:00", None, None]
    assert values(spark, stamps, lambda c: text(parse_utc(c))) == want
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert values(spark, stamps, lambda c: text(parse_utc(c))) == want
        gap = spark.sql(
            "select timestamp_ntz'2024-03-10 01:00:00' a, timestamp_ntz'2024-03-10 03:30:00.5' b"
        )
        both = gap.select(seconds_between(F.col("b"), F.col("a")), seconds_between(F.col("a"), F.col("b")))
        assert tuple(both.first()) == (9000.5, -9000.5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_keywords_are_a_regex_unless_literal(spark):
    assert values(spark, ["a.b", "axb", None], lambda c: keyword_match(c, ["A.B"])) == [True, True, False]
    assert values(spark, ["a.b", "axb"], lambda c: keyword_match(c, ["a.b"], literal=True)) == [True, False]


def test_top_features(spark):
    def suffix(row, names, k=3):
        return values(spark, [row], lambda c: top_features(c, names, k), "array<double>")[0]

    assert suffix([0.01, -0.5, 0.3], ["a", "b", "c"], 2) == " | Top features: b (-0.50), c (+0.30)"
    assert suffix([0.0, 0.0, 0.0], ["a", "b", "c"]) == ""
    assert suffix([1.0], ["a", "b"]) == ""
    assert suffix(None, ["a"]) == ""
    assert suffix([float("nan"), 2.0, None], ["a", "b", "c"]) == " | Top features: b (+2.00)"
    assert suffix([0.5, -0.5, 1e-12], ["a", "b", "c"]) == " | Top features: a (+0.50), b (-0.50)"
    # The cut to k comes first, tiny values go afterwards.
    assert suffix([1e-12, 1e-13], ["a", "b"], 1) == ""
