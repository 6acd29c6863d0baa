"""Rows that match no id stay out of a join, and none that matches is lost."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsift.llm.common import sieve


def test_every_id_passes_and_few_others(spark):
    docs = spark.range(-4000, 40_000).selectExpr("id doc_id", "cast(id as string) text", "id _block")
    ids = spark.range(-4000, 40_000, 10).withColumnRenamed("id", "away")
    likely, surely = sieve(ids, "away").parted(docs, "doc_id")
    assert likely.columns == surely.columns == docs.columns
    passed, others = ({r["doc_id"] for r in df.select("doc_id").collect()} for df in (likely, surely))
    assert {r["away"] for r in ids.collect()} <= passed
    assert not passed & others and len(passed) + len(others) == 44_000
    assert len(passed) < 4400 + 0.1 * 39_600


def test_repeated_and_absent_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "doc_id int, text string")
    for wanted in ([], [1]):
        ids = spark.createDataFrame([(i,) for i in wanted], "away long")
        likely, surely = sieve(ids, "away").parted(docs, "doc_id")
        assert likely.count() + surely.count() == 5
        assert likely.where(F.col("doc_id") == 1).count() == 2 * len(wanted)
