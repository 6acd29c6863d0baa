"""The trees and the thresholds come from every labelled proposal, also of a hot kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsift.llm import pii_boosting


def labelled(spark, n):
    """``n`` failing phone numbers and a few addresses, as candidate_rows gives them."""
    context = "cast('' as string) before, '' after, true alone"
    hot = spark.range(n).selectExpr(
        "id row", "id doc_id", "xxhash64(id) mark", "'phone' kind", "id start", "id + 7 end",
        "cast(2000000 + id as string) value", *context.split(", "), "0D label",
    )
    mail = spark.range(30).selectExpr(
        "id row", "id doc_id", "xxhash64(id) mark", "'email' kind", "id start", "id + 7 end",
        "concat('a', id, '@b.org') value", *context.split(", "), "1D label",
    )
    return hot.unionAll(mail)


def test_every_proposal_is_learnt_from(spark):
    n = 3 * pii_boosting.MAX_SAMPLE
    known = pii_boosting.vectors(labelled(spark, n))
    sums = {r["label"]: r for r in known.groupBy("label").agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).collect()}
    assert sums[0.0]["n"] == n and sums[1.0]["n"] == 4 * 30
    # A hot kind weighs no more than a bounded number of its proposals.
    assert abs(sums[0.0]["w"] - pii_boosting.KIND_WEIGHT) < 1e-6 and abs(sums[1.0]["w"] - 30) < 1e-6
    assert known.count() < 1000


def test_both_halves_decide_the_thresholds(spark):
    """Every address is judged by trees that did not learn from it."""
    rows = labelled(spark, 200)
    known = pii_boosting.vectors(rows)
    assert {r["fold"] for r in known.where("label = 1").select("fold").distinct().collect()} == {0, 1}
    assert set(pii_boosting.fit(rows).thresholds) == {"email"}
