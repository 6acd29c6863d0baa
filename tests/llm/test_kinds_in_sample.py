"""A hot kind doesn't crowd another out of the sample, and the layout doesn't decide it."""

from __future__ import annotations

from pyspark.sql import functions as F

from procsift.llm import pii_boosting


def test_sample_of_each_kind(spark):
    rows = [(i, f"batch 77{i:05d} is done") for i in range(3000)]
    rows += [(5000 + i, f"write to a{i}@b.org please") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def sample(frame):
        features = pii_boosting.candidate_rows(pii_boosting.proposals(frame))
        return pii_boosting.bounded_sample(features, 400).select("doc_id", "kind", "start", "end", "weight").collect()

    one, other = sample(docs), sample(docs.repartition(5, F.rand(1)))
    assert sum(r["kind"] == "email" for r in one) == 30 and sum(r["kind"] == "phone" for r in one) == 50
    assert sorted(one) == sorted(other)
