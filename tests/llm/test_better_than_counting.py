"""The network's training helps, on tables of any size and layout."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from procsift.llm import recurrent_lm


@pytest.mark.parametrize(("sf", "parts"), [("sf0.001", 4), ("sf0.01", 1), ("sf0.01", 13)])
def test_scores_beat_the_unigram(spark, sf, parts):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").repartition(parts)
    rows = recurrent_lm.scored(docs)
    gains = {
        r["held_out"]: (r["gain"], r["n"])
        for r in rows.groupBy("held_out").agg(F.sum(F.col("score") - F.col("base_score")).alias("gain"), F.sum("n_tokens").alias("n")).collect()
    }
    print(sf, parts, gains)
    assert gains[True][0] > 0 and gains[False][0] > 0
    if parts == 1 and sf == "sf0.01":  # tasks that have more than a few steps each
        assert gains[True][0] > 0.05 * gains[True][1]
