"""Every operator and stage on nulls, empty and long texts, repeats, clashing names, and no rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from procsift.llm import (
    binary_packing,
    line_dedup,
    pii_boosting,
    poly_exact,
    qda_quality,
    recurrent_lm,
    reply_trees,
    simhash_index,
    templates,
    token_secrets,
)

SF = "/root/testdata/sf0.001"


def labels(spark, rows=((1, 0), (2, 1), (4, 1), (5, 1), (7, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int")


def benchmark(spark, rows=((0, "ünï çode text and five more words follow here now"), (1, None))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def forms(spark, docs):
    return {
        "contamination": lambda: templates.contamination(docs, benchmark(spark)),
        "lm": lambda: recurrent_lm.scored(docs),
        "quality": lambda: qda_quality.scored(docs, labels(spark)),
        "lines": lambda: line_dedup.drop_shared_lines(docs),
        "secrets": lambda: token_secrets.scan(docs),
        "pii": lambda: pii_boosting.find(docs),
        "simhash": lambda: simhash_index.near_duplicates(docs),
        "one_of_each": lambda: simhash_index.one_of_each(docs),
        "exact": lambda: poly_exact.exact_duplicates(docs),
        "packing": lambda: binary_packing.packed(docs),
        "trees": lambda: reply_trees.format_trees(
            reply_trees.linear_trees(docs.selectExpr("doc_id conv_id", "cast(null as bigint) turn", "row role", "text"))
        ),
    }


NAMES = [
    "contamination", "lm", "quality", "lines", "secrets", "pii", "simhash", "one_of_each", "exact", "packing", "trees",
]
ONE_FOR_EACH_ROW = {"lm", "quality", "lines", "secrets", "pii", "simhash", "exact"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, awkward, name):
    rows = forms(spark, awkward)[name]().collect()
    if name in ONE_FOR_EACH_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in awkward.collect())


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, nothing, name):
    assert forms(spark, nothing)[name]().collect() == []


def test_no_labels_and_no_benchmark(spark, awkward):
    scores = qda_quality.scored(awkward, labels(spark, [(None, None)]).where("false")).collect()
    assert {r["score"] for r in scores} == {0.5}
    assert templates.contamination(awkward, benchmark(spark).where("false")).collect() == []
    assert templates.decontaminated(awkward, benchmark(spark).where("false")).count() == awkward.count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, awkward, nothing, stage):
    for docs in (awkward, nothing):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()


def test_stage_takes_one_of_repeated_rows(spark, awkward):
    kept = corpus_pipeline.near_dedup(spark, awkward, SF).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 6 in ids


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
