"""Steps in Python have few rows of a batch in hand, whatever Spark's batches hold."""

from __future__ import annotations

import pyarrow as pa
import pytest

from procsift.llm import binary_packing, common, near_copies


@pytest.mark.parametrize(
    "step", [binary_packing.pieces, near_copies._signatures, near_copies._sets], ids=["pieces", "signatures", "sets"]
)
def test_a_large_batch_comes_back_in_small_ones(spark, monkeypatch, step):
    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    steps, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: (steps.append(run), real(df, run, schema))[1])
    step(docs)
    kind = pa.string() if step is binary_packing.pieces else pa.binary()
    texts = pa.array([f"word {i} and some more of them" for i in range(1000)]).cast(kind)
    read = []

    def batches():
        for part in common.slices(iter([whole])):
            read.append(part.num_rows)
            yield part

    whole = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), texts], names=["doc_id", "text"])
    got = list(steps[0](iter([whole])))
    assert max(b.num_rows for b in got) <= 6 * common.SLICE_ROWS and len(got) > 1
    assert [b.to_pylist() for b in got] == [b.to_pylist() for x in batches() for b in steps[0](iter([x]))]
    assert sum(read) == 1000
