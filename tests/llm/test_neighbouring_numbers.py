"""Numbers that stand side by side are proposed one by one."""

from __future__ import annotations

from procsift.llm import pii_boosting


def test_neighbours_are_proposed(spark):
    texts = [
        "call 243-555-9999 555-123-4567",
        "cards 4539 1488 0343 6467 4539-1488-0343-6468",
        "é tel +1 (243) 555-5526 (243) 555-9999!",
        "1 " * 400,
    ]
    wanted = [{"243-555-9999", "555-123-4567"}, {"4539 1488 0343 6467", "4539-1488-0343-6468"},
              {"+1 (243) 555-5526", "(243) 555-9999"}, set()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_boosting.proposals(docs).collect():
        text, found = texts[r["doc_id"]], r["candidates"]
        for c in found:
            m = c["match"]
            assert text[m["start"] : m["end"]] == m["value"]
            assert text[: m["start"]].endswith(m["before"]) and m["after"] == text[m["end"] : m["end"] + 1]
        assert wanted[r["doc_id"]] <= {c["match"]["value"] for c in found}
