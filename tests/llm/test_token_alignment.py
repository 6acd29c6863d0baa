"""Token alignment against a plain walk over byte ranges."""

from __future__ import annotations

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from procsift.llm import token_alignment as ta

TEXTS = [
    None, "", " ", "  ", "a", "The quick brown fox", "tabs\tand\nlines \n\n  spaces ", "▁ mark ▁x", "<|endoftext|> here",
    "</s><s> and <unk> <0x41>", "héé ünï çode \U0001f600\U0001f468‍\U0001f469 here", "x" * 3000, "ab " * 2000,
    " leading", "ﬁ ligature ½", "éclair", " no break", "one\r\ntwo", "日本語のテキスト です", "The quick brown fox",
]


def _byte_table():
    """The byte-level alphabet of A's entries: printable bytes stand for themselves, the rest for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers as P

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table = _byte_table()

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        if not text:
            return None
        spaced = " " + text
        ids_a, ids_b = a.encode(spaced, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [of_b(i) for i in ids_b]
        if b"".join(bytes_a) != spaced.encode() or b"".join(bytes_b) != spaced.encode():
            return None
        return ids_a, ids_b, [len(x) for x in bytes_a], [len(x) for x in bytes_b]

    return both


def walk(ids_a, ids_b, sizes_a, sizes_b):
    """(groups text, links) by two pointers."""
    ranges = []
    for sizes in (sizes_a, sizes_b):
        at, own = 0, []
        for n in sizes:
            own.append((at, at + n))
            at += n
        ranges.append(own)
    ra, rb = ranges
    links, start = [], 0
    for i, (a0, a1) in enumerate(ra):
        while start and rb[start][0] > a0:
            start -= 1
        while rb[start][1] <= a0:
            start += 1
        j = start
        while j < len(rb) and rb[j][0] < a1:
            links.append((ids_a[i], ids_b[j]))
            j += 1
    shared = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, a, b = [], 0, 0
    for end in shared:
        one, other = [], []
        while a < len(ra) and ra[a][1] <= end:
            one.append(str(ids_a[a]))
            a += 1
        while b < len(rb) and rb[b][1] <= end:
            other.append(str(ids_b[b]))
            b += 1
        groups.append(f"{','.join(one)}|{','.join(other)}")
    return groups, links


def brute(both, texts):
    found = [both(t) for t in texts]
    walked = [walk(*f) if f else None for f in found]
    counts = Counter(p for w in walked if w for p in set(w[1]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for f, w in zip(found, walked, strict=True):
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = w
        out.append(
            (
                len(f[0]), len(f[1]), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest(),
            )
        )
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent", [ta.FREQUENT_PAIRS, 20, 0])
def test_awkward_texts(spark, plain, frequent):
    docs = spark.createDataFrame(
        [(i, t, "r", "p", 1) for i, t in enumerate(TEXTS)] + [(None, "the fox", "r", "p", 2)],
        "doc_id bigint, text string, row string, pairs string, n_a int",
    )
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in ta.alignment(docs, frequent).collect()}
    want = brute(plain, [*TEXTS, "the fox"])
    assert [got[i] for i in range(len(TEXTS))] == want[:-1]
    assert got[None] == want[-1]


def test_no_rows(spark):
    assert ta.alignment(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_documents_of_the_smallest_table(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], brute(plain, [r["text"] for r in rows]), strict=True))
    for frequent in (ta.FREQUENT_PAIRS, 300):
        got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in ta.alignment(docs.repartition(5), frequent).collect()}
        assert got == want
    assert sum(w[0] > 0 for w in want.values()) > 100


def _windows(text):
    both = ta.tokens(ta.default_vocabulary(), ta.default_pattern(), ta.default_pieces())
    (a, b), *_ = both.encode([text])
    return both, a, b


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab T,.\n\té日\U0001f600'0")), min_size=1, max_size=60))
def test_windows_put_together_equal_the_whole(text):
    both, a, b = _windows(text)
    if not len(a):
        return
    whole = ta.put_together(a, b, [ta.align(a, b, both.a_sizes, both.b_sizes)])
    memory = ta.Memory(both)
    for _ in range(2):  # the second time from memory
        cut = ta.put_together(a, b, memory.windows(a, b))
        assert (cut.groups_sha256, cut.n_groups, cut.n_links) == (whole.groups_sha256, whole.n_groups, whole.n_links)
        assert cut.pairs.tolist() == whole.pairs.tolist() and cut.times.tolist() == whole.times.tolist()


def test_words_are_windows_of_their_own():
    both, a, b = _windows("The fox and the fox and the fox")
    memory = ta.Memory(both)
    found = memory.windows(a, b)
    assert len(found) == 8
    assert len(memory.known) < 8  # "the", "fox" and "and" come from memory


WORDS = ["the", "fox", "Fox,", "one\ntwo", "é日", "x" * 60, "'s", "▁", "", "\n", "1234.", "\U0001f600'0", "ﬁ", "tab\t"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=12).map(" ".join), max_size=4))
def test_texts_put_together_from_words_equal_the_whole(texts):
    both = ta.tokens(ta.default_vocabulary(), ta.default_pattern(), ta.default_pieces())
    for text, got in zip(texts, both.aligned(texts), strict=True):
        ((a, b),) = both.encode([text])
        whole = ta.put_together(a, b, [ta.align(a, b, both.a_sizes, both.b_sizes)] if len(a) else [])
        assert (got.n_a, got.n_b, got.groups_sha256) == (whole.n_a, whole.n_b, whole.groups_sha256)
        assert (got.n_groups, got.n_links) == (whole.n_groups, whole.n_links)
        assert got.pairs.tolist() == whole.pairs.tolist() and got.times.tolist() == whole.times.tolist()


def test_a_word_is_cut_out_of_its_tokens_once(monkeypatch):
    both = ta.Tokens(ta.default_vocabulary(), ta.default_pattern(), ta.default_pieces())
    seen, real = [], ta.Memory.windows
    monkeypatch.setattr(ta.Memory, "windows", lambda memory, a, b: seen.append(len(a) + len(b)) or real(memory, a, b))
    texts = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["the red fox " * 500 + "ran", "the fox ran", ""]})
    rows = [r for found in ta._aligned_batches([texts], both) for r in found.to_pylist()]
    assert [r["n_a"] for r in rows] == [1501, 3, 0]
    assert sum(seen) < 20  # four words, however often they come
