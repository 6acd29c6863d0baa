"""Cross-tokenizer alignment: windows between shared ends before space-marked tokens, remembered by their ids."""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsift.llm.binary_packing import WORD_CHARS, default_pattern, default_vocabulary
from procsift.llm.common import stored, text_of

#: A window of more tokens isn't remembered. Of windows, and of words, so many are,
#: and as many again of those met before them.
WINDOW_TOKENS, REMEMBERED = 64, 150_000
#: Words that aren't known are encoded so many at a time.
WORDS_AT_ONCE = 64
#: Texts are aligned in blocks of about so many characters.
BLOCK_CHARS = 400_000
#: Pairs whose counts go to every task, at most; the rest are joined.
FREQUENT_PAIRS = 500_000
_B_BITS = 32
_MARK = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """What each piece stands for in a text."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(_MARK, " ").encode())
    return out


class Tokens:
    """Both tokenizers, with the bytes of their tokens, and what a worker remembers."""

    def __init__(self, vocabulary: str, pattern: str, pieces: str) -> None:
        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encode_a = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            a_bytes[i] = entry
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b_bytes = piece_bytes(self.model)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (a_bytes, self.b_bytes))
        self.a_marked, self.b_marked = (np.array([x[:1] == b" " for x in t]) for t in (a_bytes, self.b_bytes))
        # A piece has its mark in front only, but for runs of spaces.
        names = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.by_word = not any(_MARK in name.lstrip(_MARK) for name in names)
        self._words: dict[str, Word] = {}
        self._before: dict[str, Word] = {}
        self.memory = Memory(self)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both, or two empty lists where the tokens' bytes aren't the
        text's. A's vocabulary has every byte, so A's always are."""
        none = np.zeros(0, dtype=np.uint32)
        piece, out = self.b_bytes.__getitem__, []
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1) if texts else [], strict=True):
            spaced = f" {text}"
            if text and b"".join(map(piece, ids)) == spaced.encode():
                out.append((np.array(self._encode_a(spaced), dtype=np.uint32), np.array(ids, dtype=np.uint32)))
            else:
                out.append((none, none))
        return out

    def aligned(self, texts: list[str]) -> list[Aligned]:
        """Texts as their windows put together.

        No token of either side goes on beyond a space before a word, so such
        spaces are anchors and a word's window is the same in every text; words
        come back often and are remembered with theirs. A text with other spaces
        or a word whose tokens don't give it back is encoded as a whole.
        """
        if len(self._words) > REMEMBERED:
            self._before, self._words = self._words, {}
        known, before = self._words, self._before
        split, missing = [], {}
        for text in texts:
            words = text.split(" ") if text and self.by_word else []
            found = list(map(known.get, words))
            gaps = [i for i, word in enumerate(found) if word is None]
            for i in gaps:
                word = words[i]
                held = before.get(word)
                if held is None:
                    missing[word] = None
                else:
                    known[word] = held
            split.append((words, found, gaps))
        fresh = self._learnt(list(missing))
        known.update((word, held) for word, held in fresh.items() if len(word) <= WORD_CHARS)
        out, whole = [], []
        for number, (words, found, gaps) in enumerate(split):
            for i in gaps:
                found[i] = known.get(words[i]) or fresh[words[i]]
            n_a, n_b, groups, numbers, links = zip(*found, strict=True) if found else ((), (), (), (0,), ())
            if 0 in numbers:
                whole.append(number)
                out.append(_NOTHING)
            else:
                out.append(_joined(sum(n_a), sum(n_b), groups, numbers, links))
        for number, (a, b) in zip(whole, self.encode([texts[i] for i in whole]), strict=True):
            out[number] = put_together(a, b, self.memory.windows(a, b) if len(a) else [])
        return out

    def _learnt(self, words: list[str]) -> dict[str, Word]:
        """What is remembered of each word; many are encoded at a time."""
        out = {word: _ODD for word in words if not word or word[0].isspace() or _MARK in word}
        plain = [word for word in words if word not in out]
        parts = [plain[i : i + WORDS_AT_ONCE] for i in range(0, len(plain), WORDS_AT_ONCE)]
        alone = []
        for part, (a, b) in zip(parts, self.encode([" ".join(part) for part in parts]), strict=True):
            windows = self.memory.windows(a, b) if len(a) else []
            sizes_a, sizes_b = _runs(self.a_marked[a]), _runs(self.b_marked[b])
            if len(windows) == len(sizes_a) == len(sizes_b) == len(part):
                out.update(
                    (word, (i, j, *window))
                    for word, i, j, window in zip(part, sizes_a, sizes_b, windows, strict=True)
                )
            else:
                alone += part
        for word, (a, b) in zip(alone, self.encode(alone), strict=True):
            if len(a):
                groups, numbers, links = zip(*self.memory.windows(a, b), strict=True)
                out[word] = (len(a), len(b), ";".join(groups), sum(numbers), b"".join(links))
            else:
                out[word] = _ODD
        return out


def _runs(marked: np.ndarray) -> list[int]:
    """How many tokens there are from each marked one to the next."""
    return np.diff(np.append(np.flatnonzero(marked), len(marked))).tolist()


_tokens: dict[tuple[str, str, str], Tokens] = {}


def tokens(vocabulary: str, pattern: str, pieces: str) -> Tokens:
    """One pair of tokenizers for each worker process."""
    key = (vocabulary, pattern, pieces)
    if key not in _tokens:
        _tokens[key] = Tokens(*key)
    return _tokens[key]


#: The alignment of a run of tokens whose ends both tokenizers share: its groups
#: as text, their number, and a * 2**32 + b of every link as 64-bit numbers.
Window = tuple[str, int, bytes]
#: What is remembered of a word: its numbers of A and B tokens, and its window.
#: A text with an odd word, which has no group, isn't put together from words.
Word = tuple[int, int, str, int, bytes]
_ODD: Word = (0, 0, "", 0, b"")


def align(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Window:
    """Groups between shared ends, and all overlapping pairs of tokens.

    Between two neighbouring ends of either tokenizer lies a part of exactly
    one pair, and every overlapping pair has one such part.
    """
    ends_a, ends_b = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    ends = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    links = (a[at_a].astype(np.int64) << _B_BITS) + b[at_b]
    shared = np.intersect1d(ends_a, ends_b)
    cut_a, cut_b = np.searchsorted(ends_a, shared) + 1, np.searchsorted(ends_b, shared) + 1
    names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups, i, j = [], 0, 0
    for k, m in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
        groups.append(f"{','.join(names_a[i:k])}|{','.join(names_b[j:m])}")
        i, j = k, m
    return ";".join(groups), len(groups), links.astype("<i8").tobytes()


def align_few(a: list[int], b: list[int], a_sizes: list[int], b_sizes: list[int]) -> Window:
    """The same for a few tokens, by a walk along both."""
    links, groups, i, j = [], 1, 0, 0
    text_a, text_b, text = str(a[0]), str(b[0]), ""
    end_a, end_b, last = a_sizes[a[0]], b_sizes[b[0]], len(a) - 1
    while True:
        links.append((a[i] << _B_BITS) + b[j])
        if end_a < end_b:
            i += 1
            end_a += a_sizes[a[i]]
            text_a += f",{a[i]}"
        elif end_b < end_a:
            j += 1
            end_b += b_sizes[b[j]]
            text_b += f",{b[j]}"
        elif i == last:
            return f"{text}{text_a}|{text_b}", groups, array("q", links).tobytes()
        else:
            text += f"{text_a}|{text_b};"
            groups += 1
            i, j = i + 1, j + 1
            end_a += a_sizes[a[i]]
            end_b += b_sizes[b[j]]
            text_a, text_b = str(a[i]), str(b[j])


@dataclass
class Memory:
    """Windows by the ids of both sides."""

    tokens: Tokens
    known: dict[tuple[bytes, bytes], Window] = field(default_factory=dict)
    before: dict[tuple[bytes, bytes], Window] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.a_sizes, self.b_sizes = self.tokens.a_sizes.tolist(), self.tokens.b_sizes.tolist()

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[Window]:
        """The windows of a text, in order.

        Anchors are the places where a token of either side ends and both go on
        with a token that begins with a space.
        """
        t = self.tokens
        starts_a, starts_b = _starts(t.a_sizes[a]), _starts(t.b_sizes[b])
        marked_a, marked_b = np.flatnonzero(t.a_marked[a]), np.flatnonzero(t.b_marked[b])
        there, here = starts_b[marked_b], starts_a[marked_a]
        place = np.searchsorted(there, here)
        place[place == len(there)] = 0
        met = there[place] == here if len(there) else np.zeros(len(here), dtype=bool)
        cut_a, cut_b = marked_a[met], marked_b[place[met]]
        if not len(cut_a) or cut_a[0] or cut_b[0]:
            cut_a, cut_b = np.append(0, cut_a), np.append(0, cut_b)
        raw_a, raw_b, width = a.tobytes(), b.tobytes(), a.itemsize
        edges_a, edges_b = [*(cut_a * width).tolist(), len(raw_a)], [*(cut_b * width).tolist(), len(raw_b)]
        list_a, list_b = a.tolist(), b.tolist()
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        out, known, before, few = [], self.known, self.before, WINDOW_TOKENS * width
        for i, j, k, m in zip(edges_a, edges_a[1:], edges_b, edges_b[1:], strict=False):
            key = (raw_a[i:j], raw_b[k:m])
            found = known.get(key)
            if found is None:
                if j - i + m - k <= few:
                    found = before.get(key) or align_few(
                        list_a[i // width : j // width], list_b[k // width : m // width], self.a_sizes, self.b_sizes
                    )
                    known[key] = found
                else:
                    i, j, k, m = (x // width for x in (i, j, k, m))
                    found = align(a[i:j], b[k:m], t.a_sizes, t.b_sizes)
            out.append(found)
        return out


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@dataclass(frozen=True)
class Aligned:
    """A document: its windows put together."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups_sha256: str
    pairs: np.ndarray  # distinct, rising
    times: np.ndarray


_NOTHING = Aligned(0, 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def put_together(a: np.ndarray, b: np.ndarray, windows: list[Window]) -> Aligned:
    if not len(a):
        return _NOTHING
    groups, numbers, links = zip(*windows, strict=True)
    return _joined(len(a), len(b), groups, numbers, links)


def _joined(n_a: int, n_b: int, groups: Sequence[str], numbers: Sequence[int], links: Sequence[bytes]) -> Aligned:
    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
    every = np.frombuffer(b"".join(links), dtype="<i8")
    pairs, times = np.unique(every, return_counts=True)
    return Aligned(n_a, n_b, sum(numbers), len(every), digest, pairs, times)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars > BLOCK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<int>"
)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind))


def aligned(
    docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, pieces: str | None = None
) -> DataFrame:
    """One row for each document: counts, the digest of its groups, its linked id pairs and how often each occurs.

    ``pairs`` holds a * 2**32 + b, ``times`` the number of links, in the same
    order. The tokenizers' files are read by every executor at those paths.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    pieces = pieces or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens(vocabulary, pattern, pieces)
        gc.disable()  # what is remembered has no cycles, and is much to look through
        try:
            yield from _aligned_batches(batches, both)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("bigint"), text_of(docs).alias("text")).mapInArrow(run, _ALIGNED)


def _aligned_batches(batches: Iterator[pa.RecordBatch], both: Tokens) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for start, end in _blocks(texts):
            found = both.aligned(texts[start:end])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, end - start),
                    *[
                        pa.array([getattr(f, n) for f in found], pa.int64())
                        for n in ("n_a", "n_b", "n_groups", "n_links")
                    ],
                    pa.array([f.groups_sha256 for f in found], pa.string()),
                    _lists([f.pairs for f in found], pa.int64()),
                    _lists([f.times for f in found], pa.int32()),
                ],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each id pair linked."""
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs and counts of the frequent, by pair, and the least step of a frequent count.

    The bound is the lowest that at most ``most`` pairs reach, on a grid of
    eight steps for each doubling.
    """
    step = _step()
    least, total = None, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1 << 30
    rows = counts.where(step >= least).toPandas().sort_values("pair")
    return rows["pair"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64), least


def _step():
    return F.floor(F.log2("n") * 8).cast("int")


def alignment(docs: DataFrame, frequent: int = FREQUENT_PAIRS, **files: str | None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Both tokenizers encode the whole text, A with a space before it as B adds
    one. Places where both end and both go on with a space-marked token cut the
    text into windows; a window's groups and links follow from its ids alone
    and are remembered by them. A pair's count is the number of rows that hold
    it linked; n_best counts the links whose count is the highest of their A
    id, count_sum adds the counts of all links.

    The counts of at most ``frequent`` pairs go to the tasks, with the highest
    count of each A id, which the vocabulary bounds; rarer pairs meet their
    counts in a join. Texts that are null, empty, or that the tokens don't give
    back byte by byte have no tokens. Rows that repeat a doc_id count each.
    """
    spark = docs.sparkSession
    found = stored(aligned(docs, **files).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(found), "pair-counts")
    pairs, numbers, least = _frequent(counts, frequent)
    best_rows = counts.groupBy(F.shiftright("pair", _B_BITS).alias("a")).agg(F.max("n").alias("n")).toPandas()
    best = np.zeros(int(best_rows["a"].max()) + 1 if len(best_rows) else 1, dtype=np.int64)
    best[best_rows["a"].to_numpy(dtype=np.int64)] = best_rows["n"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast((pairs, numbers, numbers == best[pairs >> _B_BITS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, top = shared.value
        for batch in batches:
            own, times = batch.column(1), batch.column(2)
            sizes = np.diff(own.offsets.to_numpy())
            own, times = own.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.searchsorted(known, own)
            place[place == len(known)] = 0
            met = known[place] == own if len(known) else np.zeros(len(own), dtype=bool)
            gain, lead = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(gain, doc[met], n[place[met]] * times[met])
            np.add.at(lead, doc[met], top[place[met]] * times[met])
            rest = np.append(0, np.cumsum(np.bincount(doc[~met], minlength=batch.num_rows)))
            rare = [pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(x[~met])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lead), pa.array(gain), *rare],
                names=["_row", "lead", "gain", "pairs", "times"],
            )

    scored = stored(
        found.select("row", "pairs", "times").mapInArrow(
            run, "_row bigint, lead bigint, gain bigint, pairs array<bigint>, times array<bigint>"
        ),
        "alignment-frequent",
    )
    tops = F.broadcast(
        counts.groupBy(F.shiftright("pair", _B_BITS).alias("a")).agg(F.max("n").alias("top"))
    )  # a row for each id of A at most
    rare = (
        scored.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
        .select("_row", "p.pairs", "p.times")
        .join(counts.where(_step() < least).withColumnRenamed("pair", "pairs"), "pairs")
        .join(tops, F.shiftright("pairs", _B_BITS) == F.col("a"))
        .groupBy(F.col("_row").alias("_rare"))
        .agg(
            F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_lead"),
            F.sum(F.col("n") * F.col("times")).alias("more_gain"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return (
        found.drop("pairs", "times")
        .join(scored.select("_row", "lead", "gain"), F.col("row") == F.col("_row"))
        .join(rare, F.col("row") == F.col("_rare"), "left")
        .select(
            "doc_id",
            "n_a",
            "n_b",
            "n_groups",
            "n_links",
            (F.col("lead") + F.coalesce("more_lead", zero)).alias("n_best"),
            (F.col("gain") + F.coalesce("more_gain", zero)).alias("count_sum"),
            "groups_sha256",
        )
    )
