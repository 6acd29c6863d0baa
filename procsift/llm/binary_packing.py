"""Packing by power-of-two decomposition: no sequence crosses documents."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procsift.llm.common import slices, stored, text_of

MAX_LENGTH = 2048
END_ID = 1
#: Words longer than this aren't remembered, and at most so many words are.
WORD_CHARS, WORDS = 48, 400_000

#: A space that doesn't begin a word: such texts are encoded whole.
_ODD_SPACE = re.compile(r" (?=\s|\Z)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class WordEncoder:
    """Encodes texts with a byte-level BPE of ranks, word by word.

    The pattern never joins what stands on both sides of a space before a word,
    so a text's ids are those of its words put together; words come back often
    and are remembered. Ids are little-endian unsigned 32-bit numbers.
    """

    def __init__(self, vocabulary: str, pattern: str) -> None:
        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encode = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._ids(text)
        head, *words = text.split(" ")
        known = self._words
        found = list(map(known.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    ids = known.get(word)
                    if ids is None:
                        ids = self._ids(f" {word}")
                        if len(word) <= WORD_CHARS:
                            if len(known) >= WORDS:
                                known.clear()
                            known[word] = ids
                    found[i] = ids
        return self._ids(head) + b"".join(found)


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(vocabulary: str, pattern: str) -> WordEncoder:
    """One encoder for each worker process."""
    if (vocabulary, pattern) not in _encoders:
        _encoders[vocabulary, pattern] = WordEncoder(vocabulary, pattern)
    return _encoders[vocabulary, pattern]


def binary_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """The powers of two, falling and none over ``most``, that add up to n."""
    lengths = [most] * (n // most)
    rest = n % most
    while rest:
        lengths.append(1 << (rest.bit_length() - 1))
        rest -= lengths[-1]
    return lengths


def pieces(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str | None = None,
    max_length: int = MAX_LENGTH,
    end_id: int = END_ID,
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) of every piece of every row.

    A document is its ids and then ``end_id``; it is cut into pieces of binary
    length, the largest first, so each id lies in exactly one. ``ids`` is
    little-endian unsigned 32-bit numbers. ``max_length`` is a power of two.
    Null and empty texts have one piece, the end.

    ``vocabulary`` is a rank file that every executor can read at that path.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        for batch in slices(batches):
            texts, owner, starts, lengths, totals, ids = batch.column(1), [], [], [], [], []
            for row in range(len(texts)):
                data = encode(texts[row].as_py()) + end
                start, total = 0, len(data) // 4
                for length in binary_lengths(total, max_length):
                    owner.append(row)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(total)
                    ids.append(data[4 * start : 4 * (start + length)])
                    start += length
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_of(docs).alias("text")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
    )


def sequences(cut: DataFrame) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces.

    Every piece is a sequence of its own; a sequence's length is a power of two
    and needs no padding. Ids are dense from 0, longest sequences first, then by
    doc_id and start, so each bucket of equal lengths is one range of ids and
    the numbers don't depend on how the table lies in files. Equal rows
    (repeats of a document) share their range in any order. A sorted table is
    written once; only the number of rows of each of its parts is added up.
    """
    cut = stored(cut, "pieces")
    order = [F.col("length").desc(), F.col("doc_id"), F.col("start")]
    placed = stored(
        cut.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "sequences",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    )
    return (
        placed.join(F.broadcast(bases), "_part")  # a row for each part of one table
        .withColumn("sequence_id", F.col("_base") + F.col("_at"))
        .withColumn("offset", F.lit(0).cast("bigint"))
        .drop("_part", "_at", "_base")
    )


def packed(docs: DataFrame, **options: object) -> DataFrame:
    """Pieces with their ids and sequences: the packed corpus."""
    return sequences(pieces(docs, **options))


def packing_list(docs: DataFrame, **options: object) -> DataFrame:
    """What is packed where, with a checksum in the place of the ids."""
    cut = pieces(docs, **options)
    return sequences(
        cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    )
