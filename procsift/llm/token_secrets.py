"""Secret scans: spans by pattern, and random strings by their token efficiency."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsift.llm.binary_packing import default_pattern, default_vocabulary
from procsift.llm.common import text_of

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 8, 16

#: Candidates of the efficiency test.
MIN_RANDOM = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
#: A string with fewer characters than this for each token counts as random.
MAX_RATIO = 2.0
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
#: Numbers with separators, and UUIDs.
FORM = re.compile(r"[0-9/_=+-]+|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words of two letters or more in one case (or capitalised) with short numbers.
#: Possessive, so that nothing is tried twice.
IDENTIFIER = re.compile(
    r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)[0-9]{0,4}+|(?<=[/_=+-])[0-9]{1,4}+|[/_=+-]++)++"
)
#: The words of an identifier, and how many of a word's characters each of its
#: tokens has at least. Random letters of one case have 1.55 to 1.68.
WORD = re.compile(r"[A-Z]?[a-z]{2,}+|[A-Z]{2,}+")
WORD_RATIO = 3.0
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+")

_AS_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_AS_CANDIDATE = bytes(
    99 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256)
)
_HEX_RUN, _CANDIDATE_RUN = b"h" * 32, b"c" * MIN_RANDOM
_WORDS = (b"passw", b"secret", b"token", b"api")

_encodings: dict[tuple[str, str], tiktoken.Encoding] = {}


def _encoding(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    """One vocabulary for each worker process."""
    key = (vocabulary, pattern)
    if key not in _encodings:
        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[key] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[key]


def is_known(candidate: str, encoding: tiktoken.Encoding) -> bool:
    """A digest by its length and alphabet, a UUID, a number, or words with
    separators and short numbers: no secret by itself. A word is what the
    vocabulary has in long tokens; other letters are left to the token test."""
    if _HEX_ONLY.fullmatch(candidate) and len(candidate) in DIGEST_CHARS:
        return True
    if FORM.fullmatch(candidate):
        return True
    return IDENTIFIER.fullmatch(candidate) is not None and all(
        len(word) >= WORD_RATIO * len(encoding.encode_ordinary(word)) for word in WORD.findall(candidate)
    )


def find_spans(data: bytes, encoding: tiktoken.Encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kind as placed in KINDS.

    The byte tests ahead of each pattern can't miss a match of it.
    """
    lower = data.lower()
    assign = any(word in lower for word in _WORDS)
    access = b"AKIA" in data
    hexes = _HEX_RUN in data.translate(_AS_HEX)
    random = _CANDIDATE_RUN in data.translate(_AS_CANDIDATE)
    if not (assign or access or hexes or random):
        return []
    text = data.decode("utf-8", "replace")
    spans = []
    if assign:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if access:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if hexes:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    if random:
        base = iter(spans)
        ahead, found = next(base, None), []
        reach = -1
        for m in CANDIDATE.finditer(text):
            while ahead and ahead[0] < m.end():
                reach, ahead = max(reach, ahead[2]), next(base, None)
            if reach > m.start() or is_known(m[0], encoding):
                continue
            if len(m[0]) < max_ratio * len(encoding.encode_ordinary(m[0])):
                found.append((m.start(), 3, m.end()))
        spans = sorted(spans + found)
    return spans


def scan(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str | None = None,
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """(doc_id, spans) of every row; spans are (kind, start, end) by start,
    then kind, in code points with the end exclusive.

    Kinds assign, access and hex are patterns. Kind random is a run of at least
    20 letters, digits and ``+/_=-`` with fewer than ``max_ratio`` characters
    for each token of the vocabulary: random strings break into short tokens,
    words don't. Digests, UUIDs, numbers and identifiers made of words that the
    vocabulary knows are excluded first, and so is what a base span covers already.

    Null and empty texts have no span. Rows stand for themselves; texts of any
    length are scanned whole, in a pass that is linear in the text.
    ``vocabulary`` is a rank file that every executor can read at that path.
    """
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        )
        for batch in batches:
            texts = batch.column(1)
            found = [
                [
                    {"kind": KINDS[k], "start": a, "end": b}
                    for a, k, b in find_spans(texts[i].as_py(), encoding, max_ratio)
                ]
                for i in range(len(texts))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"]
            )

    return docs.select(
        F.col("doc_id").cast("bigint"), text_of(docs).cast("binary").alias("text")
    ).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mask``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest(spans: list[tuple[str, int, int]]) -> str:
    """Of a list of spans, as the query gives it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
