"""What the trees add: forms that no base pattern knows, and nothing of other numbers."""

from __future__ import annotations

import random

import regex
import pytest

from procsift.llm import pii_boosting
from procsift.llm.pii_boosting import MOST_DIGITS, NUMBER, WRITTEN_EMAIL


def card(draw):
    digits = [4] + [draw.randrange(10) for _ in range(14)]
    total = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits))
    digits.append(-total % 10)
    text = "".join(map(str, digits))
    return [text[i : i + 4] for i in range(0, 16, 4)]


def sentences(draw, i):
    """Base forms, looser ones, and numbers that are neither."""
    area, last = draw.randrange(200, 999), draw.randrange(10_000)
    user = "".join(draw.choice("abcdefgh") for _ in range(6))
    plain = [
        f"please call my phone +1 {area} 555 {last:04d} today",
        f"reach us by phone +49 30 {area}{last:04d} or mail",
        f"write to {user}@mail{i}.example.org please",
        f"my card {'-'.join(card(draw))} is new",
        f"the card {' '.join(card(draw))} was lost",
        f"batch 77{last:05d} is done",
        f"order {draw.randrange(10**10, 10**11)} was sent with parcel {draw.randrange(10**11, 10**12)}",
        f"sums of {area} {last} 20 17 44 {area} add up",
        f"server {draw.randrange(256)}.{draw.randrange(256)}.4.{draw.randrange(256)} is up",
    ]
    loose = {
        "email": (f"write to ", f"{user} (at) mail{i} (dot) example (dot) org", " please"),
        "phone": ("call my phone ", f"({area}) 555-{last:04d}", " today"),
        "card": ("my card ", ".".join(card(draw)), " is new"),
    }
    return plain, loose


@pytest.fixture(scope="module")
def judged(spark):
    draw, texts, wanted = random.Random(3), {}, {}
    for i in range(240):
        plain, loose = sentences(draw, i)
        texts[10 * i] = ". ".join(draw.sample(plain, 4))
        if i < 60:
            for k, (kind, (before, span, after)) in enumerate(loose.items(), 1):
                texts[10 * i + k] = f"{before}{span}{after}"
                wanted[10 * i + k] = (kind, len(before), len(before) + len(span))
        texts[10 * i + 5] = f"batch {draw.randrange(10**10, 10**11)} is done"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii_boosting.find(docs).collect()}
    added = {
        i: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} - {(s["kind"], s["start"], s["end"]) for s in r["base"]}
        for i, r in rows.items()
    }
    return texts, wanted, added


def test_looser_forms_are_found(judged):
    texts, wanted, added = judged
    for kind in ("email", "phone", "card"):
        own = [i for i, w in wanted.items() if w[0] == kind]
        hit = sum(wanted[i] in added[i] for i in own)
        assert hit >= 0.9 * len(own), (kind, hit, len(own))
    every = sum(map(len, added.values()))
    right = sum(wanted.get(i) in spans for i, spans in added.items())
    assert right >= 0.95 * every, [(texts[i], s) for i, s in added.items() if s and wanted.get(i) not in s][:5]


def test_other_numbers_stay(judged):
    texts, _, added = judged
    assert not [texts[i] for i, spans in added.items() if i % 10 == 5 and spans]


def number_runs(text):
    for m in regex.finditer(NUMBER, text):
        groups = [(g.start(), g.end()) for g in regex.finditer("[0-9]+", m.group())]
        for i in range(len(groups)):
            lead = 0
            start = groups[i][0]
            if i == 0:
                lead = start
            elif m.group()[start - 1 : start] == "(":
                lead = 1
            for k in range(i, min(len(groups), i + MOST_DIGITS)):
                value = m.group()[start - lead : groups[k][1]]
                if 7 <= sum(c.isdigit() for c in value) <= MOST_DIGITS:
                    yield m.start() + start - lead, m.start() + groups[k][1], value


def test_proposals_against_brute_force(spark):
    draw = random.Random(9)
    texts = [
        "".join(draw.choice("0123456789  ()-.+@a") for _ in range(draw.randrange(60))) for _ in range(150)
    ] + ["a (at) b (dot) co or x@y.org, 1.2.3.4 +1 (243) 555-5526"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_boosting.proposals(docs).collect():
        text = texts[r["doc_id"]]
        got = {(c["kind"], c["match"]["start"], c["match"]["end"]) for c in r["candidates"] if c["kind"] != "ip"}
        want = set()
        for start, end, value in number_runs(text):
            digits = sum(c.isdigit() for c in value)
            want |= {("card", start, end)} if digits >= 13 else set()
            want |= {("phone", start, end)} if digits <= 15 else set()
        want |= {("email", m.start(), m.end()) for m in regex.finditer(WRITTEN_EMAIL, text)}
        assert got == want, text
