"""Random strings of one case are secrets too, with or without a digit in the document."""

from __future__ import annotations

import random
import string

import pytest

from procsift.llm import token_secrets

ALPHABETS = {
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "base36": string.ascii_lowercase + string.digits,
}


def found(text):
    encoding = token_secrets._encoding(token_secrets.default_vocabulary(), token_secrets.default_pattern())
    return [text[a:b] for a, k, b in token_secrets.find_spans(text.encode(), encoding) if token_secrets.KINDS[k] == "random"]


@pytest.mark.parametrize("name", ALPHABETS)
@pytest.mark.parametrize("length", [20, 32, 44])
def test_random_strings_of_one_case(name, length):
    rng = random.Random(length)
    encoding = token_secrets._encoding(token_secrets.default_vocabulary(), token_secrets.default_pattern())
    texts = ["".join(rng.choices(ALPHABETS[name], k=length)) for _ in range(200)]
    low = [t for t in texts if length < token_secrets.MAX_RATIO * len(encoding.encode_ordinary(t))]
    missed = [t for t in low if found(f"see {t} there") != [t]]
    assert len(low) > 150 and not missed


def test_words_stay():
    for known in ("internationalization_settings", "the/quick/brown/fox/jumps2", "getCurrentUserAccountSettings"):
        assert found(f"see {known} there") == []
