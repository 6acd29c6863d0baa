"""Path and command-line expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space, plus the four ASCII separators.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def lowered(value: Column) -> Column:
    """Lower-case text, null as empty."""
    return F.lower(F.coalesce(value.cast("string"), F.lit("")))


def stripped(value: Column) -> Column:
    """Text without surrounding white space, null as empty.

    Most values have none, which two one-character looks tell.
    """
    text = F.coalesce(value.cast("string"), F.lit(""))
    blanks = F.lit(WHITESPACE)
    padded = F.contains(blanks, F.left(text, F.lit(1))) | F.contains(blanks, F.right(text, F.lit(1)))
    return F.when(padded, F.btrim(text, blanks)).otherwise(text)


def base_name(path: Column, mode: str = "compat") -> Column:
    """Lower-case last path component; null and blank give ``''``.

    ``compat`` splits only where the text holds a forward slash, so a pure
    backslash path stays whole. ``windows`` always splits on both.
    """
    if mode not in ("compat", "windows"):
        raise ValueError(f"path mode must be 'compat' or 'windows', not {mode!r}")
    text = F.lower(stripped(path))
    last = F.substring_index(F.translate(text, "\\", "/"), "/", -1)
    if mode == "windows":
        return last
    return F.when(F.contains(text, F.lit("/")), last).otherwise(text)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the literal words occurs in ``text``."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def count_contained(text: Column, words: Iterable[str]) -> Column:
    """How many of the distinct words occur in ``text``."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total


def keyword_match(
    text: Column, keywords: Iterable[str], *, literal: bool = False
) -> Column:
    """Case-insensitive regex alternation; ``literal`` escapes the keywords."""
    parts = [re.escape(k) if literal else k for k in keywords]
    return F.coalesce(text.cast("string"), F.lit("")).rlike("(?i)" + "|".join(parts))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens. Splitting on one plain blank needs no
    regular expression, so other white space is turned into blanks first."""
    blank = F.translate(
        F.coalesce(text.cast("string"), F.lit("")), WHITESPACE[1:], " " * (len(WHITESPACE) - 1)
    )
    return F.array_remove(F.split(blank, " "), "")


def token_entropy(text: Column) -> Column:
    """Shannon entropy in bits of the whitespace tokens; 0 without tokens.

    With runs of length c among n tokens the entropy is
    ``log2 n - sum(c log2 c) / n``. Most command lines repeat no token and need
    no more than the first term; for the others the tokens are sorted and
    folded run by run, so the cost stays n log n in the number of tokens.
    """
    zero = F.lit(0.0)
    start = F.struct(
        F.lit("").alias("token"),
        zero.alias("run"),
        zero.alias("weight"),
        zero.alias("tokens"),
        F.lit(0).alias("runs"),
    )

    def close(run: Column) -> Column:
        return F.when(run > 1, run * F.log2(run)).otherwise(zero)

    def step(acc: Column, token: Column) -> Column:
        same = acc["token"] == token
        return F.struct(
            token.alias("token"),
            F.when(same, acc["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, acc["weight"])
            .otherwise(acc["weight"] + close(acc["run"]))
            .alias("weight"),
            (acc["tokens"] + 1.0).alias("tokens"),
            F.when(same, acc["runs"]).otherwise(acc["runs"] + 1).alias("runs"),
        )

    def finish(acc: Column) -> Column:
        n = acc["tokens"]
        bits = F.log2(n) - (acc["weight"] + close(acc["run"])) / n
        return F.when(acc["runs"] > 1, bits).otherwise(zero)

    def entropy(found: Column) -> Column:
        count = F.size(found)
        return (
            F.when(count == 0, zero)
            .when(F.size(F.array_distinct(found)) == count, F.log2(count))
            .otherwise(F.aggregate(F.array_sort(found), start, step, finish))
        )

    # A one-element transform names the token list, which is used four times.
    return F.element_at(F.transform(F.array(tokens(text)), entropy), 1)


def short_command(text: Column, width: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, width)
