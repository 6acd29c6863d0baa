"""PII by candidate generation and gradient-boosted trees; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsift.llm.common import stored, text_of

# The kinds in their order, and the base patterns. Possessive
# quantifiers and the looks behind change no match; they keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# High-recall generators; what they propose may overlap.
WRITTEN_EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++"
    r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"
)
NUMBER = r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++"

#: Digits of the longest number that is proposed.
MOST_DIGITS = 19

CONTEXT_CHARS = 30
CONTEXT_WORDS = {
    "about_mail": r"(?i)e?-?mail|contact|write|address",
    "about_phone": r"(?i)phone|call|tel|mobile|fax|dial|contact",
    "about_card": r"(?i)card|visa|credit|debit|account|payment",
    "about_host": r"(?i)\bip\b|host|server|address|network",
}
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "chars", "digits", "gaps", "groups", "longest", "opening",
    "dots", "brackets", "distinct", "alone", "check", "touches_before", "touches_after", *CONTEXT_WORDS,
)
#: The context that makes an unsure proposal of a kind worth more than a guess.
OWN_CONTEXT = {"email": "about_mail", "ip": "about_host", "card": "about_card", "phone": "about_phone"}

MAX_SAMPLE = 20_000
TREES, DEPTH = 12, 3
PRECISION, MIN_CALIBRATION = 0.95, 20
#: Steps of the probability that thresholds are looked for in.
STEPS = 10_000
#: Up to so many proposals of a kind and label weigh one each.
KIND_WEIGHT = MAX_SAMPLE // (2 * len(KINDS))
_BLOCK = 256


def _running(steps: Column) -> Column:
    """0 and the sums of the first 1, 2, ... steps; blockwise, as appending to
    one long array would copy it each time."""

    def append(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + x))

    def sums(array: Column) -> Column:
        return F.aggregate(array, F.array(F.lit(0).cast("bigint")), append)

    starts = F.sequence(F.lit(1), F.size(steps) + 1, F.lit(_BLOCK))
    blocks = F.transform(starts, lambda i: sums(F.slice(steps, i, _BLOCK)))
    bases = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
    whole = F.zip_with(
        blocks,
        F.slice(bases, 1, F.size(blocks)),
        lambda b, base: F.transform(F.slice(b, 1, _BLOCK), lambda x: x + base),
    )
    return F.flatten(whole)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: (start, end, value, before, after), in
    code points, ``before`` and ``after`` being what stands next to them."""
    pieces = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), 0)
    return _placed(pieces, values)


def _placed(pieces: Column, values: Column) -> Column:
    steps = F.zip_with(
        F.slice(pieces, 1, F.size(values)),
        values,
        lambda p, v: (F.char_length(p) + F.char_length(v)).cast("bigint"),
    )
    joined = F.arrays_zip(
        values.alias("value"),
        F.slice(_running(steps), 1, F.size(values)).alias("at"),
        F.slice(pieces, 1, F.size(values)).alias("ahead"),
        F.slice(pieces, 2, F.size(values)).alias("behind"),
    )

    def place(x: Column) -> Column:
        start = x["at"] + F.char_length(x["ahead"])
        return F.struct(
            start.alias("start"),
            (start + F.char_length(x["value"])).alias("end"),
            x["value"].alias("value"),
            F.right(x["ahead"], F.lit(CONTEXT_CHARS)).alias("before"),
            F.left(x["behind"], F.lit(1)).alias("after"),
            F.lit(True).alias("alone"),
        )

    return F.transform(joined, place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return F.when(F.length(bare) <= 3, F.coalesce(F.nullif(bare, F.lit("")).cast("int"), F.lit(0)) <= 255).otherwise(
        False
    )


def valid_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), _small)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a card number is right."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: (d.cast("int") * (1 + i % 2)) - F.when((i % 2 == 1) & (d > "4"), 9).otherwise(0),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def valid_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def _valid(kind: str) -> Callable[[Column], Column]:
    tests = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: valid_ip(m["value"]),
        "card": lambda m: valid_card(m["value"]),
        "phone": lambda m: valid_phone(m["value"]),
    }
    return tests[kind]


def _span(kind: str) -> Callable[[Column], Column]:
    rank = KINDS.index(kind)
    return lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")
    )


def _candidate(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match"))


def _runs(found: Column) -> Column:
    """All runs of whole digit groups, of 7 to MOST_DIGITS digits, inside each
    number match. A group has a digit at least, so each starts MOST_DIGITS runs
    at most; what a run needs is read from the groups around it."""

    def joined(groups: Column) -> Column:
        return F.array_join(F.transform(groups, lambda g: F.concat(g["before"], g["value"])), "")

    def of_match(m: Column) -> Column:
        def of_groups(groups: Column) -> Column:
            def from_first(first: Column, i: Column) -> Column:
                ahead = F.slice(groups, i + 1, F.lit(MOST_DIGITS))
                lead = F.when(i == 0, first["before"]).otherwise(F.regexp_extract(first["before"], r"\($", 0))
                near = F.slice(groups, F.greatest(i - CONTEXT_CHARS + 1, F.lit(1)), F.least(i, F.lit(CONTEXT_CHARS)))
                gap = F.left(first["before"], F.char_length(first["before"]) - F.char_length(lead))
                before = F.right(F.concat(m["before"], joined(near), gap), F.lit(CONTEXT_CHARS))

                def to_last(last: Column, k: Column) -> Column:
                    rest = F.get(groups, i + k + 1)
                    after = F.left(F.concat(rest["before"], rest["value"]), F.lit(1))
                    return F.struct(
                        (m["start"] + first["start"] - F.char_length(lead)).alias("start"),
                        (m["start"] + last["end"]).alias("end"),
                        F.concat(lead, first["value"], joined(F.slice(ahead, F.lit(2), k))).alias("value"),
                        before.alias("before"),
                        F.coalesce(after, m["after"]).alias("after"),
                        ((i == 0) & (k + 1 == F.size(groups))).alias("alone"),
                    )

                return F.transform(ahead, to_last)

            starts = F.transform(groups, from_first)
            return F.filter(F.flatten(starts), lambda r: F.length(_digits(r["value"])).between(7, MOST_DIGITS))

        # As the element of an array, the groups are found once for each match.
        return F.flatten(F.transform(F.array(matches(m["value"], "[0-9]++")), of_groups))

    return F.flatten(F.transform(found, of_match))


def proposals(docs: DataFrame) -> DataFrame:
    """(row, doc_id, mark, base, candidates) of every row; the texts are left
    behind but for their hash, ``mark``.

    Cheap tests decide which patterns a text needs at all.
    """
    text = F.col("text")
    needs = {
        "email": text.contains("@"),
        "written": text.contains("@") | text.contains("(at)") | text.contains("[at]"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
        "phone": text.contains("+"),
        "number": text.rlike(r"[0-9](?:[ ().-]{0,2}[0-9]){6}"),
    }
    patterns = {
        "email": EMAIL, "written": WRITTEN_EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "number": NUMBER,
    }
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text_of(docs)).alias("mark"),
        text_of(docs).alias("text"),
    )
    found = rows.select(
        "row", "doc_id", "mark", *[F.when(needs[k], matches(text, p)).alias(k) for k, p in patterns.items()]
    ).withColumn("runs", _runs(_some("number")))
    base = [F.transform(F.filter(_some(kind), _valid(kind)), _span(kind)) for kind in KINDS]
    size = lambda m: F.length(_digits(m["value"]))
    candidates = [
        F.transform(_some("written"), _candidate("email")),
        F.transform(_some("ip"), _candidate("ip")),
        F.transform(F.filter("runs", lambda m: size(m).between(13, MOST_DIGITS)), _candidate("card")),
        F.transform(F.filter("runs", lambda m: size(m).between(7, 15)), _candidate("phone")),
    ]
    return stored(
        found.select(
            "row", "doc_id", "mark", F.array_sort(F.concat(*base)).alias("base"), F.concat(*candidates).alias("candidates")
        ),
        "proposals",
    )


def _some(name: str) -> Column:
    kind = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string,alone:boolean>>"
    return F.coalesce(F.col(name), F.array().cast(kind))


def candidate_rows(found: DataFrame) -> DataFrame:
    """A row for each proposal: (row, doc_id, mark, kind, start, end, value, before, after, alone, label).

    The label is 1 for a base span. It is null, neither learnt from nor counted,
    where a looser form may well be personal data: a written-out address with a
    name at its end, a card number of its own with a right check digit, a host
    or phone number in a context of its kind. All others are 0: they fail on
    format, are parts of longer numbers, or stand where nothing speaks for them.
    """
    rows = found.select("row", "doc_id", "mark", "base", F.explode("candidates").alias("c")).select(
        "row", "doc_id", "mark", "base", "c.kind", "c.match.*"
    )
    sure = F.exists(
        "base",
        lambda b: (b["kind"] == F.col("kind")) & (b["start"] == F.col("start")) & (b["end"] == F.col("end")),
    )
    value = F.col("value")
    context = F.lit(False)
    for kind, name in OWN_CONTEXT.items():
        context = context | ((F.col("kind") == kind) & F.col("before").rlike(CONTEXT_WORDS[name]))
    maybe = (
        F.when(F.col("kind") == "email", value.rlike(r"[A-Za-z]{2}$"))
        .when(F.col("kind") == "card", F.col("alone") & valid_card(value))
        .when(F.col("kind") == "ip", valid_ip(value) & context)
        .otherwise(valid_phone(value) & context)
    )
    label = F.when(sure, 1.0).when(~F.coalesce(maybe, F.lit(False)), 0.0)
    return rows.select(
        "row", "doc_id", "mark", "kind", "start", "end", "value", "before", "after", "alone", label.alias("label")
    )


def masked(rows: DataFrame) -> DataFrame:
    """``rows`` with base spans also in other forms, without the sign that gave them away.

    An address with its sign and dots spelled out, a phone number without plus
    and with other separators, a card number with dots. ``weight`` is shared out
    over the forms of a span.
    """
    bare, gap = F.ltrim("value", F.lit("+")), "[ ().-]+"
    spelled = F.replace("value", F.lit("@"), F.lit(" (at) "))
    forms = {
        "email": [
            F.col("value"),
            spelled,
            F.replace(spelled, F.lit("."), F.lit(" (dot) ")),
            F.replace(F.replace("value", F.lit("@"), F.lit("[at]")), F.lit("."), F.lit("[dot]")),
        ],
        "phone": [
            F.col("value"),
            bare,
            F.regexp_replace(bare, gap, "-"),
            F.regexp_replace(bare, gap, " "),
            F.regexp_replace(bare, gap, "."),
            F.regexp_replace(bare, r"^([0-9]{1,3})[ ().-]+([0-9]{2,4})[ ().-]+", "($2) "),
        ],
        "card": [F.col("value"), F.regexp_replace("value", "[ -]", "."), F.regexp_replace("value", "[ -]", ". ")],
    }
    every = F.array("value")
    for kind, values in forms.items():
        every = F.when((F.col("label") == 1) & (F.col("kind") == kind), F.array(*values)).otherwise(every)
    every = F.array_distinct(every)
    return (
        rows.withColumn("forms", every)
        .withColumn("weight", F.col("weight") / F.size("forms"))
        .withColumn("value", F.explode("forms"))
        .drop("forms")
    )


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` with FEATURES, format and context, in the place of the text. The
    signs that the base patterns look for (plus, sign of an address) are left
    out; a check digit is a feature, as looser forms have one too."""
    bare = F.ltrim("value", F.lit("+"))
    digits = _digits(bare)
    groups = F.filter(F.split(bare, "[^0-9]+"), lambda g: g != "")
    lengths = F.transform(groups, lambda g: F.length(g))
    features = {
        **{f"is_{k}": F.col("kind") == k for k in KINDS},
        "chars": F.length(bare),
        "digits": F.length(digits),
        "gaps": F.length(bare) - F.length(digits),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(lengths), F.lit(0)),
        "opening": F.coalesce(F.get(lengths, F.lit(0)), F.lit(0)),
        "dots": F.length(bare) - F.length(F.replace(bare, F.lit("."))),
        "brackets": bare.contains("("),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "alone": F.col("alone"),
        "check": F.when(F.col("kind") == "card", valid_card(F.col("value"))).otherwise(False),
        "touches_before": F.col("before").rlike(r"[\p{L}\p{N}_]$"),
        "touches_after": F.col("after").rlike(r"[\p{L}\p{N}_]"),
        **{name: F.col("before").rlike(words) for name, words in CONTEXT_WORDS.items()},
    }
    kept = [c for c in rows.columns if c not in ("value", "before", "after", "alone")]
    return rows.select(*kept, *[features[f].cast("double").alias(f) for f in FEATURES])


@dataclass(frozen=True)
class Detector:
    """The trees, and for each kind the least probability that is trusted."""

    trees: GBTClassificationModel | None
    thresholds: dict[str, float]

    def accepted(self, features: DataFrame) -> DataFrame:
        """(row, kind, start, end) of what the trees trust among proposals that are no base spans."""
        unsure = features.where("label is null or label = 0")
        if self.trees is None or not self.thresholds:
            return unsure.where(F.lit(False)).select("row", "kind", "start", "end")
        least = F.lit(None).cast("double")
        for kind, value in self.thresholds.items():
            least = F.when(F.col("kind") == kind, F.lit(value)).otherwise(least)
        return (
            _probability(self.trees, unsure)
            .where(F.col("probability_of_pii") >= least)
            .select("row", "kind", "start", "end")
        )


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features")


def _probability(trees: GBTClassificationModel, features: DataFrame) -> DataFrame:
    """Adds ``probability_of_pii``."""
    rows = trees.transform(_assembler().transform(features))
    return rows.withColumn("probability_of_pii", vector_to_array("probability")[1])


_KEYS = ("doc_id", "start", "end", "mark")


def bounded_sample(rows: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """At most ``max_sample`` labelled proposals, an equal number for each kind and label,
    those of the smallest hash of text and span: the same on any layout, and no
    kind crowds out another. ``weight`` restores the labels' shares in a kind.

    A look at what is learnt from; ``fit`` itself learns from all proposals.

    A large part is thinned by the hash first, to twice as many rows as are
    wanted, so that what meets in one task is bounded.
    """
    features = rows.where("label is not null")
    sizes = _sizes(features)
    most = max_sample // (2 * len(KINDS))
    unit = 1 << 52
    bound, weight = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    for (kind, label), n in sizes.items():
        own = (F.col("kind") == kind) & (F.col("label") == label)
        whole = sum(sizes.get((kind, x), 0) for x in (0.0, 1.0))
        drawn = sum(min(most, sizes.get((kind, x), 0)) for x in (0.0, 1.0))
        bound = F.when(own, F.lit(unit * min(n, 2 * most) // n)).otherwise(bound)
        weight = F.when(own, F.lit(n / whole * drawn / min(n, most))).otherwise(weight)
    thin = features.withColumn("place", F.pmod(F.xxhash64(*_KEYS, F.lit(3)), F.lit(unit))).where(F.col("place") < bound)
    nth = F.row_number().over(Window.partitionBy("kind", "label").orderBy("place", *_KEYS))
    return thin.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth", "place").withColumn("weight", weight)


def _sizes(labelled: DataFrame) -> dict[tuple[str, float], int]:
    """Proposals of each kind and label."""
    return {(r["kind"], r["label"]): r["count"] for r in labelled.groupBy("kind", "label").count().collect()}


def weighted(rows: DataFrame) -> DataFrame:
    """All labelled proposals, with a ``weight`` that keeps a hot kind from
    crowding out another: as a whole a kind weighs as much as its proposals, of
    each label at most KIND_WEIGHT; inside a kind all weigh the same."""
    labelled = rows.where("label is not null")
    sizes = _sizes(labelled)
    weight = F.lit(None).cast("double")
    for kind in KINDS:
        parts = [sizes.get((kind, x), 0) for x in (0.0, 1.0)]
        if sum(parts):
            share = sum(min(KIND_WEIGHT, n) for n in parts) / sum(parts)
            weight = F.when(F.col("kind") == kind, F.lit(share)).otherwise(weight)
    return labelled.withColumn("weight", weight)


def vectors(rows: DataFrame) -> DataFrame:
    """What is learnt from ``rows``, all of them: a row for each distinct vector
    of features with its kind, label and ``fold``, the ``weight`` of all its
    forms and their number ``n``. The halves ``fold`` go by text and span."""
    folded = masked(weighted(rows)).withColumn("fold", F.pmod(F.xxhash64(*_KEYS, F.lit(5)), F.lit(2)))
    return (
        with_features(folded)
        .groupBy("kind", "label", "fold", *FEATURES)
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    )


def _trees(learn: DataFrame) -> GBTClassificationModel | None:
    """Boosted trees on weighted vectors; none without both labels.

    Spark draws split points from as many rows as the square of the bins, or
    10,000: with bins enough it looks at every vector.
    """
    sizes = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    if set(sizes) != {0.0, 1.0}:
        return None
    n = sum(sizes.values())
    bins = math.isqrt(n) + 1 if n > 10_000 else 32
    return GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=1, labelCol="label", weightCol="weight"
    ).fit(_assembler().transform(learn))


def fit(rows: DataFrame) -> Detector:
    """Boosted trees on all labelled proposals, base spans in masked forms
    against what fails. Equal vectors of features go as one with their weight,
    so what the trees pass over grows with the variety of the proposals only.

    The thresholds come from all proposals too: each half, by span, is judged by
    trees that learnt from the other. A kind's threshold is the least
    probability, in steps of 1 / STEPS, from which on at least PRECISION of
    the proposals carry the label, by weight, of MIN_CALIBRATION at least. A
    kind without one adds no spans. Without both labels in both halves there
    are no trees.
    """
    known = stored(vectors(rows), "pii-vectors")
    judged = []
    for fold in (0, 1):
        half = _trees(known.where(F.col("fold") != fold))
        if half is None:
            return Detector(None, {})
        judged.append(_probability(half, known.where(F.col("fold") == fold)))
    step = F.floor(F.col("probability_of_pii") * STEPS)
    checked = (
        judged[0]
        .unionAll(judged[1])
        .groupBy("kind", step.alias("step"))
        .agg(
            F.min("probability_of_pii").alias("p"),
            F.sum("weight").alias("seen"),
            F.sum(F.col("weight") * F.col("label")).alias("right"),
            F.sum("n").alias("n"),
        )
        .collect()  # a row for each kind and step at most
    )
    thresholds = {}
    for kind in KINDS:
        n, seen, right = 0, 0.0, 0.0
        for r in sorted((r for r in checked if r["kind"] == kind), key=lambda r: -r["step"]):
            n, seen, right = n + r["n"], seen + r["seen"], right + r["right"]
            if n >= MIN_CALIBRATION and right >= PRECISION * seen:
                thresholds[kind] = r["p"]
    return Detector(_trees(known), thresholds)


def _outermost(spans: DataFrame) -> DataFrame:
    """Without spans that lie inside a longer one of their kind."""
    before = (
        Window.partitionBy("row", "kind")
        .orderBy("start", F.col("end").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.max("end").over(before)
    return spans.distinct().withColumn("reach", reach).where("reach is null or reach < end").drop("reach")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row, spans being (start, rank, kind, end)
    sorted by start, then kind, in code points with the end exclusive.

    ``base`` is what the patterns and their tests find. Generators propose more
    and looser spans; trees that learnt from masked base spans which format and
    context personal data has add those they trust, unless they overlap a base span.

    Null and empty texts have no span. Rows stand for themselves, also with
    equal or null doc_ids. Texts of any length are searched whole.
    """
    found = proposals(docs)
    rows = candidate_rows(found)
    more = _outermost(fit(rows).accepted(with_features(rows)))
    rank = F.lit(None).cast("int")
    for i, kind in enumerate(KINDS):
        rank = F.when(F.col("kind") == kind, F.lit(i)).otherwise(rank)
    added = (
        more.select(F.col("row").alias("_row"), F.struct("start", rank.alias("rank"), "kind", "end").alias("s"))
        .groupBy("_row")
        .agg(F.collect_set("s").alias("more"))
    )
    joined = found.join(added, F.col("row") == F.col("_row"), "left")
    apart = F.filter(
        F.col("more"),
        lambda m: ~F.exists(F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat(F.col("base"), apart))
    )
    return joined.select("doc_id", "base", spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones as one, replaced by its kind."""
    state = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.struct(
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["out"],
                    F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                    F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    rest = F.substring(text, (state["at"] + 1).cast("int"), F.char_length(text))
    return F.concat(state["out"], rest)
