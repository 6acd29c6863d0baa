"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsift.llm.common import fresh, sieve, stored, text_of

WINDOW = 8
#: Shorter items have too few words to tell a leak from chance; a parameter
#: (``min_words``), as below it only a whole item with its own values is evidence.
MIN_WORDS = 5
#: A window with so many words that are no placeholders is evidence by itself.
#: Others count along with one of these, in an item that is met whole and has
#: WHOLE_LITERALS such words, or with the item's own numbers, names and units.
MIN_LITERALS, WHOLE_LITERALS = 5, 3
COVERAGE = 0.5
#: Part of an item is a leak too if so many words of it stand in line.
RUN_WORDS = 13
#: Anchors of a benchmark up to this number are broadcast.
BROADCAST_ROWS = 500_000

# Placeholders of the three kinds of slots: private characters, blanked in texts.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = (
    "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|miles|mile|meters|metres|feet|foot|inches|inch|yards|yard|"
    "hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|"
    "dollars|dollar|cents|cent|euros|euro|pounds|pound|percent|degrees|mph|kph|kwh|gb|mb"
)
#: The groups here and in NAMES are possessive: others take a call for each round, so
#: a run of some thousands is more than a task's stack holds, and its executor dies.
NUMBERS = r"[0-9]+(?:[.,:/][0-9]+)*+"
UNIT_AFTER = rf"{NUMBER} +((?i:{UNITS}))($|[^\p{{L}}\p{{N}}])"
#: Capitalised words that don't begin a sentence; several in a row are one name.
NAMES = r"(?<=[\p{L}\p{N},;])(?: \p{Lu}\p{Ll}+)++"
#: What stands between words once they are lower-cased: ASCII but for letters
#: and digits, Latin-1 signs, general and CJK punctuation.
BETWEEN = r"[\x00-/:-`{-\u00bf\u2000-\u206f\u3000-\u303f]+"


def with_template(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the canonical ``words`` of ``text``, and the steps t0 to t2.

    Numbers, a unit after a number, and names become placeholders of their
    kind; the rest is lower-cased and cut at all but letters and digits.
    """
    own = F.col("text")
    odd = own.contains(NUMBER) | own.contains(NAME) | own.contains(UNIT)
    rows = rows.select(
        *keep, F.when(odd, F.translate(own, NUMBER + NAME + UNIT, "   ")).otherwise(own).alias("t0")
    )
    rows = rows.select(*keep, "t0", F.regexp_replace("t0", NUMBERS, f" {NUMBER} ").alias("t1"))
    second = F.regexp_replace("t1", UNIT_AFTER, f"{NUMBER} {UNIT}$2")
    second = F.when(F.col("t1").contains(NUMBER), second).otherwise(F.col("t1"))
    rows = rows.select(*keep, "t0", "t1", second.alias("t2"))
    third = F.lower(F.regexp_replace("t2", NAMES, f" {NAME}"))
    words = F.filter(F.split(third, BETWEEN, -1), lambda w: w != "")
    return rows.select(*keep, "t0", "t1", "t2", words.alias("words"))


def with_slots(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``words`` and ``slots`` (pos, value) of rows with a template:
    what stood in the place of each placeholder, by its place among the words."""
    marks = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("kind"))),
        lambda s: s["kind"].isin(NUMBER, NAME, UNIT),
    )
    values = {
        NUMBER: F.regexp_extract_all("t0", F.lit(f"({NUMBERS})"), 1),
        UNIT: F.regexp_extract_all("t1", F.lit(UNIT_AFTER), 1),
        NAME: F.regexp_extract_all("t2", F.lit(f"({NAMES})"), 1),
    }
    rows = rows.select(*keep, "words", "t0", "t1", "t2", marks.alias("marks"))
    slots = [
        F.zip_with(F.filter("marks", _of_kind(kind)), found, _slot) for kind, found in values.items()
    ]
    return rows.select(*keep, "words", F.array_sort(F.concat(*slots)).alias("slots"))


def _slot(mark: Column, value: Column) -> Column:
    return F.struct(mark["pos"].alias("pos"), F.lower(F.trim(value)).alias("value"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _literal(word: Column) -> Column:
    return ~word.isin(NUMBER, NAME, UNIT)


def _values(slots: Column, pos: Column, length: Column) -> Column:
    """The values of the slots inside a window, by place."""
    inside = F.filter(slots, lambda s: (s["pos"] >= pos) & (s["pos"] < pos + length))
    return F.transform(inside, lambda s: s["value"])


def _hash(words: Column, start: Column, length: Column) -> Column:
    return F.xxhash64(F.slice(words, start + 1, length))


def _pattern(slots: Column) -> Column:
    """Which slots have equal values: for each the place of the first one like it."""
    values = F.transform(slots, lambda s: s["value"])
    return F.transform(slots, lambda s: F.array_position(values, s["value"]))


def template_members(items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(template, item_id, words, slots): each distinct text of the benchmark with its class.

    Texts of equal canonical words, whose equal slots are the same ones, are one
    class; ``template`` is a number for it. Items that differ in their numbers,
    names and units only, such as generated sums, are members of one class.
    """
    texts = items.where(F.col("item_id").isNotNull()).select("item_id", text_of(items).alias("text")).distinct()
    rows = with_slots(with_template(texts, "item_id"), "item_id").where(F.size("words") >= min_words)
    rows = rows.withColumn("pattern", _pattern(F.col("slots")))
    # The class is the group of words and pattern itself; its number is given once, in a stored table.
    classes = stored(
        rows.groupBy("words", "pattern").agg(F.count(F.lit(1)).alias("n")).withColumn("template", F.monotonically_increasing_id()),
        "template-classes",
    )
    named = rows.join(classes.select("words", "pattern", "template"), ["words", "pattern"])
    return stored(named.select("template", "item_id", "words", "slots"), "template-members")


def _windows_of(rows: DataFrame, window: int, *keep: str) -> DataFrame:
    """``keep``, words, slots, and length and item_pos of every window."""
    length = F.least(F.lit(window), F.size("words"))
    return rows.select(
        *keep,
        "words",
        "slots",
        length.alias("length"),
        F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("item_pos"),
    )


def _member_values() -> Column:
    return F.xxhash64(_values(F.col("slots"), F.col("item_pos"), F.col("length")))


def template_windows(members: DataFrame, window: int = WINDOW) -> DataFrame:
    """(template, item_id, n_items, item_windows, item_literals, strong, length, item_pos,
    hash, item_values, anchor, at) of all windows of all classes.

    One member stands for its class, ``item_id`` is the smallest of the class's
    ids. A template of fewer words than a window is one window of its own
    length. The anchor is the hash of a window's longest literal word, ``at``
    its place; a window without any has a placeholder as its anchor. ``strong``
    windows have MIN_LITERALS literal words.
    """
    classes = members.groupBy("template").agg(
        F.min("item_id").alias("item_id"),
        F.count_distinct("item_id").alias("n_items"),
        F.min(F.struct("item_id", "slots", "words")).alias("first"),
    )
    rows = classes.select("template", "item_id", "n_items", "first.words", "first.slots")
    rows = _windows_of(rows, window, "template", "item_id", "n_items")
    words = F.slice(F.col("words"), F.col("item_pos") + 1, F.col("length"))
    marked = F.transform(
        words,
        lambda w, i: F.struct(
            _literal(w).alias("literal"), F.char_length(w).alias("chars"), w.alias("word"), (-i).alias("at")
        ),
    )
    literals = F.size(F.filter("marked", lambda x: x["literal"]))
    return (
        rows.withColumn("marked", marked)
        .withColumn("longest", F.array_max("marked"))
        .select(
            "template",
            "item_id",
            "n_items",
            (F.size("words") - F.col("length") + 1).alias("item_windows"),
            F.size(F.filter("words", _literal)).alias("item_literals"),
            (literals >= F.least(F.lit(MIN_LITERALS), F.col("length"))).alias("strong"),
            "length",
            "item_pos",
            _hash(F.col("words"), F.col("item_pos"), F.col("length")).alias("hash"),
            _values(F.col("slots"), F.col("item_pos"), F.col("length")).alias("item_values"),
            F.xxhash64("longest.word").alias("anchor"),
            (-F.col("longest.at")).alias("at"),
        )
    )


def document_windows(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, pos, length, hash) of the documents' windows that can match.

    A window that equals one of the benchmark has its anchor in its place, so
    with anchors that fit a broadcast only windows around them are hashed.
    With more of them all windows are; the matches are the same.
    """
    words = with_template(
        docs.select("doc_id", text_of(docs).alias("text")).where(F.col("doc_id").isNotNull()), "doc_id"
    ).select("doc_id", "words")
    anchors = items.select("anchor", "at", "length").distinct()
    if anchors.count() <= broadcast_rows:
        # Not the bare column: the filter that Spark infers for one would be
        # pushed down and canonicalise each text twice.
        some = F.when(F.size("words") > 0, F.col("words"))
        seen = words.select("doc_id", "words", F.posexplode(some).alias("place", "word"))
        met = seen.join(F.broadcast(anchors), F.xxhash64("word") == F.col("anchor")).select(
            "doc_id", "words", "length", (F.col("place") - F.col("at")).alias("pos")
        )
    else:
        lengths = [r["length"] for r in items.select("length").distinct().collect()]  # at most four
        met = words.select(
            "doc_id", "words", F.explode(F.array(*map(F.lit, lengths))).alias("length")
        ).select("doc_id", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("pos"))
    return met.where((F.col("pos") >= 0) & (F.col("pos") + F.col("length") <= F.size("words"))).select(
        "doc_id", "pos", "length", _hash(F.col("words"), F.col("pos"), F.col("length")).alias("hash")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    coverage: float = COVERAGE,
    run_words: int = RUN_WORDS,
    broadcast_rows: int = BROADCAST_ROWS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """(doc_id, item_id, n_items, n_windows, item_windows, coverage, aligned) of each
    document that holds a benchmark item, as it is or with other numbers, names or units.

    Items of one template are one class (``template_members`` lists them), so a
    document has one row for a class, however many items that has: ``item_id``
    is the smallest and ``n_items`` the number of those it may be taken from.

    Template windows of ``window`` words are joined by hash. Matches of one
    document and class at one distance of their places belong to one occurrence;
    it counts if its slots are consistent, that is, if equal values of the item
    have equal values in the document throughout, and if it has a window of
    MIN_LITERALS literal words, or is the whole of an item with WHOLE_LITERALS
    of them; these hold for all members. Any other occurrence counts for the
    members whose own values it has, which a join by value finds. ``coverage``
    is the share of the item's windows that consistent occurrences match,
    ``aligned`` the most windows that one of them does. A document holds an
    item from a share of ``coverage`` on, or from as many aligned windows as
    ``run_words`` words have.

    Null and empty texts have no window. Items under ``min_words`` words are
    not looked for. Rows that repeat a doc_id count once, its texts together.
    Rows that repeat an item_id and its text count once; of classes that report
    the same item_id for a document the one of most coverage counts. Null ids
    are left out.
    """
    members = template_members(benchmark, min_words)
    items = stored(template_windows(members, window), "template-windows")
    items_only = items.drop("anchor", "at")
    met = stored(
        document_windows(docs, items, broadcast_rows)
        .join(items_only, ["hash", "length"])
        .select(
            "doc_id",
            "template",
            "item_id",
            "n_items",
            "item_windows",
            "item_literals",
            "strong",
            "item_pos",
            "item_values",
            "pos",
            "length",
        ),
        "template-matches",
    )
    filled = met.where(F.size("item_values") > 0)
    owners = filled.select(F.col("doc_id").alias("owner")).distinct()
    base = docs.select("doc_id", text_of(docs).alias("text"))
    texts = base.join(owners, F.col("doc_id") == F.col("owner"), "left_semi")
    slots = with_slots(with_template(texts, "doc_id"), "doc_id").select(F.col("doc_id").alias("owner"), "slots")
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    doc_values = _values(F.col("slots"), F.col("pos"), F.col("length"))
    pairs = F.zip_with(F.col("item_values"), doc_values, lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    key = ["doc_id", "template", "item_id", "n_items", "item_windows", "item_literals"]
    no_values = F.array().cast("array<string>")
    found = (
        filled.join(slots, F.col("doc_id") == F.col("owner"))
        .select(*key, "strong", "item_pos", shift, pairs.alias("pairs"), F.xxhash64(doc_values).alias("values"))
        .unionAll(
            met.where(F.size("item_values") == 0).select(
                *key,
                "strong",
                "item_pos",
                shift,
                F.array().cast("array<struct<item:string,doc:string>>").alias("pairs"),
                F.xxhash64(no_values).alias("values"),
            )
        )
    )
    # A document that repeats its id may have several texts with a window in one place.
    at = F.array_distinct("at.item_pos")
    occurrences = stored(
        found.groupBy(*key, "shift")
        .agg(
            F.collect_set(F.struct("item_pos", "values")).alias("at"),
            F.max("strong").alias("strong"),
            F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        )
        .where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"]))))
        .withColumn("whole", (F.size(at) == F.col("item_windows")) & (F.col("item_literals") >= WHOLE_LITERALS))
        .select(*key, "shift", "at", (F.col("strong") | F.col("whole")).alias("enough")),
        "template-occurrences",
    )
    sure = occurrences.where("enough").select(*key, at.alias("at"))
    weak = occurrences.where(~F.col("enough"))
    asked = weak.select("template").distinct()
    values = _windows_of(members.join(asked, "template", "left_semi"), window, "template", "item_id").select(
        "template", F.col("item_id").alias("own_id"), "item_pos", _member_values().alias("values"), "slots"
    )
    by_value = (
        weak.select(*key, "shift", F.size(at).alias("size"), F.explode("at").alias("w"))
        .select(*key, "shift", "size", "w.item_pos", "w.values")
        .join(values, ["template", "item_pos", "values"])
        .groupBy(*key, "shift", "size", "own_id", "slots")
        .agg(F.collect_set("item_pos").alias("at"))
        .where(F.size("at") == F.col("size"))
    )
    rest = [c for c in key if c not in ("item_id", "n_items")]
    equal = by_value.groupBy(*rest, "shift").agg(
        F.min("own_id").alias("item_id"), F.count_distinct("own_id").alias("n_items"), F.first("at").alias("at")
    )
    found = (
        sure.unionByName(equal.select(*key, "at"))
        .select(*rest, "item_id", "n_items", F.size("at").cast("bigint").alias("aligned"), F.explode("at").alias("at"))
        .groupBy(*rest, "at")
        .agg(F.max("aligned").alias("aligned"), F.min("item_id").alias("item_id"), F.max("n_items").alias("n_items"))
        .groupBy("doc_id", "template")
        .agg(
            F.min("item_id").alias("item_id"),
            F.max("n_items").alias("n_items"),
            F.count(F.lit(1)).alias("n_windows"),
            F.max("item_windows").cast("bigint").alias("item_windows"),
            F.max("aligned").alias("aligned"),
        )
        .withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
        .where((F.col("coverage") >= coverage) | (F.col("aligned") > run_words - window))
    )
    best = F.max(F.struct("coverage", "aligned", "n_windows", "item_windows", "n_items")).alias("best")
    return (
        found.groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id", "item_id", "best.n_items", "best.n_windows", "best.item_windows", "best.coverage", "best.aligned"
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    name = fresh(docs, "_hit")
    hit = contamination(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    hit = stored(hit, "hit-ids")
    likely, surely = sieve(hit, name).parted(docs, "doc_id")
    return likely.join(hit, F.col("doc_id") == F.col(name), "left_anti").unionAll(surely)
