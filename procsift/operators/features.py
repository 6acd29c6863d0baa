"""The twelve behavioural features and the heuristic label."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procsift.functions.text import contains_any, count_contained, lowered, token_entropy
from procsift.functions.times import seconds_between
from procsift.operators.graph import graph_table, parent_first_seen, pid_depth
from procsift.operators.lookup import DEFAULT_LIMITS, LookupLimits, lookup
from procsift.schema import (
    ACCESS_EVENT_TYPES,
    CHAIN_DEFAULT,
    CHAIN_SCORES,
    DUMP_KEYWORDS,
    FEATURES,
    HIDDEN_FLAGS,
    LABEL_QUANTILE,
    LOLBAS,
    LONG_COMMAND,
    SUSPICIOUS_PARENTS,
)
from procsift.session import Stored, store
from procsift.sources.unified import column_or_null


def chain_score(
    parent: Column, child: Column, rules: dict[tuple[str, str], float] | None = None
) -> Column:
    """Rule score of a (parent, child) pair of basenames, 0.5 without a rule."""
    by_parent: dict[str, list[tuple[str, float]]] = {}
    for (p, c), score in (CHAIN_SCORES if rules is None else rules).items():
        by_parent.setdefault(p, []).append((c, score))
    result = F
    for p, children in by_parent.items():
        inner = F
        for c, score in children:
            inner = inner.when(child == c, F.lit(float(score)))
        result = result.when(parent == p, inner.otherwise(F.lit(CHAIN_DEFAULT)))
    return F.lit(CHAIN_DEFAULT) if result is F else result.otherwise(F.lit(CHAIN_DEFAULT))


def suspicious_parent(df: DataFrame) -> Column:
    parent = lowered(column_or_null(df, "parent_image_base"))
    return parent.isin(SUSPICIOUS_PARENTS).cast("int")


def unusual_chain(df: DataFrame, rules: dict[tuple[str, str], float] | None = None) -> Column:
    return chain_score(
        lowered(column_or_null(df, "parent_image_base")),
        lowered(column_or_null(df, "process_image_base")),
        rules,
    )


def cmd_entropy(df: DataFrame) -> Column:
    return token_entropy(column_or_null(df, "command_line"))


def dump_precursor(df: DataFrame) -> Column:
    """A dump keyword in image, command or target, or lsass as target base."""
    found = F.lit(False)
    for name in ("process_image", "command_line", "target_image"):
        if name in df.columns:
            found = found | contains_any(lowered(F.col(name)), DUMP_KEYWORDS)
    if "target_image_base" in df.columns:
        found = found | F.contains(lowered(F.col("target_image_base")), F.lit("lsass"))
    return found.cast("int")


def hidden_flags(df: DataFrame) -> Column:
    return count_contained(lowered(column_or_null(df, "command_line")), HIDDEN_FLAGS)


def lolbin_ratio(df: DataFrame) -> Column:
    child = lowered(column_or_null(df, "process_image_base")).isin(LOLBAS).cast("int")
    parent = lowered(column_or_null(df, "parent_image_base")).isin(LOLBAS).cast("int")
    return (child + parent) / F.lit(2.0)


def event_type_access(df: DataFrame) -> Column:
    number = column_or_null(df, "event_type").try_cast("double")
    return F.coalesce(number.isin([float(t) for t in ACCESS_EVENT_TYPES]), F.lit(False)).cast("int")


def has_target_lsass(df: DataFrame) -> Column:
    base = lowered(column_or_null(df, "target_image_base"))
    return F.contains(base, F.lit("lsass")).cast("int")


def long_cmd(df: DataFrame) -> Column:
    command = F.coalesce(column_or_null(df, "command_line"), F.lit(""))
    return (F.length(command) > LONG_COMMAND).cast("int")


ROW_FEATURES = {
    "suspicious_parent": suspicious_parent,
    "unusual_chain": unusual_chain,
    "cmd_entropy": cmd_entropy,
    "dump_precursor": dump_precursor,
    "hidden_flags": hidden_flags,
    "lolbin_ratio": lolbin_ratio,
    "event_type_access": event_type_access,
    "has_target_lsass": has_target_lsass,
    "long_cmd": long_cmd,
}


def add_row_features(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Features that need nothing but their own row, as one projection."""
    return df.withColumns({n: ROW_FEATURES[n](df) for n in names or ROW_FEATURES})


def pair_counts(events: DataFrame) -> DataFrame:
    """Events per (parent, child) pair of basenames."""
    return (
        events.select(
            F.coalesce("parent_image_base", F.lit("")).alias("parent_base"),
            F.coalesce("process_image_base", F.lit("")).alias("child_base"),
        )
        .groupBy("parent_base", "child_base")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pair_table(events: DataFrame) -> Stored:
    pairs = store(pair_counts(events), "pairs")
    return replace(pairs, total=pairs.df.agg(F.sum("n")).first()[0] or 0)


def add_rare_parent_child(
    events: DataFrame, pairs: Stored, limits: LookupLimits = DEFAULT_LIMITS
) -> DataFrame:
    """1 - share of the row's pair among all rows: higher is rarer."""
    keyed = events.withColumns(
        {
            "_parent": F.coalesce("parent_image_base", F.lit("")),
            "_child": F.coalesce("process_image_base", F.lit("")),
        }
    )
    found = lookup(
        keyed,
        pairs,
        {"_parent": "parent_base", "_child": "child_base"},
        {"n": "_pair_n"},
        weight="n",
        limits=limits,
    )
    rarity = F.lit(1.0) - F.col("_pair_n").cast("double") / F.lit(max(pairs.total, 1))
    return found.withColumn("rare_parent_child", rarity).drop("_parent", "_child", "_pair_n")


def add_time_delta_parent(
    events: DataFrame, graph: Stored, limits: LookupLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Seconds since the parent's first event; negative if it came later."""
    found = parent_first_seen(events, graph, limits)
    delta = seconds_between(F.col("timestamp"), F.col("parent_seen"))
    return found.withColumn("time_delta_parent", delta).drop("parent_seen")


def build_features(
    prepped: DataFrame,
    *,
    keep: list[str] | None = None,
    graph: Stored | None = None,
    pairs: Stored | None = None,
    limits: LookupLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """``event_id``, ``timestamp``, the columns to keep and the 12 features.

    Row features are computed first, so that the joins after them carry only
    narrow columns. ``graph`` and ``pairs`` may be frozen tables of an earlier
    run; otherwise they are built from ``prepped``.
    """
    graph = graph or graph_table(prepped, limits)
    pairs = pairs or pair_table(prepped)
    kept = ["event_id", "timestamp", *(keep or [])]
    kept = list(dict.fromkeys(kept))
    helpers = [
        c for c in ("pid", "ppid", "parent_image_base", "process_image_base") if c not in kept
    ]
    rows = add_row_features(prepped).select(*kept, *helpers, *ROW_FEATURES)
    rows = pid_depth(rows, graph, limits)
    rows = add_time_delta_parent(rows, graph, limits)
    rows = add_rare_parent_child(rows, pairs, limits)
    return rows.select(*kept, *FEATURES)


def label_composite(df: DataFrame) -> Column:
    """Parent + dump + at most one for flags: 0 to 3."""
    zero = F.lit(0)
    return (
        F.coalesce(column_or_null(df, "suspicious_parent", "int"), zero)
        + F.coalesce(column_or_null(df, "dump_precursor", "int"), zero)
        + F.least(F.coalesce(column_or_null(df, "hidden_flags", "int"), zero), F.lit(1))
    )


def heuristic_labels(features: DataFrame) -> DataFrame:
    """Add ``is_attack``: a dump precursor, or a composite of at least its q95.

    The composite takes a handful of values, so the exact percentile keeps a
    handful of counters.
    """
    composite = label_composite(features)
    cut = features.agg(F.percentile(composite, LABEL_QUANTILE)).scalar()
    attack = (F.coalesce("dump_precursor", F.lit(0)) == 1) | (composite >= cut)
    return features.withColumn("is_attack", attack.cast("int"))


def suspicion_score(df: DataFrame) -> Column:
    """The ranking composite: flags are not capped here."""
    zero = F.lit(0)
    return (
        F.coalesce(column_or_null(df, "suspicious_parent", "int"), zero)
        + F.coalesce(column_or_null(df, "dump_precursor", "int"), zero)
        + F.coalesce(column_or_null(df, "hidden_flags", "int"), zero)
    )


def top_suspicious(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` rows of highest composite, ties by row id."""
    return (
        df.withColumn("suspicion", suspicion_score(df))
        .orderBy(F.desc("suspicion"), "event_id")
        .limit(n)
    )
