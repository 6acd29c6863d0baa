"""Every operator as a query over the driver's tables.

The queries read whole tables. Where the reference scores with a fitted forest,
queries with a SQL twin use the table's own ``value`` column as the score, so
that thresholds, bands and gates can be compared row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procsift.functions.ids import hex_id
from procsift.functions.text import base_name
from procsift.functions.topk import top_features
from procsift.operators import attribution, evaluate, forest, gating, importance, triage
from procsift.operators.features import (
    ROW_FEATURES,
    add_rare_parent_child,
    add_row_features,
    add_time_delta_parent,
    build_features,
    graph_table,
    heuristic_labels,
    pair_table,
    top_suspicious,
)
from procsift.operators.graph import pid_depth
from procsift.operators.lookup import LookupLimits
from procsift.operators.prep import (
    complete_rows,
    event_type_counts,
    null_summary,
    prep_events,
    suspicious_match,
)
from procsift.plans import jobs
from procsift.schema import CORE_COLUMNS, FEATURES, RAW_FILES, TARGET_COLUMNS, TRACE_COLUMNS
from procsift.session import scratch_path, store
from procsift.sources import artifacts, intake, rawlogs
from procsift.sources.artifacts import model_matrix, threshold_config
from procsift.sources.bridge import RAW_TEXT, ndjson_text, process_events, process_view, sysmon_text
from procsift.sources.unified import combined_events, to_unified
from procsift.streaming.alerts import Snapshot, latest_snapshot, load_snapshot, save_snapshot, start_alerts
from procsift.streaming.ingest import start_ingest

Query = Callable[[SparkSession, str], DataFrame]
# Limits under which a lookup meets in a shuffle join.
SHUFFLED = LookupLimits(broadcast_bytes=0, hot_keys=5)
LABEL_INPUTS = ["suspicious_parent", "dump_precursor", "hidden_flags"]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def named(name: str) -> Callable[[Query], Query]:
    """Register under the operator's own name, which an import already takes."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def _prepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep_events(process_events(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared events with their row features, ``value`` as the score."""
    rows = add_row_features(_prepped(spark, sf_dir))
    return rows.withColumnRenamed("value", "anomaly_score")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.gate(_scored(spark, sf_dir))[0]


def _rounded(df: DataFrame, *, digits: int = 6) -> DataFrame:
    """Doubles to six digits, without negative zero."""
    return df.select(
        *[
            (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


# --- ingest -------------------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """The raw lines of a source, written as a log and scanned."""
    folder = scratch_path(spark, f"raw-{source}")
    RAW_TEXT[source](process_events(spark, sf_dir)).write.text(folder)
    return spark.read.text(folder)


def _ingested(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    parsed = rawlogs.PARSERS[source](_raw(spark, sf_dir, source))
    return to_unified(rawlogs.good_rows(parsed), source)


@query
def ingest_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, "falcon").select(*CORE_COLUMNS)


@query
def ingest_ndjson_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the seconds column: the milliseconds are the time."""
    lines = ndjson_text(process_events(spark, sf_dir), second_time=True)
    rows = rawlogs.good_rows(rawlogs.ndjson_lines(lines))
    return to_unified(rows, "falcon").select(*CORE_COLUMNS)


@query
def ingest_sysmon_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a time of their own: the record's creation time."""
    lines = sysmon_text(process_events(spark, sf_dir), second_time=True)
    rows = rawlogs.good_rows(rawlogs.sysmon_lines(lines))
    return to_unified(rows, "sysmon").select(*CORE_COLUMNS, *TARGET_COLUMNS)


@query
def ingest_xml_4688(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, "security_4688").select(*CORE_COLUMNS)


@query
def ingest_xml_sysmon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, "sysmon").select(*CORE_COLUMNS, *TARGET_COLUMNS)


@query
def malformed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawlogs.malformed_counts(
        {s: parse(_raw(spark, sf_dir, s)) for s, parse in rawlogs.PARSERS.items()}
    )


@query
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        rawlogs.quarantine(parse(_raw(spark, sf_dir, s))) for s, parse in rawlogs.PARSERS.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def process_creation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of one event name, with the cheap filter before parsing."""
    view = process_events(spark, sf_dir).withColumn("source", F.lit("falcon"))
    lines = rawlogs.process_creation_only(RAW_TEXT["falcon"](view))
    rows = rawlogs.good_rows(rawlogs.ndjson_lines(lines))
    kept = rows.where(F.col("event_simpleName") == rawlogs.PROCESS_CREATION)
    return to_unified(kept, "falcon").select("timestamp", "event_type", "pid", "ppid")


@query
def sysmon_event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rawlogs.good_rows(rawlogs.sysmon_lines(_raw(spark, sf_dir, "sysmon")))
    kept = rows.where(F.col("EventID").isin([8, 10]))
    return to_unified(kept, "sysmon").select("timestamp", "event_type", "pid", "target_image")


def _write_raw(spark: SparkSession, sf_dir: str, label: str) -> str:
    folder = scratch_path(spark, label)
    for source, name in RAW_FILES.items():
        RAW_TEXT[source](process_events(spark, sf_dir)).write.text(f"{folder}/{name}")
    return folder


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three raw logs as files, scanned, normalised and united."""
    folder = _write_raw(spark, sf_dir, "rawlogs")
    return combined_events(spark, folder).drop("event_id")


def _sorted_logs(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "sorted-logs")
    view = process_events(spark, sf_dir).repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    for source, name in RAW_FILES.items():
        RAW_TEXT[source](view).write.text(f"{folder}/{name}")
    return folder


@query
def ingested_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in the order of sources, files and lines, over several sorted files."""
    folder = _sorted_logs(spark, sf_dir)
    return combined_events(spark, folder).select("event_id", "source", "timestamp", "pid", "command_line")


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files through the incremental ingest."""
    folder = _write_raw(spark, sf_dir, "stream-in")
    output = scratch_path(spark, "stream-out")
    running = start_ingest(
        spark,
        {s: f"{folder}/{name}" for s, name in RAW_FILES.items()},
        output,
        scratch_path(spark, "stream-checkpoint"),
    )
    running.awaitTermination()
    return spark.read.parquet(output).select(*CORE_COLUMNS, *TARGET_COLUMNS)


@query
def parse_hex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written in six ways, two of them unreadable."""
    pid, kind = F.col("pid"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("0x"), F.lower(F.hex(pid))))
        .when(kind == 1, F.concat(F.lit("0X0000"), F.hex(pid)))
        .when(kind == 2, pid.cast("string"))
        .when(kind == 3, F.concat(F.lit("  0x"), F.hex(pid), F.lit(" ")))
        .when(kind == 4, F.concat(F.lit("0xZ"), pid.cast("string")))
        .otherwise(F.concat(F.lit("id"), pid.cast("string")))
    )
    return process_events(spark, sf_dir).select("event_id", hex_id(text).alias("parsed_id"))


@named("null_summary")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_summary(process_events(spark, sf_dir).select(*CORE_COLUMNS, *TARGET_COLUMNS))


@named("event_type_counts")
def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_type_counts(process_events(spark, sf_dir))


@query
def suspicious_keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = process_events(spark, sf_dir)
    return events.where(suspicious_match(events)).select("event_id", "command_line")


@query
def suspicious_keyword_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = process_events(spark, sf_dir)
    return events.agg(F.count_if(suspicious_match(events)).alias("n"))


@query
def suspicious_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five keyword rows, the report's preview."""
    events = process_events(spark, sf_dir)
    rows = events.where(suspicious_match(events)).orderBy("event_id").limit(5)
    return rows.select("event_id", "event_type", "process_image", "command_line")


# --- preparation --------------------------------------------------------------


@named("prep_events")
def prepared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepped(spark, sf_dir).select(
        "event_id",
        "timestamp",
        "event_type",
        "pid",
        "ppid",
        "process_image_base",
        "parent_image_base",
        "target_image_base",
    )


@query
def partly_complete_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completeness filter at three of five required columns."""
    return complete_rows(process_events(spark, sf_dir), threshold=0.6).select("event_id")


@query
def windows_basenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basenames with both separators."""
    return process_events(spark, sf_dir).select(
        "event_id", base_name(F.col("process_image"), "windows").alias("base")
    )


# --- features -----------------------------------------------------------------


def _row_feature(name: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepped = _prepped(spark, sf_dir)
        return _rounded(prepped.select("event_id", ROW_FEATURES[name](prepped).alias(name)))

    return build


for _name in ROW_FEATURES:
    QUERIES[f"feat_{_name}"] = _row_feature(_name)


@query
def feat_pid_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepped = _prepped(spark, sf_dir)
    return pid_depth(prepped.select("event_id", "pid"), graph_table(prepped)).select(
        "event_id", "pid_depth"
    )


@query
def feat_time_delta_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepped = _prepped(spark, sf_dir)
    rows = add_time_delta_parent(
        prepped.select("event_id", "timestamp", "ppid"), graph_table(prepped)
    )
    return _rounded(rows.select("event_id", "time_delta_parent"))


@query
def feat_rare_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepped = _prepped(spark, sf_dir)
    rows = prepped.select("event_id", "parent_image_base", "process_image_base")
    found = add_rare_parent_child(rows, pair_table(prepped))
    return _rounded(found.select("event_id", "rare_parent_child"))


@query
def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(build_features(_prepped(spark, sf_dir)))


def _stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as the feature job leaves it, for several passes."""
    return store(build_features(_prepped(spark, sf_dir)), "features").df


@query
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's input: twelve doubles, missing as 0."""
    return _rounded(model_matrix(build_features(_prepped(spark, sf_dir))))


@named("heuristic_labels")
def labels_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored once, so that the features aren't computed again for the cut."""
    rows = add_row_features(_prepped(spark, sf_dir), LABEL_INPUTS).select("event_id", *LABEL_INPUTS)
    return heuristic_labels(store(rows, "label-inputs").df).select("event_id", "is_attack")


@named("top_suspicious")
def top_suspicious_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_row_features(_prepped(spark, sf_dir))
    return top_suspicious(rows).select(
        "event_id",
        "timestamp",
        "process_image",
        "parent_image",
        "command_line",
        "suspicious_parent",
        "dump_precursor",
        "hidden_flags",
        "suspicion",
    )


@named("feature_correlation")
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.feature_correlation(_stored_features(spark, sf_dir)))


@named("feature_histograms")
def feature_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.feature_histograms(_stored_features(spark, sf_dir)))


@query
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_counts(labels_heuristic(spark, sf_dir))


# --- models (no SQL twin) -----------------------------------------------------


@query
def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.rf_importance(heuristic_labels(_stored_features(spark, sf_dir)))


@query
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.fit_and_score(build_features(_prepped(spark, sf_dir)))[1]


@query
def forest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: features, forest, bands, gate, attributions."""
    prepped = _prepped(spark, sf_dir)
    trace = [c for c in TRACE_COLUMNS if c in prepped.columns]
    features = build_features(prepped, keep=trace)
    model, scored = forest.fit_and_score(features, keep=[*trace, *FEATURES])
    gated, _, _ = gating.gate(scored)
    flagged = gated.where("flagged")
    return attribution.append_attributions(flagged, model).select(
        "event_id", "anomaly_score", "risk_level", "explanation"
    )


@named("attribution")
def attribution_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of the rows the forest calls anomalous, in long form."""
    features = _stored_features(spark, sf_dir)
    model, scores = forest.fit_and_score(features)
    anomalous = scores.where("is_anomaly = 1").join(features, "event_id")
    values = attribution.attributions(anomalous, model, "values")
    named = F.arrays_zip(F.array(*[F.lit(n) for n in FEATURES]).alias("feature"), F.col("values").alias("value"))
    return values.select("event_id", F.inline(named))


# --- scores, bands and gate ---------------------------------------------------


@query
def score_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.describe_score(_scored(spark, sf_dir)))


@query
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = [0.02, 0.05, 0.10, 0.20]
    return _rounded(evaluate.score_quantiles(_scored(spark, sf_dir), probs))


@query
def score_quantiles_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, narrowed down by sketches as a column of very many values is."""
    probs = [0.02, 0.05, 0.10, 0.20]
    return _rounded(evaluate.score_quantiles(_scored(spark, sf_dir), probs, max_values=50))


@query
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.score_histogram(_scored(spark, sf_dir)))


@query
def score_bins20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.score_bins(_scored(spark, sf_dir)))


@query
def top_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_anomalies(_scored(spark, sf_dir))


def _surrogate_anomaly(scored: DataFrame) -> Column:
    cut = gating.gate_threshold(scored)
    return (F.col("anomaly_score") < F.lit(cut)).cast("int")


@query
def anomaly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    scored = scored.withColumn("is_anomaly", _surrogate_anomaly(scored))
    labels = heuristic_labels(scored).select("event_id", "is_attack")
    labelled = evaluate.with_labels(scored.select("event_id", "is_anomaly"), labels)
    return _rounded(evaluate.precision_recall(labelled, F.col("is_anomaly") == 1))


@query
def labelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with a label table that lists attacks only: the others are 0."""
    rows = add_row_features(_prepped(spark, sf_dir))
    labels = heuristic_labels(rows).where("is_attack = 1")
    return evaluate.with_labels(rows.select("event_id"), labels)


@query
def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a label in a table that lists attacks only."""
    rows = add_row_features(_prepped(spark, sf_dir))
    labels = heuristic_labels(rows).where("is_attack = 1")
    return evaluate.labelled_rows(rows, labels).select("event_id")


@query
def any_label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether scored rows meet the labels, and whether they meet none."""
    rows = add_row_features(_prepped(spark, sf_dir)).select("event_id", "pid", *LABEL_INPUTS)
    labels = heuristic_labels(rows)
    found = [
        ("all", evaluate.any_overlap(rows, labels)),
        ("shifted", evaluate.any_overlap(rows, labels.withColumn("event_id", -F.col("event_id") - 1))),
    ]
    return spark.createDataFrame(found, "labels string, overlap boolean")


# --- invariants of the fitted models --------------------------------------------


@query
def forest_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tree: rows at the root, rows over its leaves, whether it is too deep."""
    model, _ = forest.fit_and_score(build_features(_prepped(spark, sf_dir)))
    leaf = F.col("feature") < 0
    return model.nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).alias("root_size"),
        F.sum(F.when(leaf, F.col("size"))).alias("leaf_rows"),
        (F.max("depth") <= F.lit(model.height)).alias("depth_ok"),
    )


@query
def forest_alert_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prepared row is scored, and at most the contamination is anomalous."""
    scores = forest.fit_and_score(build_features(_prepped(spark, sf_dir)))[1]
    return scores.agg(
        F.count(F.lit(1)).alias("n_rows"),
        # The quantile may lie between two rows.
        (F.sum("is_anomaly") <= F.lit(forest.CONTAMINATION) * F.count(F.lit(1)) + 1).alias("rate_ok"),
        F.count_if(F.col("is_anomaly") != (F.col("anomaly_score") < 0).cast("int")).alias("odd_rows"),
    )


@query
def importance_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importances of the random forest are shares of one."""
    rows = rf_importance(spark, sf_dir)
    return _rounded(
        rows.agg(
            F.count(F.lit(1)).alias("features"),
            F.sum("importance").alias("total"),
            F.count_if(F.col("importance") < 0).alias("negative"),
        )
    )


@query
def attribution_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and base add up to the mean path, on every anomalous row."""
    features = _stored_features(spark, sf_dir)
    model, scores = forest.fit_and_score(features)
    anomalous = scores.where("is_anomaly = 1").join(features, "event_id")
    values = attribution.attributions(forest.raw_scores(anomalous, model), model, "values")
    scale = float(forest.average_path(model.sample_size))
    path = -F.log2(-F.col("raw_score")) * scale
    total = F.aggregate("values", F.lit(attribution.base_value(model)), lambda a, x: a + x)
    return values.agg(
        (F.count(F.lit(1)) > 0).alias("any_row"), (F.max(F.abs(total - path)) < 1e-6).alias("sums_ok")
    )


@query
def flagged_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions are appended to the explanations of flagged rows, and to no others."""
    prepped = _prepped(spark, sf_dir)
    features = build_features(prepped, keep=["command_line", "process_image"])
    model, scored = forest.fit_and_score(features, keep=["command_line", "process_image", *FEATURES])
    rows = attribution.append_attributions(gating.gate(scored)[0], model)
    has = F.contains("explanation", F.lit("Top features:"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("flagged") & ~has).alias("flagged_without"),
        F.count_if(~F.col("flagged") & has).alias("others_with"),
    )


@query
def scored_with_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = process_events(spark, sf_dir)
    scores = events.select("event_id", F.col("value").alias("anomaly_score"))
    return forest.with_trace(scores, _prepped(spark, sf_dir))


@query
def scored_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = process_events(spark, sf_dir)
    scored = events.select("event_id", "timestamp", F.col("value").alias("anomaly_score"))
    features = add_row_features(_prepped(spark, sf_dir))
    merged = gating.merge_scored(scored, features)
    return merged.select(
        "event_id", "timestamp", "anomaly_score", "suspicious_parent", "hidden_flags", "long_cmd"
    )


@query
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.add_risk_level(_scored(spark, sf_dir)).select("event_id", "risk_level")


@query
def custom_risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bands of one's own; the absent ones never match."""
    bands = {"Critical": 0.01, "Medium": 0.5}
    banded = gating.add_risk_level(_scored(spark, sf_dir), quantiles=bands)
    return banded.select("event_id", "risk_level")


@named("strong_indicator")
def strong_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return scored.select("event_id", gating.strong_indicator(scored).alias("strong"))


@query
def gated_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.add_flagged(_scored(spark, sf_dir))[0].select("event_id", "flagged")


@query
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select(
        "event_id", "anomaly_score", "risk_level", "flagged", "explanation"
    )


@query
def reasons_of_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason text for every row, as if all were flagged."""
    scored = _scored(spark, sf_dir)
    return scored.select("event_id", gating.explanation(scored).alias("explanation"))


@query
def format_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    values = F.array(
        F.col("anomaly_score") - 50.0,
        F.col("hidden_flags") * 1.0 - 1.25,
        -F.col("lolbin_ratio"),
        F.col("unusual_chain") * 1.0,
    )
    names = ["score", "flags", "lolbin", "chain"]
    return rows.select("event_id", top_features(values, names).alias("suffix"))


def _labelled_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristic_labels(gating.add_flagged(_scored(spark, sf_dir))[0])


@query
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        evaluate.precision_recall(_labelled_gate(spark, sf_dir), F.col("flagged"))
    )


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(_labelled_gate(spark, sf_dir), F.col("flagged"))


@query
def pattern_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pattern_counts(gating.add_flagged(_scored(spark, sf_dir))[0])


@query
def top_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.top_flagged(_gated(spark, sf_dir))


@named("threshold_config")
def gate_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = threshold_config(spark, gating.gate_threshold(_scored(spark, sf_dir)))
    bound = F.col("risk_level_bounds")
    return _rounded(
        config.select(
            "score_threshold",
            bound["Critical"].alias("critical"),
            bound["High"].alias("high"),
            bound["Medium"].alias("medium"),
            bound["Low"].alias("low"),
            "strong_indicator_definition",
            "shap_enabled",
        )
    )


# --- triage -------------------------------------------------------------------


@query
def intake_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns, some unreadable, counted and judged."""
    eid = F.col("event_id")
    loose = process_events(spark, sf_dir).select(
        F.when(eid % 5 == 0, F.lit("not a date")).otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
        F.when(eid % 7 == 0, F.lit("abc")).otherwise(F.col("pid").cast("string")).alias("pid"),
        F.when(eid % 11 == 0, F.lit("")).otherwise(F.col("ppid").cast("string")).alias("ppid"),
    )
    return intake.accepted(intake.intake_counts(loose))


@query
def intake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Externally named and typed events, accepted and filled."""
    loose = process_events(spark, sf_dir).select(
        "event_id",
        F.col("timestamp").cast("string").alias("timestamp"),
        F.col("process_image").alias("image"),
        F.col("parent_image").alias("parent image"),
        "command_line",
        F.col("pid").cast("string").alias("pid"),
        F.col("ppid").cast("double").alias("ppid"),
        "event_type",
        F.col("value").alias("anomaly_score"),
    )
    accepted = intake.check_events(loose).events
    return accepted.select(
        "event_id", "process_image", "parent_image", "pid", "ppid", "risk_level", "flagged", "explanation"
    )


@query
def fill_risk_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = _scored(spark, sf_dir).select("event_id", "anomaly_score")
    return intake.fill_risk_and_flagged(bare)


@query
def alert_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.alert_set(gating.add_flagged(_scored(spark, sf_dir))[0]).select("event_id")


@query
def alert_set_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback without a flagged column: every band but Normal."""
    return triage.alert_set(gating.add_risk_level(_scored(spark, sf_dir))).select("event_id")


@query
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(triage.kpi_summary(gating.add_flagged(_scored(spark, sf_dir))[0]))


@query
def top_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.top_values(gating.add_flagged(_scored(spark, sf_dir))[0], "process_image")


@query
def top_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.top_values(gating.add_flagged(_scored(spark, sf_dir))[0], "parent_image")


@query
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.risk_distribution(gating.add_risk_level(_scored(spark, sf_dir)))


@named("triage_view")
def triage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triage.triage_rows(
        _gated(spark, sf_dir), levels=["Critical", "High"], keyword="powershell|vssadmin",
        sort_by="risk_level",
    )
    return triage.triage_view(rows)


@query
def triage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest alerts first, the first twenty with full command line."""
    rows = triage.triage_rows(_gated(spark, sf_dir), sort_by="timestamp", ascending=False)
    return rows.limit(20).select("event_id", "timestamp", "command_line")


@query
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.filter_keyword(_scored(spark, sf_dir), "LSASS|-enc\\b").select("event_id")


@query
def risk_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = gating.add_risk_level(_scored(spark, sf_dir))
    return banded.select("event_id", triage.risk_rank(F.col("risk_level")).alias("risk_rank"))


# --- streaming alerts ---------------------------------------------------------


# --- the jobs, through the tables they write --------------------------------------


@query
def job_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = scratch_path(spark, "job-ingest")
    jobs.ingest_job(spark, _write_raw(spark, sf_dir, "job-logs"), output)
    return spark.read.parquet(f"{output}/events.parquet").select(*CORE_COLUMNS, *TARGET_COLUMNS)


def _feature_job(spark: SparkSession, sf_dir: str) -> str:
    output = scratch_path(spark, "job-features")
    jobs.feature_job(process_events(spark, sf_dir), output, eda=False, importances=False)
    return output


@query
def job_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as the job stores them."""
    output = _feature_job(spark, sf_dir)
    return _rounded(spark.read.parquet(f"{output}/X_features.parquet"))


@query
def job_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _feature_job(spark, sf_dir)
    return artifacts.read_labels(spark, f"{output}/y_labels.parquet")


def _gate_job(spark: SparkSession, sf_dir: str) -> str:
    return _gate_job_report(spark, sf_dir)[0]


def _gate_job_report(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, DataFrame]]:
    """The gate after the feature job, with ``value`` as the score."""
    output = _feature_job(spark, sf_dir)
    prepped = spark.read.parquet(f"{output}/events_prepped.parquet")
    artifacts.save_scored(
        prepped.withColumnRenamed("value", "anomaly_score").withColumn("is_anomaly", F.lit(0)),
        f"{output}/scored_events.parquet",
        by_source=True,
    )
    return output, jobs.gate_job(spark, output, attributions=False)


@query
def job_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated events as the job stores them, read back as the triage reads them."""
    output = _gate_job(spark, sf_dir)
    rows = intake.read_gated(spark, f"{output}/scored_events_gated.parquet")
    return rows.select("event_id", "anomaly_score", "risk_level", "flagged", "explanation")


def _listed(part: str, rows: DataFrame, name: Column, value: Column) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("double").alias("value"))


@query
def job_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate job's report in long form: pattern counts, metrics and confusion
    against the labels that the feature job stored, and the top from its CSV file."""
    output, report = _gate_job_report(spark, sf_dir)
    metrics = report["metrics"].unpivot([], ["tp", "fp", "fn", "precision", "recall", "f1"], "name", "value")
    confusion = report["confusion"].unpivot("is_attack", ["predicted_0", "predicted_1"], "guess", "n")
    top = spark.read.csv(f"{output}/top_flagged_gated.csv", header=True, escape='"')
    return _rounded(
        _listed("patterns", report["patterns"], F.col("pattern"), F.col("hits"))
        .unionAll(_listed("metrics", metrics, F.col("name"), F.col("value")))
        .unionAll(_listed("confusion", confusion, F.concat_ws(" ", "is_attack", "guess"), F.col("n")))
        .unionAll(_listed("top", top, F.concat_ws(" ", "event_id", "risk_level"), F.col("anomaly_score")))
    )


@query
def job_top_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most suspicious events of the feature job, read back from its CSV file."""
    output = _feature_job(spark, sf_dir)
    top = spark.read.csv(f"{output}/top_suspicious.csv", header=True, escape='"')
    return top.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        "process_image",
        F.col("suspicion").cast("int").alias("suspicion"),
    )


@query
def job_eda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlations and histograms of the feature job's report, in long form."""
    output = scratch_path(spark, "job-eda")
    report = jobs.feature_job(process_events(spark, sf_dir), output, importances=False)
    return _rounded(
        _listed("correlation", report["correlation"], F.concat_ws(" ", "feature_a", "feature_b"), F.col("correlation"))
        .unionAll(_listed("histogram", report["histograms"], F.concat_ws(" ", "feature", "bin"), F.col("n")))
    )


def _score_job(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, DataFrame]]:
    """The score job after the feature job, with its own fitted forest."""
    output = _feature_job(spark, sf_dir)
    return output, jobs.score_job(spark, output)


@query
def job_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored forest, loaded again, gives every stored score."""
    output, _ = _score_job(spark, sf_dir)
    model = forest.load_forest(spark, f"{output}/forest")
    stored = spark.read.parquet(f"{output}/scored_events.parquet")
    again = forest.score(spark.read.parquet(f"{output}/X_features.parquet"), model).select(
        "event_id", F.col("anomaly_score").alias("again"), F.col("is_anomaly").alias("again_anomaly")
    )
    same = F.col("anomaly_score").eqNullSafe(F.col("again")) & (F.col("is_anomaly") == F.col("again_anomaly"))
    return stored.join(again, "event_id", "full").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.coalesce(same, F.lit(False))).alias("other_scores"),
        F.count("process_image").alias("with_trace"),
        (F.sum("is_anomaly") <= F.lit(forest.CONTAMINATION) * F.count(F.lit(1)) + 1).alias("rate_ok"),
        F.lit(model.trees).cast("bigint").alias("trees"),
    )


@query
def job_score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the score report must agree on: its tables with the stored scores."""
    output, report = _score_job(spark, sf_dir)
    stored = spark.read.parquet(f"{output}/scored_events.parquet")
    low = {r["p"]: r["score"] for r in report["thresholds"].collect()}  # two rows
    described, metrics = report["describe"].first(), report["metrics"].first()
    top = spark.read.csv(f"{output}/top_anomalies.csv", header=True, escape='"').select(
        F.col("anomaly_score").cast("double").alias("listed")
    )
    return stored.agg(
        F.lit(described["count"]).cast("bigint").alias("described"),
        F.lit(report["histogram"].agg(F.sum("n")).first()[0]).cast("bigint").alias("in_histogram"),
        # The quantile may lie between two rows.
        (F.count_if(F.col("anomaly_score") < low[0.05]) <= 0.05 * F.count(F.lit(1)) + 1).alias("q05_ok"),
        (F.count_if(F.col("anomaly_score") <= low[0.10]) >= 0.10 * F.count(F.lit(1)) - 1).alias("q10_ok"),
        (F.sum("is_anomaly") == F.lit(metrics["tp"] + metrics["fp"])).alias("metrics_ok"),
        (F.abs(F.min("anomaly_score") - F.lit(top.agg(F.min("listed")).first()[0])) < 1e-12).alias("top_ok"),
        F.lit(top.count()).cast("bigint").alias("listed"),
    )


@query
def job_gate_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate job by its defaults after the score job: attributions on flagged
    rows and no others, and a published snapshot with the forest."""
    output, _ = _score_job(spark, sf_dir)
    config = jobs.gate_job(spark, output)["config"].first()
    rows = spark.read.parquet(f"{output}/scored_events_gated.parquet")
    snapshot = load_snapshot(spark, f"{output}/snapshot")
    has = F.contains("explanation", F.lit("Top features:"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("flagged") & ~has).alias("flagged_without"),
        F.count_if(~F.col("flagged") & has).alias("others_with"),
        (F.lit(config["shap_enabled"]) == (F.count_if("flagged") > 0)).alias("enabled_ok"),
        F.lit(snapshot.forest is not None and snapshot.threshold == config["score_threshold"]).alias("snapshot_ok"),
    )


@query
def importance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importances come largest first, equal ones by name."""
    rows = [(r["importance"], r["feature"]) for r in rf_importance(spark, sf_dir).collect()]  # a row for each feature
    ordered = rows == sorted(rows, key=lambda r: (-r[0], r[1]))
    return spark.createDataFrame([(len(rows), ordered)], "features bigint, ordered boolean")


@query
def job_gate_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold in the stored JSON object."""
    output = _gate_job(spark, sf_dir)
    config = spark.read.json(f"{output}/threshold_config.json")
    return _rounded(config.select("score_threshold", "shap_enabled"))


@query
def job_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two bands, from a CSV file through the triage job and its export."""
    output = _gate_job(spark, sf_dir)
    gated = spark.read.parquet(f"{output}/scored_events_gated.parquet")
    gated.withColumn("timestamp", F.col("timestamp").cast("string")).drop("target_pid").write.option(
        "header", True
    ).option("escape", '"').csv(f"{output}/external.csv")
    jobs.triage_job(spark, f"{output}/external.csv", levels=["Critical", "High"], export=f"{output}/alerts.csv")
    back = spark.read.csv(f"{output}/alerts.csv", header=True, escape='"')
    return back.select(F.col("event_id").cast("bigint").alias("event_id"), "risk_level")


@query
def intake_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are refused: by extension, missing columns, and none."""
    folder = scratch_path(spark, "intake")
    events = process_events(spark, sf_dir).withColumnRenamed("value", "anomaly_score")
    events.write.parquet(f"{folder}/good.parquet")
    events.drop("pid").write.parquet(f"{folder}/no_pid.parquet")
    events.select("event_id").write.json(f"{folder}/events.json")
    found = [
        (name, intake.read_intake(spark, f"{folder}/{name}").events is not None)
        for name in ("good.parquet", "no_pid.parquet", "events.json")
    ]
    return spark.createDataFrame(found, "file string, accepted boolean")


@query
def pid_depth_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths with a lookup too large to broadcast and few hot keys."""
    prepped = _prepped(spark, sf_dir)
    return pid_depth(prepped, graph_table(prepped), SHUFFLED).select("event_id", "pid_depth")


@query
def rare_pair_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepped = _prepped(spark, sf_dir)
    rows = add_rare_parent_child(prepped, pair_table(prepped), SHUFFLED)
    return _rounded(rows.select("event_id", "rare_parent_child"))


def _snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    prepped = _prepped(spark, sf_dir)
    scored = add_row_features(prepped).withColumnRenamed("value", "anomaly_score")
    bounds = gating.risk_bounds(scored)
    return Snapshot(
        graph=graph_table(prepped),
        pairs=pair_table(prepped),
        bounds=bounds,
        threshold=bounds["High"],
    )


def _stream_alerts(spark: SparkSession, sf_dir: str, snapshot: Snapshot) -> DataFrame:
    # A file stream wants a folder; the driver's table may be a single file.
    table = store(spark.read.parquet(f"{sf_dir}/events.parquet"), "alerts-in")
    events = spark.readStream.schema(table.df.schema).parquet(table.path)
    output = scratch_path(spark, "alerts")
    start_alerts(
        process_view(events),
        snapshot,
        output,
        scratch_path(spark, "alerts-checkpoint"),
        scorer=lambda rows: rows.withColumnRenamed("value", "anomaly_score"),
    ).awaitTermination()
    return _rounded(
        spark.read.parquet(output).select(
            "event_id", "pid_depth", "time_delta_parent", "rare_parent_child",
            "risk_level", "explanation",
        )
    )


@query
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the event stream against the snapshot of a batch run."""
    return _stream_alerts(spark, sf_dir, _snapshot(spark, sf_dir))


@query
def stream_alerts_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a snapshot that was saved and loaded."""
    path = scratch_path(spark, "snapshot")
    save_snapshot(_snapshot(spark, sf_dir), path)
    return _stream_alerts(spark, sf_dir, load_snapshot(spark, path))


def _pid_score(rows: DataFrame) -> DataFrame:
    """A stand-in for the forest, of columns that raw logs have."""
    score = (F.col("pid") * 31 + F.col("ppid") * 17) % 1009 / F.lit(1009.0) - F.lit(0.02)
    return rows.withColumn("anomaly_score", score)


def end_to_end(spark: SparkSession, sf_dir: str, max_files: int | None) -> DataFrame:
    """Alerts of raw files: a batch run leaves the snapshot, then one stream
    reads the files and a second one the first one's table."""
    folder = _sorted_logs(spark, sf_dir)
    batch = prep_events(store(combined_events(spark, folder), "batch-events").df)
    scored = _pid_score(add_row_features(batch))
    bounds = gating.risk_bounds(scored)
    output = scratch_path(spark, "end-to-end")
    save_snapshot(Snapshot(graph_table(batch), pair_table(batch), bounds, bounds["High"]), f"{output}/snapshot")
    events = f"{output}/events"
    start_ingest(
        spark, {s: f"{folder}/{name}" for s, name in RAW_FILES.items()}, events, f"{output}/ingested", max_files=max_files
    ).awaitTermination()
    start_alerts(
        spark.readStream.schema(spark.read.parquet(events).schema).parquet(events),
        latest_snapshot(spark, f"{output}/snapshot"),
        f"{output}/alerts",
        f"{output}/alerted",
        scorer=_pid_score,
    ).awaitTermination()
    return spark.read.parquet(f"{output}/alerts")


@query
def stream_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        end_to_end(spark, sf_dir, 3).select(
            "source", "timestamp", "pid", "ppid", "command_line", "pid_depth", "time_delta_parent",
            "rare_parent_child", "risk_level", "explanation",
        )
    )
