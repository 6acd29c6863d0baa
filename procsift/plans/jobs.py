"""The pipeline's batch jobs. Each reads and writes tables, so a stage can be
run, repeated and resumed on its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsift.operators import attribution, evaluate, forest, gating, importance, triage
from procsift.operators.features import (
    build_features,
    graph_table,
    heuristic_labels,
    pair_table,
    top_suspicious,
)
from procsift.operators.prep import (
    event_type_counts,
    null_summary,
    prep_events,
    suspicious_match,
)
from procsift.schema import FEATURES, RAW_FILES, RISK_QUANTILES
from procsift.session import scratch_scope
from procsift.sources import artifacts
from procsift.sources.intake import Intake, read_intake
from procsift.sources.rawlogs import PARSERS, malformed_counts
from procsift.sources.unified import combined_events, raw_lines
from procsift.streaming import alerts, ingest

def _clean(job: Callable) -> Callable:
    """Drop a job's scratch tables once its output is written."""

    @wraps(job)
    def run(first: SparkSession | DataFrame, *args, **settings):
        with scratch_scope(first if isinstance(first, SparkSession) else first.sparkSession):
            return job(first, *args, **settings)

    return run


SUSPICIOUS_COLUMNS = ["timestamp", "event_type", "process_image", "parent_image", "command_line"]


# --- ingest -------------------------------------------------------------------


def ingest_report(events: DataFrame) -> dict[str, DataFrame]:
    """Sanity tables over unified events."""
    match = suspicious_match(events)
    shown = [c for c in SUSPICIOUS_COLUMNS if c in events.columns]
    return {
        "event_types": event_type_counts(events),
        "nulls": null_summary(events),
        "suspicious_count": events.agg(F.count_if(match).alias("n")),
        "suspicious_rows": events.where(match).orderBy("event_id").select("event_id", *shown).limit(5),
    }


def raw_report(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """Per source: its event types before normalising, and the bad lines."""
    parsed = {s: PARSERS[s](lines) for s, lines in raw_lines(spark, data_dir).items()}
    report = {f"event_types_{s}": event_type_counts(p.where(~F.col("malformed"))) for s, p in parsed.items()}
    if parsed:
        report["malformed"] = malformed_counts(parsed)
    return report


@_clean
def ingest_job(
    spark: SparkSession, data_dir: str, output: str, *, timestamp_mode: str = "column"
) -> dict[str, DataFrame]:
    """Raw logs to one event table with ids, partitioned by source."""
    events = combined_events(spark, data_dir, timestamp_mode=timestamp_mode)
    path = f"{output}/events.parquet"
    events.write.mode("overwrite").partitionBy("source").parquet(path)
    return ingest_report(spark.read.parquet(path))


# --- the stream's snapshot ------------------------------------------------------


def _stage(spark: SparkSession, output: str, **parts: str) -> None:
    """Parts of the next snapshot, as the jobs of one run leave them."""
    alerts.publish(spark, f"{output}/snapshot/staged", **parts)


def _publish(spark: SparkSession, output: str, **parts: str) -> None:
    """All parts of a run as one version, if its jobs have left them all."""
    _stage(spark, output, **parts)
    staged = alerts.latest_parts(spark, f"{output}/snapshot/staged")
    if "tables" in staged:
        alerts.publish(spark, f"{output}/snapshot", **staged)


# --- features -----------------------------------------------------------------


def eda_report(features: DataFrame) -> dict[str, DataFrame]:
    """Correlations and histograms; empty below two features."""
    if len([c for c in FEATURES if c in features.columns]) < 2:
        return {}
    return {
        "correlation": evaluate.feature_correlation(features),
        "histograms": evaluate.feature_histograms(features),
    }


@_clean
def feature_job(
    events: DataFrame,
    output: str,
    *,
    top_n: int = 20,
    eda: bool = True,
    importances: bool = True,
    path_mode: str = "compat",
) -> dict[str, DataFrame]:
    """Events with ids to features, labels and prepared events, plus reports."""
    spark = events.sparkSession
    prepped = prep_events(events, path_mode=path_mode)
    prepped.write.mode("overwrite").parquet(f"{output}/events_prepped.parquet")
    prepped = spark.read.parquet(f"{output}/events_prepped.parquet")
    graph, pairs = graph_table(prepped), pair_table(prepped)
    tables = alerts.save_tables(graph, pairs, f"{output}/snapshot")
    features = build_features(prepped, graph=graph, pairs=pairs)
    features.write.mode("overwrite").parquet(f"{output}/X_features.parquet")
    features = spark.read.parquet(f"{output}/X_features.parquet")
    labelled = heuristic_labels(features)
    labelled.select("event_id", "is_attack").write.mode("overwrite").parquet(
        f"{output}/y_labels.parquet"
    )
    report = eda_report(features) if eda else {}
    if importances:
        report["importance"] = importance.rf_importance(labelled)
    leaders = top_suspicious(features.drop("timestamp"), top_n)
    shown = prepped.select("event_id", *[c for c in SUSPICIOUS_COLUMNS if c in prepped.columns])
    # At most top_n rows on one side.
    top = shown.join(F.broadcast(leaders), "event_id").orderBy(F.desc("suspicion"), "event_id")
    artifacts.save_top(top, f"{output}/top_suspicious.csv")
    report["top_suspicious"] = top
    _stage(spark, output, tables=tables)
    return report


# --- scores -------------------------------------------------------------------


def score_report(
    scored: DataFrame, labels: DataFrame | None, *, top_n: int = 20
) -> dict[str, DataFrame]:
    """Metrics (where any row has a label), score tables and the top list."""
    report = {
        "describe": evaluate.describe_score(scored),
        "histogram": evaluate.score_histogram(scored),
        "thresholds": evaluate.score_quantiles(scored, [0.05, 0.10]),
        "top_anomalies": evaluate.top_anomalies(scored, top_n),
    }
    if labels is not None and evaluate.any_overlap(scored, labels):
        labelled = evaluate.with_labels(scored, labels)
        report["metrics"] = evaluate.precision_recall(labelled, F.col("is_anomaly") == 1)
    return report


@_clean
def score_job(
    spark: SparkSession,
    output: str,
    *,
    features_path: str | None = None,
    labels_path: str | None = None,
    events_path: str | None = None,
    contamination: float | str = forest.CONTAMINATION,
    trees: int = forest.TREES,
    max_samples: int | str = forest.SAMPLE_SIZE,
    top_n: int = 20,
) -> dict[str, DataFrame]:
    """Fit, score, evaluate; store the forest and the scored events."""
    features = spark.read.parquet(features_path or f"{output}/X_features.parquet")
    events = artifacts.read_optional(spark, events_path or f"{output}/events_prepped.parquet")
    labels = artifacts.read_labels(spark, labels_path or f"{output}/y_labels.parquet")
    model, scores = forest.fit_and_score(
        features, contamination=contamination, trees=trees, max_samples=max_samples
    )
    forest.save_forest(model, f"{output}/forest")
    _stage(spark, output, forest=alerts.save_model(model, f"{output}/snapshot"))
    artifacts.save_scored(
        forest.with_trace(scores, events), f"{output}/scored_events.parquet"
    )
    scored = spark.read.parquet(f"{output}/scored_events.parquet")
    report = score_report(scored, labels, top_n=top_n)
    artifacts.save_top(report["top_anomalies"], f"{output}/top_anomalies.csv")
    return report


# --- gate ---------------------------------------------------------------------


def gate_report(
    gated: DataFrame, labels: DataFrame | None, *, top_n: int = 20
) -> dict[str, DataFrame]:
    report = {
        "patterns": evaluate.pattern_counts(gated),
        "top_flagged": evaluate.top_flagged(gated, top_n),
    }
    if labels is not None and evaluate.any_overlap(gated, labels):
        labelled = evaluate.with_labels(gated, labels)
        report["metrics"] = evaluate.precision_recall(labelled, F.col("flagged"))
        report["confusion"] = evaluate.confusion_matrix(labelled, F.col("flagged"))
    return report


@_clean
def gate_job(
    spark: SparkSession,
    output: str,
    *,
    scored_path: str | None = None,
    features_path: str | None = None,
    labels_path: str | None = None,
    model_path: str | None = None,
    score_threshold: float | None = None,
    top_n: int = 20,
    attributions: bool = True,
) -> dict[str, DataFrame]:
    """Bands, gate, explanations, attributions; store gated events and config."""
    scored = spark.read.parquet(scored_path or f"{output}/scored_events.parquet")
    features = spark.read.parquet(features_path or f"{output}/X_features.parquet")
    labels = artifacts.read_labels(spark, labels_path or f"{output}/y_labels.parquet")
    merged = gating.merge_scored(scored, features)
    # Bounds come from the narrow scored table, not from the join.
    bounds = gating.risk_bounds(scored)
    threshold = bounds["High"] if score_threshold is None else score_threshold
    gated = gating.add_risk_level(merged, bounds=bounds)
    limits = alerts.save_limits(spark, bounds, threshold, f"{output}/snapshot")
    gated, threshold = gating.add_flagged(gated, threshold)
    gated = gating.add_explanations(gated)
    model = forest.load_forest(spark, model_path or f"{output}/forest") if attributions else None
    gated = attribution.append_attributions(gated, model)
    artifacts.save_gated(gated, f"{output}/scored_events_gated.parquet")
    gated = spark.read.parquet(f"{output}/scored_events_gated.parquet")
    report = gate_report(gated, labels, top_n=top_n)
    artifacts.save_top(report["top_flagged"], f"{output}/top_flagged_gated.csv")
    with_text = gated.where(F.col("flagged") & F.contains("explanation", F.lit("Top features:")))
    report["config"] = artifacts.threshold_config(
        spark,
        threshold,
        RISK_QUANTILES,
        shap_enabled=model is not None and not with_text.isEmpty(),
    )
    artifacts.save_config(report["config"], f"{output}/threshold_config.json")
    _publish(spark, output, limits=limits)
    return report


# --- triage -------------------------------------------------------------------


@dataclass(frozen=True)
class Triage:
    intake: Intake
    rows: DataFrame | None = None
    report: dict[str, DataFrame] | None = None


def triage_report(events: DataFrame) -> dict[str, DataFrame]:
    report = {
        "kpi": triage.kpi_summary(events),
        "top_images": triage.top_values(events, "process_image"),
        "top_parents": triage.top_values(events, "parent_image"),
    }
    if "risk_level" in events.columns:
        report["risk_levels"] = triage.risk_distribution(events)
    if "anomaly_score" in events.columns:
        report["score_bins"] = evaluate.score_bins(events)
    return report


def triage_job(
    spark: SparkSession,
    path: str,
    *,
    levels: list[str] | None = None,
    keyword: str | None = None,
    sort_by: str = "anomaly_score",
    ascending: bool = True,
    export: str | None = None,
) -> Triage:
    """Checked intake, alert filters and sort, optional CSV export."""
    intake = read_intake(spark, path)
    if intake.events is None or "risk_level" not in intake.events.columns:
        return Triage(intake)
    rows = triage.triage_rows(
        intake.events, levels=levels, keyword=keyword, sort_by=sort_by, ascending=ascending
    )
    if export:
        artifacts.export_rows(rows, export)
    return Triage(intake, rows, triage_report(intake.events))


# --- streams ------------------------------------------------------------------


def stream_ingest_job(
    spark: SparkSession, data_dir: str, output: str, *, max_files: int | None = None
) -> None:
    """New files of the raw logs' folders, each once, to ``events_stream.parquet``."""
    folders = {s: f"{data_dir.rstrip('/')}/{name}" for s, name in RAW_FILES.items()}
    ingest.start_ingest(
        spark, folders, f"{output}/events_stream.parquet", f"{output}/events_checkpoint", max_files=max_files
    ).awaitTermination()


def stream_alerts_job(spark: SparkSession, events_path: str, output: str) -> None:
    """New files of an event table with ids, such as the stream ingest writes,
    gated against the last snapshot that the batch jobs published in ``output``,
    to ``alerts_stream``."""
    schema = spark.read.parquet(events_path).schema
    events = spark.readStream.schema(schema).parquet(events_path)
    alerts.start_alerts(
        events, alerts.latest_snapshot(spark, f"{output}/snapshot"), f"{output}/alerts_stream", f"{output}/alerts_checkpoint"
    ).awaitTermination()
