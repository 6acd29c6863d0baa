"""Command line of the batch jobs, for spark-submit or ``python -m procsift``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from procsift.plans import jobs


def _share_or_auto(text: str) -> float | str:
    return text if text == "auto" else float(text)


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="procsift")
    steps = parser.add_subparsers(dest="step", required=True)

    ingest = steps.add_parser("ingest", help="raw logs to one event table")
    ingest.add_argument("--data-dir", default="data")
    ingest.add_argument("--output-dir", default="output")
    ingest.add_argument("--timestamp-mode", choices=["column", "row"], default="column")
    ingest.add_argument("--no-normalize", action="store_true", help="report on raw frames only")

    features = steps.add_parser("features", help="features, labels, reports")
    features.add_argument("--output-dir", default="output")
    features.add_argument("--top-n", type=int, default=20)
    features.add_argument("--no-eda", action="store_true")
    features.add_argument("--path-mode", choices=["compat", "windows"], default="compat")

    scores = steps.add_parser("score", help="fit, score, evaluate")
    scores.add_argument("--output-dir", default="output")
    scores.add_argument("--x-path")
    scores.add_argument("--y-path")
    scores.add_argument("--events-path")
    scores.add_argument("--contamination", type=_share_or_auto, default=0.05)
    scores.add_argument("--n-estimators", type=int, default=150)
    scores.add_argument("--max-samples", type=int, default=256)
    scores.add_argument("--top-n", type=int, default=20)

    gate = steps.add_parser("gate", help="bands, gate, explanations")
    gate.add_argument("--output-dir", default="output")
    gate.add_argument("--scored-path")
    gate.add_argument("--x-path")
    gate.add_argument("--y-path")
    gate.add_argument("--model-path")
    gate.add_argument("--score-threshold", type=float)
    gate.add_argument("--top-n", type=int, default=20)
    gate.add_argument("--no-shap", action="store_true")

    triage = steps.add_parser("triage", help="filter, sort and export alerts")
    triage.add_argument("path")
    triage.add_argument("--risk", nargs="*")
    triage.add_argument("--keyword")
    triage.add_argument("--sort-by", default="anomaly_score")
    triage.add_argument("--descending", action="store_true")
    triage.add_argument("--export")

    stream = steps.add_parser("stream-ingest", help="new files of log folders, each once")
    stream.add_argument("--data-dir", default="data")
    stream.add_argument("--output-dir", default="output")
    stream.add_argument("--max-files", type=int, help="files of a batch")

    watch = steps.add_parser("stream-alerts", help="alerts of new events against the last batch run")
    watch.add_argument("events", help="folder of an event table with ids")
    watch.add_argument("--output-dir", default="output")
    return parser.parse_args()


def main() -> None:
    args = _arguments()
    spark = SparkSession.builder.appName(f"procsift {args.step}").getOrCreate()
    if args.step == "ingest":
        if args.no_normalize:
            report = jobs.raw_report(spark, args.data_dir)
        else:
            report = jobs.ingest_job(
                spark, args.data_dir, args.output_dir, timestamp_mode=args.timestamp_mode
            )
    elif args.step == "features":
        events = spark.read.parquet(f"{args.output_dir}/events.parquet")
        report = jobs.feature_job(
            events,
            args.output_dir,
            top_n=args.top_n,
            eda=not args.no_eda,
            path_mode=args.path_mode,
        )
    elif args.step == "score":
        report = jobs.score_job(
            spark,
            args.output_dir,
            features_path=args.x_path,
            labels_path=args.y_path,
            events_path=args.events_path,
            contamination=args.contamination,
            trees=args.n_estimators,
            max_samples=args.max_samples,
            top_n=args.top_n,
        )
    elif args.step == "gate":
        report = jobs.gate_job(
            spark,
            args.output_dir,
            scored_path=args.scored_path,
            features_path=args.x_path,
            labels_path=args.y_path,
            model_path=args.model_path,
            score_threshold=args.score_threshold,
            top_n=args.top_n,
            attributions=not args.no_shap,
        )
    elif args.step == "stream-ingest":
        jobs.stream_ingest_job(spark, args.data_dir, args.output_dir, max_files=args.max_files)
        report = {}
    elif args.step == "stream-alerts":
        jobs.stream_alerts_job(spark, args.events, args.output_dir)
        report = {}
    else:
        done = jobs.triage_job(
            spark,
            args.path,
            levels=args.risk,
            keyword=args.keyword,
            sort_by=args.sort_by,
            ascending=not args.descending,
            export=args.export,
        )
        if done.intake.problem:
            raise SystemExit(done.intake.problem)
        report = done.report or {}
    for name, table in report.items():
        print(f"\n--- {name} ---")
        table.show(50, truncate=100)


if __name__ == "__main__":
    main()
