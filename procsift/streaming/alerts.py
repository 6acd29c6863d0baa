"""Alerts on a stream of events, scored against frozen batch artifacts.

Quantiles, pair frequencies and first-seen times are global in the batch
pipeline. A stream uses the snapshot of the last batch run: the graph and pair
tables, the forest, the bands and the threshold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from procsift.functions.times import seconds_between
from procsift.operators.features import add_rare_parent_child, add_row_features
from procsift.operators.forest import Forest, load_forest, save_forest, score
from procsift.operators.gating import add_explanations, add_flagged, add_risk_level
from procsift.operators.lookup import DEFAULT_LIMITS, LookupLimits, lookup
from procsift.operators.prep import prep_events
from procsift.schema import MAX_DEPTH
from procsift.session import Stored, scratch_scope
from procsift.sources.publish import delete, names_in, publish_json, read_json


@dataclass(frozen=True)
class Snapshot:
    """What a batch run leaves behind for the stream."""

    graph: Stored
    pairs: Stored
    bounds: dict[str, float | None]
    threshold: float | None
    forest: Forest | None = None
    version: int | None = None


def save_tables(graph: Stored, pairs: Stored, path: str) -> str:
    """The graph and pair tables, with the sizes that decide how they are
    joined, as a new part below ``path``; gives the part's name."""
    part = f"tables-{uuid.uuid4().hex}"
    tables = {"graph": graph, "pairs": pairs}
    for name, table in tables.items():
        table.df.write.parquet(f"{path}/{part}/{name}")
    sizes = [(name, t.rows, t.bytes, t.total) for name, t in tables.items()]
    graph.df.sparkSession.createDataFrame(sizes, _SIZES).coalesce(1).write.parquet(f"{path}/{part}/sizes")
    return part


def save_limits(spark: SparkSession, bounds: dict[str, float | None], threshold: float | None, path: str) -> str:
    """The band bounds and the gate's threshold, as a new part."""
    part = f"limits-{uuid.uuid4().hex}"
    limits = list({**bounds, _THRESHOLD: threshold}.items())
    spark.createDataFrame(limits, "name string, value double").coalesce(1).write.parquet(f"{path}/{part}")
    return part


def save_model(forest: Forest, path: str) -> str:
    """The forest, as a new part."""
    part = f"forest-{uuid.uuid4().hex}"
    save_forest(forest, f"{path}/{part}")
    return part


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(_POINTER)) for n in names_in(spark, f"{path}/versions") if n.endswith(_POINTER))


def parts_of(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    return read_json(spark, f"{path}/versions/{version}{_POINTER}")


def latest_parts(spark: SparkSession, path: str) -> dict[str, str]:
    """The parts of the last version; none if nothing has been published."""
    known = _versions(spark, path)
    return parts_of(spark, path, known[-1]) if known else {}


def publish(spark: SparkSession, path: str, **parts: str) -> int:
    """A new version of the snapshot: the last one with ``parts`` replaced.

    Parts are never written over. A version is a small file that names its
    parts, written last and at once; the one of the highest number counts. So
    a stream that reads an older version goes on with all of it.
    """
    while True:
        known = _versions(spark, path)
        named = latest_parts(spark, path)
        number = known[-1] + 1 if known else 1
        if publish_json(spark, f"{path}/versions", f"{number}{_POINTER}", {**named, **parts}):
            return number


def drop_versions(spark: SparkSession, path: str, keep: int) -> None:
    """Delete all but the last ``keep`` versions, and the parts that only those name.
    Nothing that is still read may be older than these."""
    known = _versions(spark, path)
    kept = {p for v in known[-keep:] for p in parts_of(spark, path, v).values()}
    for version in known[:-keep]:
        gone = set(parts_of(spark, path, version).values()) - kept
        delete(spark, f"{path}/versions/{version}{_POINTER}")
        for part in gone:
            delete(spark, f"{path}/{part}")


def save_snapshot(snapshot: Snapshot, path: str) -> int:
    """Everything a later stream needs, as a new version below ``path``."""
    spark = snapshot.graph.df.sparkSession
    parts = {
        "tables": save_tables(snapshot.graph, snapshot.pairs, path),
        "limits": save_limits(spark, snapshot.bounds, snapshot.threshold, path),
    }
    if snapshot.forest is not None:
        parts["forest"] = save_model(snapshot.forest, path)
    return publish(spark, path, **parts)


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """A snapshot that an earlier session saved, by default the last version;
    without a forest if it has none."""
    if version is None:
        known = _versions(spark, path)
        if not known:
            raise FileNotFoundError(f"no snapshot has been published below {path}")
        version = known[-1]
    parts = parts_of(spark, path, version)
    folder = f"{path}/{parts['tables']}"
    sizes = {r["name"]: r for r in spark.read.parquet(f"{folder}/sizes").collect()}  # two rows
    tables = {
        name: Stored(spark.read.parquet(f"{folder}/{name}"), f"{folder}/{name}", r["rows"], r["bytes"], r["total"])
        for name, r in sizes.items()
    }
    limits = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/{parts['limits']}").collect()}  # a row for each band
    threshold = limits.pop(_THRESHOLD)
    forest = load_forest(spark, f"{path}/{parts['forest']}") if "forest" in parts else None
    return Snapshot(tables["graph"], tables["pairs"], limits, threshold, forest, version)


def latest_snapshot(spark: SparkSession, path: str) -> Callable[[], Snapshot]:
    """Gives the last published version whenever it is asked; an unchanged one
    is not loaded again."""
    held: list[Snapshot] = []

    def look() -> Snapshot:
        known = _versions(spark, path)
        if not held or not known or held[0].version != known[-1]:
            held[:] = [load_snapshot(spark, path)]
        return held[0]

    return look


_SIZES = "name string, rows bigint, bytes bigint, total bigint"
_THRESHOLD = "gate threshold"
_POINTER = ".json"


def snapshot_features(
    prepped: DataFrame, snapshot: Snapshot, limits: LookupLimits = DEFAULT_LIMITS
) -> DataFrame:
    """The 12 features against the snapshot, on top of the event columns.

    A pid the snapshot does not know takes one hop to its parent and then the
    parent's known depth. A pair it does not know is as rare as can be.
    """
    rows = add_row_features(prepped)
    rows = lookup(
        rows, snapshot.graph, {"pid": "id"}, {"depth": "_own", "n_events": "_seen"}, limits=limits
    )
    rows = lookup(
        rows,
        snapshot.graph,
        {"ppid": "id"},
        {"depth": "_above", "first_seen": "_parent_seen"},
        limits=limits,
    )
    hop = F.least(
        F.lit(MAX_DEPTH).cast("bigint"), F.coalesce("_above", F.lit(0)) + F.lit(1).cast("bigint")
    )
    new = F.when(F.col("ppid").isNull() | (F.col("pid") == F.col("ppid")), F.lit(0)).otherwise(hop)
    depth = F.when(F.coalesce("_seen", F.lit(0)) > 0, F.col("_own")).otherwise(new)
    rows = rows.withColumns(
        {
            "pid_depth": F.when(F.col("pid").isNotNull(), depth.cast("bigint")),
            "time_delta_parent": seconds_between(F.col("timestamp"), F.col("_parent_seen")),
        }
    ).drop("_own", "_seen", "_above", "_parent_seen")
    rows = add_rare_parent_child(rows, snapshot.pairs, limits)
    return rows.withColumn("rare_parent_child", F.coalesce("rare_parent_child", F.lit(1.0)))


def gate_events(
    events: DataFrame,
    snapshot: Snapshot,
    *,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    limits: LookupLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Prepared, scored, banded and explained events of one batch.

    ``scorer`` adds ``anomaly_score``; by default the snapshot's forest does.
    """
    if "event_id" not in events.columns:
        raise ValueError("events need an event_id: ids made up for one batch repeat in the next")
    rows = snapshot_features(prep_events(events), snapshot, limits)
    if scorer is not None:
        rows = scorer(rows)
    elif snapshot.forest is not None:
        rows = score(rows, snapshot.forest)
    else:
        raise ValueError("a snapshot without a forest needs a scorer")
    rows = add_risk_level(rows, bounds=snapshot.bounds)
    rows, _ = add_flagged(rows, snapshot.threshold)
    return add_explanations(rows)


def start_alerts(
    events: DataFrame,
    snapshot: Snapshot | Callable[[], Snapshot],
    output: str,
    checkpoint: str,
    *,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write the flagged events of every batch below ``output``.

    A batch that is run again after a failure overwrites its own folder, so an
    alert is never stored twice. A ``snapshot`` that can be called is asked for
    at every batch (``latest_snapshot``): a batch run that publishes a new
    version meanwhile changes the batches after it, and none that is running.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        current = snapshot() if callable(snapshot) else snapshot
        with scratch_scope(batch.sparkSession):
            # A table of batches has a column of that name, and so have the alerts.
            alerts = gate_events(batch.drop("batch"), current, scorer=scorer).where("flagged")
            alerts.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
