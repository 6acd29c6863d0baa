"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCRATCH_KEY = "spark.procsift.scratch.dir"

# A table of at most this size may be sent to every task.
BROADCAST_BYTES = 32 * 1024 * 1024


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under.

    On a cluster use the session the cluster gives; nothing in the package
    relies on these values for its results.
    """
    parallel = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("procsift")
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.adaptive.enabled", "true")
        # A scan of a few megabytes is split for all cores too.
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        # Recording the call site of every column doubles the planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local-mode session may go without that setting; it then gets a
    folder of its own, made once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that every executor can reach"
        )
    own = spark.conf.get(_SCRATCH_KEY, None)
    if not own:
        own = tempfile.mkdtemp(prefix="procsift-")
        spark.conf.set(_SCRATCH_KEY, own)
    return own


# The scratch paths of the jobs that are running, innermost last.
_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch root that no other call has been given."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the scratch tables made inside, at the end. Nothing that is used
    later may read them: a job's results are in the tables that it wrote."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


@dataclass(frozen=True)
class Stored:
    """A table written to the scratch folder, with an upper bound of its size,
    and for a table of counts their sum."""

    df: DataFrame
    path: str
    rows: int
    bytes: int
    total: int | None = None


def store(df: DataFrame, label: str, *, group_bytes: int | None = None, parts: str | None = None) -> Stored:
    """Write ``df`` once and read it back: cuts the lineage, survives lost
    executors, and measures the table while writing it. ``group_bytes`` is the
    size of its row groups, where a scan is to be split further than usual;
    ``parts`` a column by whose values the table is laid out.

    A retried task can be counted twice, so ``rows`` and ``bytes`` are upper
    bounds: right for broadcast decisions, not for results.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    flat = 8 * (len(df.columns) - len(text) - len(arrays))
    width = F.lit(flat).cast("bigint")
    for name in text:
        width = width + F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + F.lit(16)
    for name in arrays:
        width = width + F.lit(8) * F.coalesce(F.size(F.col(name)), F.lit(0)) + F.lit(16)
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).write
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    if parts:
        writer = writer.partitionBy(parts)
    writer.mode("errorifexists").parquet(path)
    metrics = seen.get
    return Stored(
        df=spark.read.schema(df.schema).parquet(path),
        path=path,
        rows=int(metrics["rows"] or 0),
        bytes=int(metrics["bytes"] or 0),
    )


# Beyond this a table has partitions enough for any cluster.
MOST_PARTS = 20_000


def dealt_out(df: DataFrame, rows: int, per_part: int, *keys: str) -> DataFrame:
    """Rows in a layout that follows from the data alone: by the hash of the
    keys over one partition for each ``per_part`` rows, sorted by the keys.

    For steps in Python that cost far more than moving a row, and for those
    whose result would otherwise follow the layout of the input.
    """
    parts = max(1, min(MOST_PARTS, -(-rows // per_part)))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)
