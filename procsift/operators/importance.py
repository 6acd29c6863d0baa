"""Feature importances of a random forest fitted on the heuristic label."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsift.operators.evaluate import class_counts
from procsift.schema import FEATURES
from procsift.session import dealt_out

# The settings of the importance model.
TREES = 100
DEPTH = 10
SEED = 42
SHAPE = "feature string, importance double"

# The forest draws its samples partition by partition, so rows are dealt out by
# id: its importances are the same for any layout of the input.
ROWS_PER_PART = 20_000


def rf_importance(
    labelled: DataFrame,
    columns: list[str] | None = None,
    *,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
) -> DataFrame:
    """``feature, importance``, largest first; no rows where a class has fewer
    than two members."""
    names = columns or FEATURES
    spark = labelled.sparkSession
    counts = class_counts(labelled).first()
    if counts["positive"] < 2 or counts["negative"] < 2:
        return spark.createDataFrame([], SHAPE)
    key = ["event_id"] if "event_id" in labelled.columns else []
    matrix = labelled.select(
        *key,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
        F.col("is_attack").cast("double").alias("label"),
    )
    rows = counts["positive"] + counts["negative"]
    matrix = dealt_out(matrix, rows, ROWS_PER_PART, *(key or matrix.columns))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(matrix)
    # The fit reads its input in several jobs: dealt out and sorted for the first
    # of them only, and on disk, as the forest's own copy of it takes the memory.
    vectors = vectors.select("features", "label").persist(StorageLevel.DISK_ONLY)
    try:
        model = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features"
        ).fit(vectors)
        weights = model.featureImportances.toArray().tolist()
    finally:
        vectors.unpersist()
    return spark.createDataFrame(list(zip(names, weights)), SHAPE).orderBy(
        F.desc("importance"), "feature"
    )
