"""Folders and small files that appear at once, under any Hadoop file system."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _path(spark, path)
    return files.exists(place)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies directly in a folder; none if it is absent."""
    place, files = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    place, files = _path(spark, path)
    files.delete(place, True)


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename; false if the target was there first."""
    old, files = _path(spark, source)
    new, _ = _path(spark, target)
    files.mkdirs(new.getParent())
    return not files.exists(new) and files.rename(old, new)


def publish_table(df: DataFrame, folder: str, name: str, *partition_by: str) -> bool:
    """Write ``folder/name`` as Parquet so that it appears whole or not at all.

    The table is written beside it, where readers of ``folder`` don't look, and
    then renamed. A table that is there already stays as it is, so a repeated
    write of the same rows changes nothing; false tells that.
    """
    spark = df.sparkSession
    if exists(spark, f"{folder}/{name}"):
        return False
    staged = f"{folder}/_staging/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    if _move(spark, staged, f"{folder}/{name}"):
        return True
    delete(spark, staged)
    return False


def publish_json(spark: SparkSession, folder: str, name: str, value: dict) -> bool:
    """A small JSON object as a file that appears at once; false if the name is taken."""
    staged, files = _path(spark, f"{folder}/_staging/{name}-{uuid.uuid4().hex}")
    out = files.create(staged)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    if _move(spark, staged.toString(), f"{folder}/{name}"):
        return True
    files.delete(staged, True)
    return False


def read_json(spark: SparkSession, path: str) -> dict:
    place, files = _path(spark, path)
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
