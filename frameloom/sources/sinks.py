"""Sinks: results as tables, files published in two phases, the latest result as a view."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces the table at path; Spark's commit protocol makes it appear whole or not at all."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _paths(spark: SparkSession, *paths: str):
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    own = [jvm(p) for p in paths]
    return own[0].getFileSystem(spark._jsc.hadoopConfiguration()), own


def publish(df: DataFrame, path: str) -> None:
    """Writes beside the path, moves the old result aside, the new one in, and then deletes the old. If a step fails the
    old result is back at the path; only if that fails too both are left beside it, under the path's name and a suffix."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fs, (final, staged, aside) = _paths(spark, path, f"{path}.{mark}", f"{path}.{mark}.old")
    try:
        df.write.parquet(str(staged))
    except BaseException:
        fs.delete(staged, True)
        raise
    had = fs.exists(final)
    if had and not fs.rename(final, aside):
        fs.delete(staged, True)
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(staged, final):
        if not had or fs.rename(aside, final):
            fs.delete(staged, True)
        raise OSError(f"{path} could not be published")
    if had:
        fs.delete(aside, True)


class ResultStore:
    """The latest result of each name as a temporary view; setting replaces, clearing drops."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, set()

    def set(self, **tables: DataFrame) -> None:
        self.clear()
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
            self.names.add(name)

    def get(self, name: str) -> DataFrame | None:
        return self.spark.table(name) if name in self.names else None

    def clear(self) -> None:
        for name in self.names:
            self.spark.catalog.dropTempView(name)
        self.names.clear()

    def clear_cache(self) -> None:
        self.clear()
        self.spark.catalog.clearCache()
