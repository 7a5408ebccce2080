"""Writing results: versioned state, ordered text, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_version(df: DataFrame, root: str, version: int) -> None:
    """Write a complete new version next to the old ones, then publish it with a one-row
    pointer; readers follow the newest pointer and never see half a version."""
    df.write.mode("errorifexists").parquet(f"{root}/data/version={version}")
    df.sparkSession.range(1).select(F.lit(version).alias("published")).write.mode(
        "errorifexists").parquet(f"{root}/published/version={version}")


def current_version(spark: SparkSession, root: str) -> int:
    return spark.read.parquet(f"{root}/published").agg(F.max("published")).first()[0]


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    wanted = current_version(spark, root) if version is None else version
    return spark.read.parquet(f"{root}/data/version={wanted}")


def write_lines(rows: DataFrame, path: str, key: str, order: str, line: str) -> None:
    """Ordered text per key, one folder a key. Range partitioning by (key, order) splits a
    long text over several tasks; its part files sort in line order."""
    (rows.select(key, order, line).repartitionByRange(key, order).sortWithinPartitions(key, order)
     .select(key, line).write.partitionBy(key).text(path))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
