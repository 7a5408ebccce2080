"""Rollups over scenes, projects and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid.functions.rounding import round_exact


def status_counts(status: str = "status") -> list[Column]:
    s = F.col(status)
    return [F.count(F.lit(1)).alias("total_scenes"), F.count_if(s == "complete").alias("successful_scenes"),
            F.count_if(s == "failed").alias("failed_scenes"),
            F.count_if(~s.isin("complete", "failed")).alias("pending_scenes")]


def production_report(scenes: DataFrame, key: str) -> DataFrame:
    """scenes(key, status, rendered_ms) -> counts by status and the total rendered length,
    summed in whole milliseconds so that the order of rows does not matter."""
    return scenes.groupBy(key).agg(*status_counts(), round_exact(
        F.coalesce(F.sum("rendered_ms"), F.lit(0)) / 1000, 2).alias("total_duration"))


def cumulative_timings(old: DataFrame, run: DataFrame, key: str) -> DataFrame:
    """(key, stage, seconds) of earlier runs plus this one, to one decimal."""
    return old.unionByName(run).groupBy(key, "stage").agg(round_exact(F.sum("seconds"), 1).alias("seconds"))


def batch_summary(projects: DataFrame) -> DataFrame:
    return projects.agg(F.count_if("ok").alias("complete"), F.count(F.lit(1)).alias("total"),
                        F.sum("elapsed_ms").alias("elapsed_ms"))


def joined_length(parts: str, gap: Column) -> Column:
    """Sum of the parts plus a gap between neighbours (aggregate expression)."""
    return F.sum(parts) + gap * (F.count(F.lit(1)) - 1)


def qa_counts(scenes: DataFrame, key: str) -> DataFrame:
    return scenes.groupBy(key).agg(*[F.count_if(F.col("qa") == q).alias(q) for q in ("ok", "warn", "fail")])


def warning_rows(scenes: DataFrame, key: str, scene: str) -> DataFrame:
    """One row per warning (key, scene, ix, warning): a project of any size stays spread out,
    where one map per project would gather it in a single row."""
    return scenes.select(key, scene, F.posexplode("warnings").alias("ix", "warning"))
