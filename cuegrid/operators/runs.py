"""Runs of failures in long ordered groups, and where they end a group's work.

Each chunk of a group is reduced to one row: how many rows it has, how many failures it begins
with, where its last success lies, and whether it ends the work by itself. Such rows combine from
left to right, so one pass over them gives what every chunk inherits, and what a group carries
into rows that arrive later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

LIMIT = 3
CARRIED = "run bigint, over boolean"


def _local(rows: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, quota: Column | None, chunk: Column) -> DataFrame:
    """Rows with their place in the chunk and the place of the last success up to them."""
    inside = Window.partitionBy("_g").orderBy(*order)
    # one struct for group and chunk: structs with null fields are equal to themselves
    group = F.struct(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), chunk.alias("chunk"))
    spent = F.lit(False) if quota is None else F.coalesce(quota, F.lit(False))
    placed = rows.select("*", group.alias("_g"), F.coalesce(failed, F.lit(False)).alias("_bad"), spent.alias("_spent")).withColumn("_at", F.row_number().over(inside))
    return placed.withColumn("_ok", F.max(F.when(~F.col("_bad"), F.col("_at"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))


def _summaries(local: DataFrame, limit: int, before: DataFrame | None) -> DataFrame:
    """One row a chunk with what it inherits (`run`: failures in a row up to it, `over`: whether the
    work has ended) and what it passes on (`run_after`, `over_after`)."""
    each = local.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_ok").isNull(), 1)).alias("lead"), F.max("_ok").alias("ok"),
        F.max(F.coalesce(F.col("_at") - F.col("_ok") >= limit, F.lit(False)) | F.col("_spent")).alias("ends")).select("*", F.col("_g.key").alias("key"), F.col("_g.chunk").alias("chunk"))
    chunks = Window.partitionBy("key").orderBy("chunk")  # plain columns: an expression would be shuffled by anew for each window
    ahead = chunks.rowsBetween(Window.unboundedPreceding, -1)
    rows = each.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    rows = rows.withColumn("ok_before", F.max(F.col("start") + F.col("ok")).over(ahead))
    if before is None:
        rows = rows.withColumn("run0", F.lit(0).cast("long")).withColumn("over0", F.lit(False))
    else:
        rows = rows.join(before.select(F.col("key").alias("_k"), F.col("run").alias("run0"), F.col("over").alias("over0")), F.col("key") == F.col("_k"), "left").drop("_k")
        rows = rows.withColumn("run0", F.coalesce("run0", F.lit(0))).withColumn("over0", F.coalesce("over0", F.lit(False)))
    rows = rows.withColumn("run", F.when(F.col("ok_before").isNull(), F.col("start") + F.col("run0")).otherwise(F.col("start") - F.col("ok_before")))
    rows = rows.withColumn("ends", F.col("ends") | ((F.col("lead") > 0) & (F.col("lead") + F.col("run") >= limit)))
    rows = rows.withColumn("over", F.col("over0") | F.coalesce(F.max("ends").over(ahead), F.lit(False)))
    return rows.select("_g", "key", "chunk", "run", "over", F.when(F.col("ok").isNull(), F.col("run") + F.col("n")).otherwise(F.col("n") - F.col("ok")).alias("run_after"),
                       (F.col("over") | F.col("ends")).alias("over_after"))


def failure_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, chunk: Column, *,
                 quota: Column | None = None, limit: int = LIMIT, before: DataFrame | None = None) -> DataFrame:
    """Adds `streak` (failures in a row up to and including the row) and `attempted` (false behind
    the first row that makes `limit` failures in a row, or that meets a spent `quota`).

    `order` must be a total order inside a group and `chunk` never decrease along it. `before` is
    what :func:`carried` gave for earlier rows of the groups. Rows are shuffled by (group,
    chunk), summaries by group; a group with a third of all rows is spread over its chunks. Null
    keys are a group of their own; a null `failed` or `quota` counts as false."""
    local = _local(rows, keys, order, failed, quota, chunk)
    met = local.join(_summaries(local, limit, before).select("_g", F.col("run").alias("_run"), F.col("over").alias("_over")), "_g")
    streak = F.when(F.col("_ok").isNull(), F.col("_at") + F.col("_run")).otherwise(F.col("_at") - F.col("_ok"))
    ahead = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max((F.col("streak") >= limit) | F.col("_spent")).over(ahead)
    return met.withColumn("streak", streak).withColumn("attempted", ~F.col("_over") & ~F.coalesce(ended, F.lit(False))).select(*rows.columns, "streak", "attempted")


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, chunk: Column, *,
            quota: Column | None = None, limit: int = LIMIT, before: DataFrame | None = None) -> DataFrame:
    """(key, run, over): one small row a group, what `failure_runs` needs to go on with rows behind
    these. Groups of `before` without new rows stay as they are. `key` is a struct k0, k1, ..."""
    ends = _summaries(_local(rows, keys, order, failed, quota, chunk), limit, before)
    last = F.struct("chunk")  # a null chunk is the first
    now = ends.groupBy("key").agg(F.max_by("run_after", last).alias("run"), F.max_by("over_after", last).alias("over"))
    return now if before is None else now.unionByName(before.join(now.select("key"), "key", "left_anti"))
