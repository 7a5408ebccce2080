"""Whole-corpus plans: scripts to scenes, clips, synchronisation and a report per script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid import params as P
from cuegrid.functions.rounding import round_exact
from cuegrid.functions.scalars import text_sha
from cuegrid.functions.text import bound
from cuegrid.operators.scenes import grouped_scripts, plan_scenes, scene_seconds
from cuegrid.operators.sync import planned_clips, sync_plan, total

ACTIONS = ("exact", "retime", "trim", "insufficient")


def scene_table(scripts: DataFrame, planning: P.Planning = P.Planning(), clips: P.Clips = P.Clips(),
                sync: P.Sync = P.Sync(), audio: P.Audio = P.Audio(), video: P.Video = P.Video(),
                source: str = "combinations", **plan_options) -> DataFrame:
    """One row per scene with its text key, planned clips and synchronisation. A narration no
    clips can cover gets null clips, an error text and status `failed`."""
    scenes = plan_scenes(scripts, planning, **plan_options)
    target = F.col("estimated_duration") + audio.tail_padding
    rows = scenes.withColumn("text_sha", text_sha(F.col("text"))).withColumn(
        "clip_durations", planned_clips(source, target, allowed=clips.allowed, rule=sync))
    rows = rows.withColumn("footage", F.coalesce(total(F.col("clip_durations")), F.lit(0.0)))
    rows = rows.withColumn("sync", sync_plan(F.col("estimated_duration"), F.col("clip_durations"), sync,
                                             audio.tail_padding, video.fps, F.col("footage")))
    lost = F.col("clip_durations").isNull()
    return rows.withColumn("error", F.when(lost, F.concat(
        F.format_string("%.1f", round_exact(target, 1)), F.lit(f"s cannot be covered by {P.MAX_CLIPS_PER_SCENE} clips"))
        )).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def production_plan(scripts: DataFrame, planning: P.Planning = P.Planning(), clips: P.Clips = P.Clips(),
                    sync: P.Sync = P.Sync(), audio: P.Audio = P.Audio(), video: P.Video = P.Video(),
                    source: str = "combinations", measured: DataFrame | None = None, gap: float = 0.2) -> DataFrame:
    """Per script: scenes, narration seconds, requested footage and scenes per sync action.

    A fold over the script's array of scenes, so a corpus needs no shuffle (measured lengths are joined,
    and do): script ids are unique, and scripts without scenes are absent."""
    rows = grouped_scripts(scripts, planning, measured, gap).where(F.size("scenes") > 0)
    seconds = F.transform("scenes", lambda g: scene_seconds(g, planning, None if measured is None else gap))

    def planned(length: Column) -> Column:
        wanted = planned_clips(source, length + audio.tail_padding, allowed=clips.allowed, rule=sync)
        return bound(wanted, lambda c: bound(F.coalesce(total(c), F.lit(0.0)), lambda footage: F.struct(
            length.alias("length"), footage.alias("footage"), c.isNull().alias("lost"),
            sync_plan(length, c, sync, audio.tail_padding, video.fps, footage)["action"].alias("action"))))

    plans = rows.select("script_id", seconds.alias("seconds")).select(
        "script_id", F.transform("seconds", planned).alias("p"))

    def count(test) -> Column:
        return F.size(F.filter("p", test)).cast("bigint")

    def actions(name: str) -> Column:
        return count(lambda x: x["action"] == name)

    ms = F.aggregate(F.transform("p", lambda x: F.rint(x["length"] * 1000).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return plans.select(
        "script_id", F.size("p").cast("bigint").alias("scenes"), round_exact(ms / 1000, 2).alias("narration_s"),
        total(F.transform("p", lambda x: x["footage"])).alias("footage_s"), count(lambda x: x["lost"]).alias("uncovered"),
        *[actions(a).alias(a) for a in ACTIONS])
