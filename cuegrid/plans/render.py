"""Which synchronisation a scene gets, and the plans behind it joined per scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid import params as P
from cuegrid.functions.rounding import round_exact
from cuegrid.operators.align import search_alignment
from cuegrid.operators.fit import plan_fit
from cuegrid.operators.sync import sync_plan
from cuegrid.session import stored


def choose_action(mode: Column, n_clips: Column, lip_voice: Column, fit: Column, align: Column,
                  plain: Column) -> Column:
    """Name of the first plan (not null) in the mode's order; scenes of several clips are
    always plain."""
    fitted = F.when(fit.isNotNull(), F.lit("video_master"))
    aligned = F.when(align.isNotNull(), F.lit("lip_align"))
    voiced = F.when(lip_voice.isNotNull() & (mode == "lip_voice"), F.lit("lip_voice"))
    chain = F.when(mode == "audio_master", F.coalesce(aligned, fitted, plain)).otherwise(
        F.coalesce(voiced, fitted, aligned, plain))
    return F.when(n_clips > 1, plain).otherwise(chain)


def render_plans(scenes: DataFrame, key: str, rule: P.Sync = P.Sync(), fps: int = 24,
                 tail: float = P.Audio().tail_padding,
                 lip_voice: DataFrame | None = None) -> DataFrame:
    """scenes(key, audio_s, clip_durations, clip, narr, narr_len, clip_len) -> one row per
    scene: key, action, target_duration, freeze_pad, mismatch, retime_factor.

    Single-clip scenes are searched in the mode's order, and only scenes that an anti join finds without
    a plan of the first search go to the second; `lip_voice(key, dur, freeze_pad)` holds plans made
    from transcripts, whose scenes need no search in their mode."""
    base = scenes.withColumn("plain", sync_plan(F.col("audio_s"), F.col("clip_durations"), rule,
                                                tail, fps))
    single = base.where(F.size("clip_durations") == 1).withColumn("target", F.col("plain.target_duration"))
    if lip_voice is not None and rule.mode == "lip_voice":
        single = single.join(lip_voice.select(key), key, "left_anti")

    def fitted(rows: DataFrame) -> DataFrame:
        return plan_fit(rows, key, rule=rule, fps=fps).select(
            key, F.struct("dur", "freeze_pad", "mismatch").alias("fit"))

    def aligned(rows: DataFrame) -> DataFrame:
        return search_alignment(rows, key).select(key, F.struct(
            (F.col("pre_hold") + F.col("post_hold")).alias("hold"), F.col("mismatch")).alias("align"))

    if not rule.lip_align:
        out = base.join(fitted(single), key, "left").withColumn(
            "align", F.lit(None).cast("struct<hold:double,mismatch:double>"))
    else:
        searches = (aligned, fitted) if rule.mode == "audio_master" else (fitted, aligned)
        first = stored(searches[0](single))  # read twice
        out = base.join(first, key, "left").join(
            searches[1](single.join(first.select(key), key, "left_anti")), key, "left")
    if lip_voice is not None:
        out = out.join(lip_voice.select(key, F.struct("dur", "freeze_pad").alias("voice")), key, "left")
    else:
        out = out.withColumn("voice", F.lit(None).cast("struct<dur:double,freeze_pad:double>"))
    action = choose_action(F.lit(rule.mode), F.size("clip_durations"), F.col("voice"), F.col("fit"),
                           F.col("align"), F.col("plain.action"))
    out = out.withColumn("action", action)
    a = F.col("action")
    return out.select(
        key, "action",
        round_exact(F.when(a == "lip_voice", F.col("voice.dur")).when(a == "video_master", F.col("fit.dur"))
                    .otherwise(F.col("plain.target_duration")), 4).alias("target_duration"),
        F.when(a == "lip_voice", F.col("voice.freeze_pad")).when(a == "video_master", F.col("fit.freeze_pad"))
        .when(a == "lip_align", round_exact(F.col("align.hold"), 3)).otherwise(F.col("plain.freeze_pad"))
        .alias("freeze_pad"),
        F.when(a == "video_master", F.col("fit.mismatch")).when(a == "lip_align", F.col("align.mismatch"))
        .alias("mismatch"),
        F.when(a.isin("lip_voice", "video_master", "lip_align"), None)
        .otherwise(round_exact(F.col("plain.retime_factor"), 4)).alias("retime_factor"))
