"""Ordered rules over scenes, clips and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid import params as P
from cuegrid.functions.scalars import segment_suffix
from cuegrid.functions.text import share_words
from cuegrid.operators.intervals import nearest_within, percentiles
from cuegrid.operators.rows import unfold
from cuegrid.operators.runs import failure_runs
from cuegrid.operators.scan import scan
from cuegrid.session import cut_lineage


def ordinal_chunk(column: str, size: int = 4096) -> Column:
    return F.floor(F.col(column) / size)


def running_offset(scenes: DataFrame, key: str, order: str, length: Column,
                   chunk: Column | None = None) -> DataFrame:
    """Adds `offset`: the summed lengths of the scenes before."""
    return scan(scenes, [key], [order], ordinal_chunk(order) if chunk is None else chunk,
                sums_before={"offset": length})


def failure_streak(scenes: DataFrame, key: str, order: str, failed: Column, limit: int = 3,
                   chunk: Column | None = None, quota: Column | None = None) -> DataFrame:
    """Adds `streak` (failures in a row up to and including the row) and `attempted` (false
    from the row on that follows `limit` failures in a row or a spent quota)."""
    return failure_runs(scenes, [key], [order], failed, ordinal_chunk(order) if chunk is None else chunk, quota=quota, limit=limit)


def within_budget(scenes: DataFrame, key: str, order: str, needs: Column, budget: int,
                  chunk: Column | None = None) -> DataFrame:
    """Scenes reached before the budget of new attempts is used up. The run stops at the
    first scene that needs one too many, also for later scenes that need nothing."""
    place = ordinal_chunk(order) if chunk is None else chunk
    used = scan(scenes, [key], [order], place, sums={"_used": needs.cast("int")})
    return used.where(F.col("_used") <= budget).drop("_used")


def leading_segments(segments: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, n): how many segments 0, 1, 2 ... exist before the first missing one, at most
    four. Presence is a bit mask, so only four bits per scene are shuffled."""
    limit = P.MAX_CLIPS_PER_SCENE
    bits = segments.where(F.col(number).between(0, limit - 1)).groupBy(*keys).agg(
        F.bit_or(F.expr(f"shiftleft(1, cast({number} as int))")).alias("_m"))
    n = F.lit(0)
    for k in range(limit, 0, -1):
        full = (1 << k) - 1
        n = F.when(F.col("_m").bitwiseAND(F.lit(full)) == full, F.greatest(F.lit(k), n)).otherwise(n)
    return bits.select(*keys, n.alias("n"))


def work_requests(scenes: DataFrame, image: Column, anchored: bool = True) -> DataFrame:
    """One row per (scene, clip): scenes(..., text, clip_durations, video_files). The
    reference frame is the master image, or the previous clip when anchoring is off."""
    texts = share_words(F.col("text"), F.col("clip_durations"))
    listed = unfold(scenes.withColumn("_texts", texts), "clip_durations", "segment", "duration",
                    *scenes.columns, "_texts")
    previous = F.get(F.col("video_files"), F.col("segment") - 1)
    ref = image if anchored else F.when(F.col("segment") > 0, F.coalesce(previous, image)).otherwise(image)
    return listed.withColumn("dialogue", F.get("_texts", F.col("segment"))).withColumn(
        "reference", ref).withColumn("suffix", segment_suffix(F.col("segment"))).drop("_texts")


# ------------------------------------------------------------------ signals ---------------
def frame_difference(pixels: DataFrame, key: str = "clip_id", frames_per_chunk: int = 512) -> DataFrame:
    """pixels(key, frame, box, px, value) -> (key, frame, mouth, ref): mean absolute change
    of each box from picture `frame` to the next one, so changes are numbered from 0 when
    pictures are."""
    seen = scan(pixels, [key, "box", "px"], ["frame"], F.floor(F.col("frame") / frames_per_chunk),
                lags={"_before": F.col("value")})
    change = F.abs(F.col("value") - F.col("_before"))
    return seen.where(F.col("_before").isNotNull()).groupBy(key, (F.col("frame") - 1).alias("frame")).agg(
        F.avg(F.when(F.col("box") == "mouth", change)).alias("mouth"),
        F.avg(F.when(F.col("box") == "ref", change)).alias("ref"))


def moving_average(rows: DataFrame, key: str, frame: str, value: str, out: str) -> DataFrame:
    """Centred average of three, with zeros beyond both ends (so always divided by three)."""
    near = scan(rows, [key], [frame], ordinal_chunk(frame), lags={"_a": F.col(value)},
                leads={"_b": F.col(value)})
    zero = F.lit(0.0)
    return near.withColumn(out, (F.coalesce("_a", zero) + F.col(value) + F.coalesce("_b", zero))
                           / 3).drop("_a", "_b")


def motion_curve(frames: DataFrame, key: str = "clip_id", fps: int = 24) -> DataFrame:
    """frames(key, frame, mouth, ref), changes numbered from 0 -> adds `activity` and the time
    `t` of the picture each change leads to."""
    raw = frames.withColumn("_raw", F.greatest(F.col("mouth") - 0.8 * F.col("ref"), F.lit(0.0)))
    return moving_average(raw, key, "frame", "_raw", "activity").drop("_raw").withColumn(
        "t", (F.col("frame") + 1) / F.lit(fps))


def rises(curve: DataFrame, thresholds: DataFrame, key: str | list[str] = "clip_id", quiet: int = 3) -> DataFrame:
    """Frames at or above their `threshold` whose `quiet` predecessors are all below; `key` is the
    clip, or the clip and what else thresholds differ by."""
    keys = [key] if isinstance(key, str) else key
    up = curve.join(thresholds.select(*keys, "threshold"), keys).withColumn(
        "_up", F.col("activity") >= F.col("threshold"))
    seen = scan(up, keys, ["frame"], ordinal_chunk("frame"),
                maxes_before={"_last": F.when(F.col("_up"), F.col("frame"))})
    return seen.where(F.col("_up") & (F.col("frame") >= quiet) & (
        F.col("_last").isNull() | (F.col("_last") < F.col("frame") - quiet))).drop("_up", "_last")


def speaking_onsets(curve: DataFrame, points: DataFrame, key: str = "clip_id",
                    window: float = P.MOUTH_WINDOW_S, fps: int = 24,
                    bucket: float = 0.25) -> DataFrame:
    """points(key, near), any number per clip -> `onset`: where activity first clearly rises
    near the given time, or null when the clip shows no clear rise there. Each point has its own
    calm level (what lies before it) and so its own threshold."""
    curve = cut_lineage(curve)
    early = F.greatest(F.lit(0.2), F.col("near") - window)
    places = points.select(key, "near").distinct()
    at = [key, "near"]
    quiet_rows = curve.join(places, key).where(F.col("t") < early)
    base = percentiles(quiet_rows, at, "activity", {"calm": 0.5}, bucket)
    spread = percentiles(curve, [key], "activity", {"p20": 0.2, "peak": 0.9}, bucket)
    level = places.join(spread, key).join(base, at, "left").withColumn("base", F.coalesce("calm", "p20"))
    level = level.where(F.col("peak") - F.col("base") >= 0.3).withColumn(
        "threshold", F.col("base") + 0.35 * (F.col("peak") - F.col("base")))
    quiet = max(2, int(round(0.12 * fps)))
    found = rises(curve.join(places, key), level, at, quiet)
    return nearest_within(points, found, at, "near", "t", [], window).withColumnRenamed(
        "found", "onset")


# ------------------------------------------------------------------ colour ----------------
def channel_stats(pixels: DataFrame, *scene: str) -> DataFrame:
    return pixels.groupBy(*scene, "channel").agg(F.avg("value").alias("mean"),
                                                F.stddev_pop("value").alias("std"))


def color_targets(stats: DataFrame, project: str = "project", bucket: float = 0.5) -> DataFrame:
    """Median of a project's scenes' means and spreads per channel."""
    each = stats.select(project, "channel", F.explode(F.create_map(
        F.lit("mean"), F.col("mean"), F.lit("std"), F.col("std"))).alias("stat", "value"))
    mid = percentiles(each, [project, "channel", "stat"], "value", {"middle": 0.5}, bucket)
    return mid.groupBy(project, "channel").agg(
        F.max(F.when(F.col("stat") == "mean", F.col("middle"))).alias("target_mean"),
        F.max(F.when(F.col("stat") == "std", F.col("middle"))).alias("target_std"))
