"""Clip lengths for a narration and how footage is fitted to it. All row-local columns."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid import params as P
from cuegrid.functions.rounding import round_exact
from cuegrid.functions.scalars import equal_clips, frame_aligned, long_or_short_clips
from cuegrid.functions.text import bound

SLACK = 1e-9


def in_range(ratio: Column, rule: P.Sync = P.Sync()) -> Column:
    return ratio.between(rule.max_slowdown - SLACK, rule.max_speedup + SLACK)


def clip_combinations(allowed: tuple[float, ...]) -> list[tuple[int, int, tuple[float, ...]]]:
    """(clips, ordinal, lengths) of every combination up to the clip limit; a few dozen rows,
    bounded by configuration and never by data."""
    lengths = sorted(set(allowed))
    return [(n, k, c) for n in range(1, P.MAX_CLIPS_PER_SCENE + 1)
            for k, c in enumerate(itertools.combinations_with_replacement(lengths, n))]


def choose_clips(target: Column, allowed: tuple[float, ...] = P.Clips().allowed,
                 rule: P.Sync = P.Sync()) -> Column:
    """ARRAY<DOUBLE>: the fewest clips covering `target`, longest first; null if none can.

    Whether n clips can cover the target only depends on n times the longest clip, so the
    number of clips is a chain of comparisons; only the few sums that many clips can have
    are then compared inside the row. A join with the combinations would multiply the rows
    and shuffle for the minimum."""
    first: dict[int, dict[float, tuple[float, ...]]] = {}
    for n, _, combo in clip_combinations(allowed):
        first.setdefault(n, {}).setdefault(float(sum(combo)), combo)

    def choice(sums: dict[float, tuple[float, ...]]) -> Column:
        totals = F.expr("array(" + ", ".join(f"{t!r}D" for t in sorted(sums)) + ")")
        near = bound(F.filter(totals, lambda t: in_range(t / target, rule)), lambda fits: F.when(
            F.size(fits) > 0, F.array_min(F.transform(fits, lambda t: F.struct(
                F.abs(F.log(t / target)).alias("gap"), t.alias("t"))))["t"]))
        best = F.coalesce(near, F.array_min(F.filter(totals, lambda t: t / target > rule.max_speedup)))
        clips = ", ".join(f"{t!r}D, array(" + ", ".join(f"{c!r}D" for c in sorted(combo, reverse=True))
                          + ")" for t, combo in sorted(sums.items()))
        return F.try_element_at(F.expr(f"map({clips})"), best)

    out = F.when(target <= 0, None)
    for n, sums in first.items():
        out = out.when(F.lit(max(sums)) / target >= rule.max_slowdown - SLACK, choice(sums))
    return out


def total(clips: Column) -> Column:
    return F.aggregate(clips, F.lit(0.0), lambda a, c: a + c)


def sync_state(audio: Column, clips: Column, rule: P.Sync = P.Sync(),
               tail: float | Column = P.Audio().tail_padding,
               fps: int | Column = P.Video().fps, video: Column | None = None) -> dict[str, Column]:
    """target_duration, video_duration, ratio and action of a plan, without its exactly rounded numbers."""
    tail = tail if isinstance(tail, Column) else F.lit(float(tail))
    rate = fps if isinstance(fps, Column) else F.lit(fps)
    target = frame_aligned(audio + tail, rate)
    video = total(clips) if video is None else video
    ratio = F.when(video > 0, video / target).otherwise(F.lit(0.0))
    action = (F.when(video <= 0, F.lit("insufficient"))
              .when(F.abs(ratio - 1) < 0.005, F.lit("exact"))
              .when(in_range(ratio, rule), F.lit("retime"))
              .when(ratio > rule.max_speedup, F.lit("trim"))
              .otherwise(F.lit("insufficient")))
    return {"target_duration": target, "video_duration": video, "ratio": ratio, "action": action}


def sync_plan(audio: Column, clips: Column, rule: P.Sync = P.Sync(),
              tail: float | Column = P.Audio().tail_padding,
              fps: int | Column = P.Video().fps, video: Column | None = None) -> Column:
    """STRUCT<target_duration, video_duration, ratio, retime_factor, action, freeze_pad>.
    `video`, the summed clip length, may be given as a column computed beforehand."""
    rate = fps if isinstance(fps, Column) else F.lit(fps)
    target, video, ratio, action = sync_state(audio, clips, rule, tail, fps, video).values()
    factor = (F.when((video <= 0) | (action == "exact"), F.lit(1.0))
              .when(action == "retime", target / video)
              .when(action == "trim", F.lit(1 / rule.max_speedup))
              .otherwise(F.lit(1 / rule.max_slowdown)))
    short = F.greatest(F.lit(0.0), target - video * F.lit(1 / rule.max_slowdown))
    freeze = (F.when(video <= 0, target)
              .when(action == "insufficient", round_exact(short + F.lit(1.0) / rate, 4))
              .otherwise(F.lit(0.0)))
    return F.struct(target.alias("target_duration"), video.alias("video_duration"),
                    ratio.alias("ratio"), factor.alias("retime_factor"), action.alias("action"),
                    freeze.alias("freeze_pad"))


def rounded_plan(plan: Column) -> Column:
    return F.struct(*[round_exact(plan[n], 4).alias(n) for n in (
        "target_duration", "video_duration", "ratio", "retime_factor", "freeze_pad")],
        plan["action"].alias("action"))


#: How footage sources choose clip lengths, by name.
def planned_clips(source: str, target: Column, *, allowed=P.Clips().allowed,
                  rule: P.Sync = P.Sync(), max_segment: Column | None = None,
                  long_rule: P.LongClips = P.LongClips()) -> Column:
    if source == "library":
        return equal_clips(target, max_segment)
    if source == "long_or_short":
        return long_or_short_clips(target, long_rule)
    if source == "combinations":
        return choose_clips(target, allowed, rule)
    raise P.ParameterError(f"unknown clip source {source!r}")


def top_up(audio: Column, clips: Column, allowed=P.Clips().allowed, rule: P.Sync = P.Sync(),
           tail: float = P.Audio().tail_padding, fps: int = P.Video().fps) -> Column:
    """`clips` plus the first clip planned for the deficit, while footage is insufficient and
    the scene has fewer than four clips: at most four unrolled steps inside the row."""

    def step(have: Column, _: Column) -> Column:
        state = sync_state(audio, have, rule, tail, fps, total(have))
        return bound(F.struct(*[state[n].alias(n) for n in ("target_duration", "video_duration", "action")]), lambda plan: F.when(
            (F.size(have) < P.MAX_CLIPS_PER_SCENE) & (plan["action"] == "insufficient"),
            bound(choose_clips(plan["target_duration"] - plan["video_duration"], allowed, rule),
                  lambda more: F.when(more.isNull(), have).otherwise(
                      F.array_append(have, F.get(more, F.lit(0))))))
            .otherwise(have))

    return F.aggregate(F.sequence(F.lit(1), F.lit(P.MAX_CLIPS_PER_SCENE)), clips, step)


def with_sync(scenes: DataFrame, audio: str = "audio_s", clips: str = "clip_durations",
              rule: P.Sync = P.Sync()) -> DataFrame:
    return scenes.withColumn("sync", sync_plan(F.col(audio), F.col(clips), rule))
