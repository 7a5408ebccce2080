"""Data-quality rules as columns: each rule yields its message or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid import params as P
from cuegrid.functions.rounding import fixed
from cuegrid.functions.scalars import qa_status

REQUIRED_FIELDS = ("id", "text", "status", "visual_action")


def problems(*rules: Column) -> Column:
    """ARRAY<STRING> of the messages that apply, in rule order."""
    return F.array_compact(F.array(*rules))


def message(condition: Column, *parts) -> Column:
    text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.when(condition, text)


def shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def format_rules(media: Column, label: str, video: P.Video = P.Video(),
                 audio: P.Audio = P.Audio()) -> list[Column]:
    """Rules on a media struct; without a video stream only that is reported."""
    there = media["has_video"]
    w, h, fps = media["width"], media["height"], media["fps"]
    wrong_size = ~(w.eqNullSafe(video.width) & h.eqNullSafe(video.height))
    wrong_rate = fps.isNull() | (F.abs(fps - video.fps) > 0.01)
    rate = media["sample_rate"]
    return [
        message(~there, f"{label}: no video stream"),
        message(there & wrong_size, f"{label}: resolution ", shown(w), "x", shown(h),
                f", expected {video.width}x{video.height}"),
        message(there & wrong_rate, f"{label}: fps ", shown(fps), f", expected {video.fps}"),
        message(there & ~media["has_audio"], f"{label}: no audio stream"),
        message(there & media["has_audio"] & ~rate.eqNullSafe(audio.sample_rate),
                f"{label}: audio ", shown(rate), f" Hz, expected {audio.sample_rate} Hz"),
    ]


def cut_off_clips(segments: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """Clips (key) whose last real speech segment runs into the clip's end, unless the used
    window(window_end, nullable) stops before it. clips(key, clip_len, window_end, has_audio)."""
    last = segments.where(F.col("t1") - F.col("t0") >= P.MIN_SPEECH_S).groupBy(key).agg(
        F.max_by("t1", F.struct("t0", "t1")).alias("_end"))
    unused = F.coalesce(F.col("window_end") < F.col("clip_len") - P.END_TOUCH_S, F.lit(False))
    return clips.where(F.col("has_audio")).join(last, key).where(
        ~unused & (F.col("clip_len") - F.col("_end") < P.END_TOUCH_S)).select(*clips.columns)


def scene_quality(scenes: DataFrame, rule: P.Quality = P.Quality(), video: P.Video = P.Video(),
                  audio: P.Audio = P.Audio()) -> DataFrame:
    """Adds errors, warnings and qa to scenes with: id, text, status, visual_action;
    audio STRUCT<present, readable, duration, has_audio>; measured (actual narration length);
    rendered STRUCT<present, readable, duration, has_video, has_audio, width, height, fps,
    sample_rate, video_duration, audio_duration>; cut_clips ARRAY<STRING>;
    sync STRUCT<action, ratio, freeze_pad, tempos, off_script, voice_failed>.

    Rules that need the rendered clip are silent when it is missing or unreadable."""
    tol = rule.duration_tolerance
    a, r, s = F.col("audio"), F.col("rendered"), F.col("sync")
    missing = F.filter(F.array(*[F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n))
                                 for n in REQUIRED_FIELDS]), lambda x: x.isNotNull())
    heard = F.coalesce(a["present"], F.lit(False))
    readable = heard & F.coalesce(a["readable"], F.lit(False))
    silent = ~a["has_audio"] | (a["duration"] < 0.2)
    drawn = F.coalesce(r["present"], F.lit(False))
    ok = drawn & F.coalesce(r["readable"], F.lit(False))
    said = F.when(s["action"].eqNullSafe("lip_voice"), F.lit(0.0)).otherwise(
        F.coalesce("measured", F.lit(0.0)))
    fastest = F.coalesce(F.array_max(s["tempos"]), F.lit(1.0))
    need = F.when(s["action"].eqNullSafe("video_master"), said / fastest).otherwise(said)
    v, w = r["video_duration"], r["audio_duration"]
    cut = F.when(ok, F.transform("cut_clips", lambda clip: F.concat(
        F.lit("speech cut off by the end of the clip ("), clip,
        F.lit("); regenerate this scene (long lines get a longer clip)"))))
    errors = F.concat(problems(
        message(F.size(missing) > 0, "metadata missing: ", F.array_join(missing, ", ")),
        message(~heard, "audio file missing or empty"),
        message(heard & ~readable, "audio unreadable"),
        message(readable & silent, "audio unreadable or too short (", fixed(a["duration"], 2), "s)"),
        message(readable & ~silent & F.coalesce((F.col("measured") != 0) & (
            F.abs(a["duration"] - F.col("measured")) > tol), F.lit(False)),
            "audio file changed since its duration was measured; re-run to re-sync"),
        message(~drawn, "rendered clip missing or empty"),
        message(drawn & ~ok, "rendered clip unreadable"),
        *[F.when(ok, x) for x in format_rules(r, "rendered", video, audio)]), F.coalesce(cut, F.array().cast("array<string>")), problems(
        message(ok & (r["duration"] + tol < need), "rendered ", fixed(r["duration"], 2),
                "s is shorter than narration ", fixed(need, 2), "s (speech would be cut)"),
        message(ok & (v != 0) & (w != 0) & (F.abs(v - w) > 1.5 / video.fps), "A/V length mismatch: video ",
                fixed(v, 2), "s vs audio ", fixed(w, 2), "s")))
    warnings = problems(
        message(ok & F.coalesce(s["voice_failed"], F.lit(False)),
                "voice could not be re-timed to the lips (voice service error); this scene uses "
                "the fitted narration. Re-run with --scene <id> --regenerate --stage render later"),
        message(ok & F.coalesce(s["off_script"], F.lit(False)),
                "clip does not say the script line closely (repeated/garbled words); "
                "regenerate this scene's video for good lip sync"),
        message(ok & (s["freeze_pad"] > rule.max_frozen_padding), fixed(s["freeze_pad"], 2),
                "s frozen frame at end (video clip too short)"),
        message(ok & (s["action"] == "trim") & (s["ratio"] > 1.6), "video was ", fixed(s["ratio"], 2),
                "x longer than narration; much of the clip was trimmed"))
    return scenes.withColumn("errors", errors).withColumn("warnings", warnings).withColumn(
        "qa", qa_status(F.col("errors"), F.col("warnings")))


def final_quality(finals: DataFrame, expected: DataFrame, key: str, rule: P.Quality = P.Quality(),
                  video: P.Video = P.Video(), audio: P.Audio = P.Audio()) -> DataFrame:
    """finals(key, media, present) against expected(key, expected): duration, streams, drift."""
    m = F.col("media")
    there = F.coalesce("present", F.lit(False))
    v, w = m["video_duration"], m["audio_duration"]
    errors = problems(
        message(~there, "final video missing or empty"),
        *[F.when(there, x) for x in format_rules(m, "final", video, audio)],
        message(there & (F.abs(m["duration"] - F.col("expected")) > max(rule.duration_tolerance, 0.5)),
                "final duration ", fixed(m["duration"], 2), "s, expected ", fixed(F.col("expected"), 2), "s"),
        message(there & (v != 0) & (w != 0) & (F.abs(v - w) > 0.15), "final A/V drift: video ",
                fixed(v, 2), "s vs audio ", fixed(w, 2), "s"))
    return finals.join(expected, key).withColumn("errors", errors).withColumn(
        "qa", qa_status(F.col("errors"), F.array()))


def release_gate(scenes: DataFrame, key: str) -> DataFrame:
    """(key, incomplete, failing, release): a final output only if nothing is open or failing."""
    done = F.col("status") == "complete"
    out = scenes.groupBy(key).agg(F.count_if(~done).alias("incomplete"),
                                  F.count_if(done & (F.col("qa") == "fail")).alias("failing"))
    return out.withColumn("release", (F.col("incomplete") == 0) & (F.col("failing") == 0))


def review_mark(status: Column, qa: Column) -> Column:
    return (F.when(status == "complete", F.when(qa == "ok", "✓").when(qa == "warn", "⚠").otherwise("✗"))
            .when(status == "failed", "x").otherwise("…"))


def request_problems(text: Column, seconds: Column, allowed: tuple[float, ...] = P.Clips().allowed,
                     limit: int = P.MAX_REQUEST_CHARS) -> Column:
    return problems(
        message(F.length(text) > limit, "text is ", F.length(text).cast("string"),
                f" characters; {limit} are allowed per request"),
        message(~seconds.isin(*allowed), "duration ", seconds.cast("string"), "s is not offered"))


def input_problems(script_length: Column, needs_image: Column, image: Column, needs_voice: Column,
                   voice_id: Column, voice_sample: Column) -> Column:
    return problems(
        message(F.coalesce(script_length, F.lit(0)) <= 0, "script missing or empty"),
        message(needs_image & image.isNull(), "presenter image not found"),
        message(needs_voice & (F.coalesce(voice_id, F.lit("")) == "") & voice_sample.isNull(),
                "no voice id and no voice sample"))


def outcome(final_file: Column, failed: Column, pending: Column, error: Column) -> Column:
    """One line per project: done, incomplete with counts, or the error's first line."""
    return (F.when(error.isNotNull(), F.concat(F.lit("error: "), F.substring_index(error, "\n", 1)))
            .when(F.coalesce(final_file, F.lit("")) != "", F.lit("done"))
            .otherwise(F.concat(F.lit("incomplete ("), failed.cast("string"), F.lit(" failed, "),
                                pending.cast("string"), F.lit(" pending)"))))

