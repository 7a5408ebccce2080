"""Recomputing only what changed between two versions of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuegrid.functions.scalars import segment_scene
from cuegrid.functions.text import bound
from cuegrid.session import stored

#: Columns an unchanged scene keeps after replanning. The last two say how its audio was made;
#: without them the audio would look stale and be synthesised again.
CARRIED = ("audio_file", "actual_audio_duration", "audio_sha", "clip_durations", "video_files",
           "visual_action", "gesture", "generation_prompt", "custom_prompt", "audio_trim",
           "audio_voice")


def audio_valid(signature: Column, voice: Column) -> Column:
    """Is the stored narration still right for the scene's text, trimming and voice?"""
    return (F.coalesce(F.col("audio_length"), F.lit(0)) > 0) & (
        F.coalesce(F.col("actual_audio_duration"), F.lit(0)) > 0) & F.col("audio_sha").eqNullSafe(
        F.col("text_sha")) & F.col("audio_trim").eqNullSafe(signature) & F.col(
        "audio_voice").eqNullSafe(voice)


def stale_audio(scenes: DataFrame, signature: Column, voice: Column) -> DataFrame:
    return scenes.where(~audio_valid(signature, voice))


def has_speech(scenes: DataFrame, cached: DataFrame, key: str, voice: Column) -> DataFrame:
    """Adds `has_speech`: untrimmed narration of the current text exists, either every unit
    (units ARRAY<unit key>, in cached(unit_key)) or the scene's own file."""
    scenes = stored(scenes)  # read twice
    listed = scenes.select(key, F.explode(F.array_distinct("units")).alias("unit_key"))
    present = cached.select("unit_key").distinct().withColumn("_hit", F.lit(True))
    units = listed.join(present, "unit_key", "left").groupBy(key).agg(
        F.bool_and(F.coalesce("_hit", F.lit(False))).alias("_all"))
    current = F.col("audio_sha").eqNullSafe(F.col("text_sha")) & F.col("audio_voice").eqNullSafe(voice)
    return scenes.join(units, key, "left").withColumn("has_speech", current & F.when(
        F.coalesce(F.size("units"), F.lit(0)) > 0, F.coalesce("_all", F.lit(False))).otherwise(
        F.coalesce("raw_length", F.lit(0)) > 0)).drop("_all")


def carry_over(new: DataFrame, old: DataFrame, keys: list[str], sha: str = "text_sha",
               columns=CARRIED, by_position: bool = True) -> DataFrame:
    """New scenes keep the media columns of the old scene with the same id and text; a column
    the old version lacks keeps the new value. `by_position=False` matches on the text alone
    (keys without the scene id), so an inserted scene does not invalidate the later ones."""
    kept = [c for c in columns if c in old.columns]
    match = [*keys, sha] if by_position else [*keys[:-1], sha]
    before = old.select(*match, F.lit(True).alias("_kept"), *[F.col(c).alias(f"_old_{c}") for c in kept], F.col(keys[-1]).alias("_at"))
    if not by_position:
        # of several old scenes with one text, the first gives all its columns
        whole = F.struct(*[c for c in before.columns if c not in (*match, "_at")])
        before = before.groupBy(*match).agg(F.min_by(whole, "_at").alias("_one")).select(*match, "_one.*")
    else:
        before = before.drop("_at")
    joined = new.join(before, match, "left")
    for c in kept:
        value = F.col(f"_old_{c}")
        joined = joined.withColumn(c, F.coalesce(value, F.col(c)) if c in new.columns else value)
    return joined.withColumn("carried", F.coalesce("_kept", F.lit(False))).drop(
        "_kept", *[f"_old_{c}" for c in kept])


def archive_list(files: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Scene files (keys[:-1]..., stem) whose scene is not among kept(keys)."""
    scene = files.withColumn(keys[-1], segment_scene(F.col("stem")))
    return scene.join(kept.select(*keys), keys, "left_anti")


def script_changes(scripts: DataFrame, states: DataFrame, key: str = "script_id",
                   replan: bool = False) -> DataFrame:
    """(key, action): plan (new), reuse (unchanged), replan, or error when the script changed
    and replanning was not asked for."""
    now = scripts.select(key, F.sha2("text", 256).alias("_sha"))
    seen = now.join(states.select(key, F.col("script_sha").alias("_old")), key, "left")
    same = F.col("_old") == F.col("_sha")
    changed = F.lit("replan") if replan else F.lit("error")
    unchanged = F.lit("replan") if replan else F.lit("reuse")
    return seen.select(key, F.when(F.col("_old").isNull(), "plan").when(same, unchanged)
                       .otherwise(changed).alias("action"))


def reset_scenes(scenes: DataFrame, chosen: Column, stage: str) -> DataFrame:
    """Null the results of `stage` and everything behind it (audio, then video, then render)
    on the chosen scenes and list the files that go to the archive in `archived`; with audio
    also raw_file and unit_files (ARRAY) where the scenes have such columns."""
    if stage not in ("audio", "video", "render"):
        raise ValueError(f"unknown stage {stage!r}")
    video, audio = stage in ("audio", "video"), stage == "audio"
    gone = [F.array(F.nullif(F.col("rendered_file"), F.lit("")))]
    if video:
        gone.append(F.col("video_files"))
    if audio:  # the narration itself, what it was made from, and the units it was put together from
        gone.append(F.array(F.nullif(F.col("audio_file"), F.lit(""))))
        gone += [F.array(F.nullif(F.col(c), F.lit(""))) for c in ("raw_file",) if c in scenes.columns]
        gone += [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("unit_files",) if c in scenes.columns]
    out = scenes.withColumn("archived", F.when(chosen, F.array_compact(F.concat(*gone))))

    def put(name: str, value: Column) -> None:
        nonlocal out
        out = out.withColumn(name, F.when(chosen, value).otherwise(F.col(name)))

    if video:
        put("video_files", F.array().cast("array<string>"))
    if audio:
        put("actual_audio_duration", F.lit(None))
        put("audio_sha", F.lit(None))
    put("status", F.lit("pending"))
    put("error", F.lit(None))
    put("rendered_file", F.lit(""))
    put("render_fingerprint", F.lit(None))
    return out


def ready_scenes(scenes: DataFrame, measured: Column) -> DataFrame:
    """Scenes whose narration is measured, with `video` (may go on to its clips) and `render` (has them)."""
    return scenes.where(measured.isNotNull()).withColumn("video", F.col("status") != "failed").withColumn(
        "render", F.col("status").isin("video_complete", "syncing", "complete"))


def retry_failed(scenes: DataFrame) -> DataFrame:
    """Failed scenes get a fresh chance on every run."""
    failed = F.col("status") == "failed"
    return scenes.withColumn("error", F.when(~failed, F.col("error"))).withColumn(
        "status", F.when(failed, "pending").otherwise(F.col("status")))


def split_cached(wanted: DataFrame, cache: DataFrame, key: str = "unit_key") -> tuple[DataFrame, DataFrame]:
    """(values for rows whose key is cached, distinct keys still to be computed)."""
    hits = wanted.join(cache, key)
    misses = wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    return hits, misses


def fingerprint_stale(scenes: DataFrame, keys: list[str], outputs: DataFrame) -> DataFrame:
    """Scenes whose (keys, fingerprint) has no non-empty output."""
    done = outputs.where(F.col("length") > 0).select(*keys, "fingerprint")
    return scenes.join(done, [*keys, "fingerprint"], "left_anti")


def merge_layers(settings: DataFrame, owner: str = "owner") -> DataFrame:
    """settings(owner, path, value, layer), dotted leaf paths -> (owner, path, value) after a
    deep merge in layer order: a higher layer's leaf replaces the same leaf, everything under
    it, and any leaf it runs through.

    Each path meets the nodes of the tree it runs through once: there the node's own leaf learns
    the highest layer below it, and the paths below learn the node's. The source is read once; a
    leaf's layers are combined before they are shuffled, and what meets in a node is at most
    the distinct paths of one owner's settings."""
    leaf = settings.groupBy(owner, "path").agg(F.max("layer").alias("_leaf"), F.max_by("value", "layer").alias("value"))
    parts = F.split("path", r"\.")
    nodes = bound(parts, lambda t: F.transform(F.sequence(F.lit(1), F.size(t)), lambda n: F.struct(
        F.array_join(F.slice(t, F.lit(1), n), ".").alias("node"), (n == F.size(t)).alias("own"))))
    met = leaf.select(owner, "path", "_leaf", "value", F.explode(nodes).alias("_n")).select("*", F.col("_n.node").alias("_node"), F.col("_n.own").alias("_own"))
    here = Window.partitionBy(owner, "_node")
    below, at = F.max(F.when(~F.col("_own"), F.col("_leaf"))).over(here), F.max(F.when(F.col("_own"), F.col("_leaf"))).over(here)
    seen = met.select(owner, "path", "_leaf", "value", F.when(F.col("_own"), below).otherwise(at).alias("_rival"))
    merged = seen.groupBy(owner, "path").agg(F.max("_leaf").alias("_leaf"), F.max("_rival").alias("_rival"), F.any_value("value").alias("value"))
    return merged.where(F.col("_rival").isNull() | (F.col("_rival") <= F.col("_leaf"))).select(owner, "path", "value")
