"""Queries for rollups, joins, incremental work, quality rules and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid import params as P
from cuegrid.catalog import tables as T
from cuegrid.catalog.base import block, query
from cuegrid.functions import scalars as D, text as X
from cuegrid.functions.rounding import fixed, round_exact
from cuegrid.operators import incremental as I, quality as Q, reports as R

C = F.col


# ------------------------------------------------------------------ aggregations ----------
@query("a1_production_report", """
  SELECT project, count(*) AS total_scenes, count(*) FILTER (status = 'complete') AS successful_scenes,
    count(*) FILTER (status = 'failed') AS failed_scenes, count(*) FILTER (status NOT IN ('complete', 'failed')) AS pending_scenes,
    CAST(printf('%.2f', coalesce(sum(rendered_ms), 0) / 1000) AS DOUBLE) AS total_duration FROM osc GROUP BY project""", "osc")
def production_report(spark, folder):
    return R.production_report(T.order_scenes(spark, folder), "project")


@query("a1_cumulative_timings", """
  SELECT project, stage, CAST(printf('%.1f', sum(ms) / 1000) AS DOUBLE) AS seconds FROM (
    SELECT project, audio_ms AS ms, priority AS stage FROM osc UNION ALL SELECT project, rendered_ms, 'render' FROM osc WHERE rendered_ms IS NOT NULL)
  GROUP BY ALL""", "osc")
def cumulative_timings(spark, folder):
    rows = T.order_scenes(spark, folder)
    old = rows.select("project", C("priority").alias("stage"), C("audio_ms").alias("ms"))
    new = rows.where("rendered_ms is not null").select("project", F.lit("render").alias("stage"), C("rendered_ms").alias("ms"))
    return old.unionByName(new).groupBy("project", "stage").agg(
        round_exact(F.sum("ms") / 1000, 1).alias("seconds"))


@query("a2_progress", """
  SELECT project, count(*) FILTER (status = 'complete') || '/' || count(*) || ' scenes complete' AS detail FROM osc GROUP BY project""", "osc")
def progress(spark, folder):
    return T.order_scenes(spark, folder).groupBy("project").agg(F.concat(
        F.count_if(C("status") == "complete").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string"),
        F.lit(" scenes complete")).alias("detail"))


@query("a3_plan_totals", """
  SELECT script_id, count(*) AS n_scenes, round(sum(est), 1) AS total FROM (
    SELECT script_id, """ + T.sql_estimate("text") + """ AS est FROM scn) GROUP BY script_id""", "scn")
def plan_totals(spark, folder):
    return T.scenes(spark, folder).groupBy("script_id").agg(
        F.count(F.lit(1)).alias("n_scenes"), F.round(F.sum(D.estimate_speech(C("text"))), 1).alias("total"))


@query("a4_argmin_first_seen", """
  SELECT project, arg_min(scene, (abs(audio_ms - 5000), scene)) AS scene FROM osc GROUP BY project""", "osc")
def argmin(spark, folder):
    return T.order_scenes(spark, folder).groupBy("project").agg(F.min_by(
        "scene", F.struct(F.abs(C("audio_ms") - 5000), C("scene"))).alias("scene"))


@query("a5_argmax_within_tolerance", """
  SELECT project, arg_max(scene, (audio_ms, -gap, -scene)) AS scene FROM (
    SELECT *, min(gap) OVER (PARTITION BY project) AS best FROM (SELECT *, abs(audio_ms - 5000) AS gap FROM osc))
  WHERE gap <= best + 800 GROUP BY project""", "osc")
def argmax_within_tolerance(spark, folder):
    rows = T.order_scenes(spark, folder).withColumn("gap", F.abs(C("audio_ms") - 5000))
    best = rows.groupBy("project").agg(F.min("gap").alias("best"))
    return rows.join(best, "project").where(C("gap") <= C("best") + 800).groupBy("project").agg(
        F.max_by("scene", F.struct("audio_ms", -C("gap"), -C("scene"))).alias("scene"))


@query("a8_channel_stats", """
  SELECT scene, channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM pix GROUP BY ALL""", "pix")
def channel_stats(spark, folder):
    from cuegrid.operators.sequences import channel_stats as stats

    return stats(T.pixels(spark, folder), "scene").select("scene", "channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("a9_scene_text", "SELECT script_id, scene_ix, text FROM scn", "scn")
def scene_text(spark, folder):
    """Built from the long table of sentences; a scene is two of them."""
    rows = T.sentences(spark, folder).withColumn("scene_ix", F.floor(C("sent_ix") / 2))
    return rows.groupBy("script_id", "scene_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("sent_ix", "text"))), lambda x: x["text"]), " ").alias("text"))


@query("a10_missing_keys", """
  SELECT DISTINCT sha256('mock|' || text) AS unit_key FROM sents WHERE sha256('mock|' || text) NOT IN (
    SELECT sha256('mock|' || text) FROM sents WHERE script_id % 3 = 0)""", "sents")
def missing_keys(spark, folder):
    rows = T.sentences(spark, folder).select("script_id", F.sha2(F.concat(F.lit("mock|"), C("text")), 256).alias("unit_key"))
    cache = rows.where("script_id % 3 = 0").select("unit_key").distinct()
    return I.split_cached(rows, cache)[1].select("unit_key")


@query("a11_all_any", """
  SELECT project, bool_and(status = 'complete') AS every, bool_or(status = 'failed') AS some FROM osc GROUP BY project""", "osc")
def all_any(spark, folder):
    return T.order_scenes(spark, folder).groupBy("project").agg(
        F.bool_and(C("status") == "complete").alias("every"), F.bool_or(C("status") == "failed").alias("some"))


@query("a12_sum_with_gap", """
  SELECT script_id, scene_ix, round(sum(sec) + 0.2::DOUBLE * (count(*) - 1), 2) AS seconds FROM (
    SELECT script_id, sent_ix // 2 AS scene_ix, """ + T.sql_estimate("text") + """ AS sec FROM sents) GROUP BY ALL""", "sents")
def sum_with_gap(spark, folder):
    rows = T.sentences(spark, folder).select("script_id", F.floor(C("sent_ix") / 2).alias("scene_ix"),
                                             D.estimate_speech(C("text")).alias("sec"))
    return rows.groupBy("script_id", "scene_ix").agg(F.round(R.joined_length("sec", F.lit(0.2)), 2).alias("seconds"))


block("warned", """
  SELECT *, CASE WHEN status <> 'complete' THEN 'fail' WHEN audio_ms > 7000 THEN 'warn' ELSE 'ok' END AS qa FROM osc""", "osc")


def _warned(spark, folder):
    w = Q.problems(Q.message(C("audio_ms") > 7000, "long ", C("audio_ms").cast("string")))
    e = Q.problems(Q.message(C("status") != "complete", C("status")))
    return T.order_scenes(spark, folder).withColumn("warnings", w).withColumn("errors", e).withColumn(
        "qa", D.qa_status(C("errors"), C("warnings")))


@query("a15_warning_rows", """
  SELECT project, scene, 0 AS ix, 'long ' || audio_ms AS warning FROM osc WHERE audio_ms > 7000""", "osc")
def warning_rows(spark, folder):
    return R.warning_rows(_warned(spark, folder), "project", "scene")


@query("a15_qa_counts", """
  SELECT project, count(*) FILTER (qa = 'ok') AS ok, count(*) FILTER (qa = 'warn') AS warn, count(*) FILTER (qa = 'fail') AS fail
  FROM warned GROUP BY project""", "warned")
def qa_counts(spark, folder):
    return R.qa_counts(_warned(spark, folder), "project")


# ------------------------------------------------------------------ filters ---------------
def _scene_state(spark, folder):
    """Scene rows with stored media: text_sha, audio and render bookkeeping."""
    n = C("sent_ix")
    return T.sentences(spark, folder).select(
        "script_id", "sent_ix", "text", F.md5("text").alias("text_sha"),
        F.when(n % 5 == 0, F.lit(0)).otherwise(n * 10 + 1).alias("audio_length"),
        F.when(n % 7 == 3, None).otherwise(n / 4 + 1).alias("actual_audio_duration"),
        F.when(n % 3 == 0, "old").otherwise(F.md5("text")).alias("audio_sha"),
        F.when(n % 11 == 1, None).otherwise(F.lit("sig")).alias("audio_trim"),
        F.when(n % 13 == 1, "other").otherwise(F.lit("mock")).alias("audio_voice"))


block("st", """
  SELECT script_id, sent_ix, text, md5(text) AS text_sha, CASE WHEN sent_ix % 5 = 0 THEN 0 ELSE sent_ix * 10 + 1 END AS audio_length,
    CASE WHEN sent_ix % 7 = 3 THEN NULL ELSE sent_ix / 4 + 1 END AS dur, CASE WHEN sent_ix % 3 = 0 THEN 'old' ELSE md5(text) END AS audio_sha,
    CASE WHEN sent_ix % 11 = 1 THEN NULL ELSE 'sig' END AS trim, CASE WHEN sent_ix % 13 = 1 THEN 'other' ELSE 'mock' END AS voice FROM sents""", "sents")


@query("f1_stale_audio", """
  SELECT script_id, sent_ix FROM st WHERE NOT coalesce(audio_length > 0 AND dur > 0 AND audio_sha = text_sha AND trim = 'sig' AND voice = 'mock', false)""", "st")
def stale_audio(spark, folder):
    return I.stale_audio(_scene_state(spark, folder), F.lit("sig"), F.lit("mock")).select("script_id", "sent_ix")


@query("f2_has_speech", """
  SELECT script_id, scene_ix, CASE WHEN scene_ix % 4 = 3 THEN false WHEN scene_ix % 5 = 4 THEN scene_ix % 2 = 0
    ELSE len(list_filter(units, lambda u: length(u) % 6 = 0)) = 0 END AS has_speech FROM scn""", "scn")
def has_speech(spark, folder):
    key = F.struct("script_id", "scene_ix")
    rows = T.scenes(spark, folder).select(
        key.alias("scene"), F.when(C("scene_ix") % 5 != 4, C("units")).alias("units"),
        F.lit("x").alias("text_sha"), F.when(C("scene_ix") % 4 != 3, "x").alias("audio_sha"),
        F.lit("mock").alias("audio_voice"), F.when(C("scene_ix") % 2 == 0, 5).otherwise(0).alias("raw_length"))
    cached = T.sentences(spark, folder).where(F.length("text") % 6 != 0).select(C("text").alias("unit_key"))
    return I.has_speech(rows, cached, "scene", F.lit("mock")).select("scene.script_id", "scene.scene_ix", "has_speech")


@query("f3_ready_scenes", """
  SELECT scene, status <> 'failed' AS video, status IN ('video_complete', 'syncing', 'complete') AS render FROM osc WHERE audio_ms % 7 <> 0""", "osc")
def ready_scenes(spark, folder):
    measured = F.when(C("audio_ms") % 7 != 0, C("audio_ms"))
    return I.ready_scenes(T.order_scenes(spark, folder), measured).select("scene", "video", "render")


@query("f4_status_partition", """
  SELECT project, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status NOT IN ('complete', 'failed')) AS pending, count(*) FILTER (status <> 'complete') AS incomplete FROM osc GROUP BY project""", "osc")
def status_partition(spark, folder):
    s = C("status")
    return T.order_scenes(spark, folder).groupBy("project").agg(
        F.count_if(s == "complete").alias("complete"), F.count_if(s == "failed").alias("failed"),
        F.count_if(~s.isin("complete", "failed")).alias("pending"), F.count_if(s != "complete").alias("incomplete"))


@query("f5_retry_failed", """
  SELECT scene, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status,
    CASE WHEN status = 'failed' THEN NULL ELSE priority END AS error FROM osc""", "osc")
def retry_failed(spark, folder):
    return I.retry_failed(T.order_scenes(spark, folder).withColumn("error", C("priority"))).select("scene", "status", "error")


@query("f11_input_problems", """
  SELECT part_key, array_to_string(list_filter([CASE WHEN s % 5 = 0 THEN 'script missing or empty' END,
    CASE WHEN s % 2 = 0 AND s % 3 = 0 THEN 'presenter image not found' END,
    CASE WHEN s % 7 = 0 AND s % 4 <> 0 THEN 'no voice id and no voice sample' END], lambda x: x IS NOT NULL), '; ') AS problems
  FROM (SELECT p_partkey AS part_key, p_size AS s FROM part)""")
def input_problems(spark, folder):
    s = C("p_size")
    return T.table(spark, folder, "part").select(C("p_partkey").alias("part_key"), F.array_join(Q.input_problems(
        s % 5, s % 2 == 0, F.when(s % 3 != 0, F.lit("presenter.jpg")), s % 7 == 0, F.lit(""),
        F.when(s % 4 == 0, F.lit("sample.wav"))), "; ").alias("problems"))


@query("f12_rounded_plan", """
  SELECT scene, CAST(printf('%.4f', audio_ms / 7000) AS DOUBLE) AS ratio, CAST(printf('%.4f', ceil(round(audio_ms / 1000 * 24, 6)) / 24) AS DOUBLE) AS target FROM osc""", "osc")
def rounded_plan(spark, folder):
    return T.order_scenes(spark, folder).select(
        "scene", round_exact(C("audio_ms") / 7000, 4).alias("ratio"),
        round_exact(D.frame_aligned(C("audio_ms") / 1000, 24), 4).alias("target"))


@query("f13_subset", """
  SELECT doc_id AS script_id, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL
  SELECT doc_id + 1000000000, false FROM labels WHERE doc_id + 1000000000 NOT IN (SELECT doc_id FROM documents)""")
def subset(spark, folder):
    docs = T.table(spark, folder, "documents").select(C("doc_id").alias("script_id"))
    named = T.table(spark, folder, "labels").select(C("doc_id").alias("script_id"))
    wanted = named.unionByName(named.select((C("script_id") + 1000000000).alias("script_id")))
    known = docs.join(wanted, "script_id", "left_semi").withColumn("known", F.lit(True))
    return known.unionByName(wanted.join(docs, "script_id", "left_anti").withColumn("known", F.lit(False)))


@query("f14_outcomes", """
  SELECT project, CASE WHEN project % 9 = 4 THEN 'error: broken script' WHEN f + p = 0 THEN 'done'
    ELSE 'incomplete (' || f || ' failed, ' || p || ' pending)' END AS outcome FROM (
    SELECT project, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'pending') AS p FROM osc GROUP BY project)""", "osc")
def outcomes(spark, folder):
    rows = T.order_scenes(spark, folder).groupBy("project").agg(
        F.count_if(C("status") == "failed").alias("f"), F.count_if(C("status") == "pending").alias("p"))
    return rows.select("project", Q.outcome(F.when(C("f") + C("p") == 0, "final_video.mp4"), C("f"), C("p"),
                                            F.when(C("project") % 9 == 4, F.lit("broken script\ntrace"))).alias("outcome"))


# ------------------------------------------------------------------ joins -----------------
block("oldv", """
  SELECT script_id, sent_ix, CASE WHEN script_id % 10 = 0 AND sent_ix % 4 = 1 THEN text || ' edited' ELSE text END AS text,
    'audio_' || sent_ix AS audio_file, CASE WHEN sent_ix % 6 <> 2 THEN 'clip_' || sent_ix END AS clip FROM sents WHERE sent_ix % 9 <> 8""", "sents")


def _versions(spark, folder):
    new = T.sentences(spark, folder).select("script_id", "sent_ix", F.md5("text").alias("text_sha"), F.lit("planned").alias("gesture"))
    edited = F.when((C("script_id") % 10 == 0) & (C("sent_ix") % 4 == 1), F.concat("text", F.lit(" edited"))).otherwise(C("text"))
    old = T.sentences(spark, folder).where("sent_ix % 9 <> 8").select(
        "script_id", "sent_ix", F.md5(edited).alias("text_sha"),
        F.concat(F.lit("audio_"), C("sent_ix").cast("string")).alias("audio_file"),
        F.when(C("sent_ix") % 6 != 2, F.concat(F.lit("clip_"), C("sent_ix").cast("string"))).alias("gesture"))
    return new, old


@query("j1_carry_over", """
  SELECT n.script_id, n.sent_ix, o.audio_file, coalesce(o.clip, 'planned') AS gesture, o.text IS NOT NULL AS carried
  FROM sents n LEFT JOIN oldv o ON o.script_id = n.script_id AND o.sent_ix = n.sent_ix AND md5(o.text) = md5(n.text)""", "sents", "oldv")
def carry_over(spark, folder):
    new, old = _versions(spark, folder)
    return I.carry_over(new, old, ["script_id", "sent_ix"]).select("script_id", "sent_ix", "audio_file", "gesture", "carried")


@query("j1_carry_by_text", """
  SELECT n.scene, o.file AS audio_file, o.ms AS actual_audio_duration, o.file IS NOT NULL AS carried FROM osc n LEFT JOIN (
    SELECT project, priority, 'f' || min(scene) AS file, arg_min(audio_ms, scene) AS ms FROM osc WHERE scene % 3 <> 0 GROUP BY ALL) o
  ON o.project = n.project AND o.priority = n.priority""", "osc")
def carry_by_text(spark, folder):
    """Scenes of a project with one text: the new ones take everything from the first old one."""
    rows = T.order_scenes(spark, folder).select("project", "scene", C("priority").alias("text_sha"), "audio_ms")
    old = rows.where("scene % 3 <> 0").select("project", "scene", "text_sha", F.concat(F.lit("f"), C("scene").cast("string")).alias("audio_file"),
                                              C("audio_ms").alias("actual_audio_duration"))
    return I.carry_over(rows.drop("audio_ms"), old, ["project", "scene"], by_position=False).select(
        "scene", "audio_file", "actual_audio_duration", "carried")


@query("i2_replan_keep", """
  SELECT n.script_id, count(o.text) AS kept, count(*) - count(o.text) AS redo FROM sents n LEFT JOIN oldv o
    ON o.script_id = n.script_id AND o.sent_ix = n.sent_ix AND md5(o.text) = md5(n.text) GROUP BY n.script_id""", "sents", "oldv")
def replan_keep(spark, folder):
    new, old = _versions(spark, folder)
    return I.carry_over(new, old, ["script_id", "sent_ix"]).groupBy("script_id").agg(
        F.count_if("carried").alias("kept"), F.count_if(~C("carried")).alias("redo"))


@query("j2_archive_list", """
  SELECT path FROM fil WHERE (project, scene_id) NOT IN (SELECT project, scene_id FROM fil WHERE p_partkey % 9 = 0)""", "fil")
def archive_list(spark, folder):
    files = T.files(spark, folder)
    kept = files.where((F.col("mtime_ns") - 1_700_000_000_000_000_000) % 9 == 0).select("project", "scene_id").distinct()
    return I.archive_list(files.drop("scene_id"), kept, ["project", "scene_id"]).select("path")


@query("j8_gesture_clips", """
  SELECT g.scene, c.clip FROM (SELECT scene, (['head_nod', 'welcome', 'closing', 'right'])[scene % 4 + 1] AS gesture FROM osc) g
  JOIN (SELECT (['head_nod', 'head_nod_2', 'welcome', 'right_hand', 'right_12', 'closing_b'])[p_size % 6 + 1] || '' AS clip, p_size FROM part GROUP BY ALL) c
    ON c.clip = g.gesture OR regexp_full_match(c.clip, g.gesture || '_\\d+') GROUP BY ALL""", "osc")
def gesture_clips(spark, folder):
    from cuegrid.operators.library import matching_clips

    g = F.get(F.array(*[F.lit(x) for x in ("head_nod", "welcome", "closing", "right")]), (C("scene") % 4).cast("int"))
    scenes = T.order_scenes(spark, folder).select("scene", g.alias("gesture"))
    stems = F.get(F.array(*[F.lit(x) for x in ("head_nod", "head_nod_2", "welcome", "right_hand", "right_12", "closing_b")]), C("p_size") % 6)
    clips = T.table(spark, folder, "part").select(stems.alias("clip")).distinct()
    return matching_clips(scenes, clips).select("scene", "clip")


@query("w19_library_picks")
def library_picks(spark, folder):
    from cuegrid.operators.library import pick_clips

    names = ("head_nod", "head_nod_2", "welcome", "closing", "right_hand", "counting", "emphasis", "left_hand")
    clips = F.array(*[F.struct(F.lit(n).alias("stem"), F.lit(8.0).alias("seconds")) for n in names])
    rows = T.sentence_arrays(spark, folder).where(F.size("sents") > 0)
    n = F.ceil(F.size("sents") / 2).cast("int")
    from cuegrid.catalog.texts import CORPUS_PATTERNS
    from cuegrid.operators.scenes import assign_gestures

    cues = F.transform(F.sequence(F.lit(0), n - 1), lambda i: X.classify_cue(
        F.array_join(F.slice("sents", i * 2 + 1, F.lit(2)), " "), i, n, CORPUS_PATTERNS))
    picks = pick_clips(rows.select("script_id", assign_gestures(cues).alias("gestures")), clips)
    return picks.select("script_id", F.posexplode("picks").alias("scene_ix", "p")).select(
        "script_id", "scene_ix", "p.stem", "p.matched", "p.start")


@query("j11_first_extension", """
  SELECT project, stem, arg_min(path, CASE ext WHEN '.mp4' THEN 0 WHEN '.mov' THEN 1 WHEN '.webm' THEN 2 ELSE 3 END) AS path
  FROM fil WHERE ext IN ('.mp4', '.mov', '.webm', '.mkv') GROUP BY ALL""", "fil")
def first_extension(spark, folder):
    from cuegrid.sources.files import first_by_extension

    return first_by_extension(T.files(spark, folder), ["project", "stem"])


@query("j12_dimension_fallback", """
  SELECT script_id, scene_ix, coalesce(CASE cue WHEN 'opening' THEN 'welcome' WHEN 'closing' THEN 'closing' WHEN 'question' THEN 'question'
    WHEN 'enumeration' THEN 'counting' WHEN 'emphasis' THEN 'emphasis' WHEN 'contrast' THEN 'contrast' END, 'neutral') AS gesture FROM cued""", "cued")
def dimension_fallback(spark, folder):
    from cuegrid.catalog.texts import CORPUS_PATTERNS
    from cuegrid.operators.scenes import CUE_ACTIONS

    dim = spark.createDataFrame([(c, g, a) for c, (g, a) in CUE_ACTIONS.items()], "cue string, gesture string, action string")
    rows = T.scenes(spark, folder).select("script_id", "scene_ix", X.classify_cue(
        C("text"), C("scene_ix"), C("n_scenes"), CORPUS_PATTERNS).alias("cue"))
    # the dimension is the fixed list of six cues
    return rows.join(F.broadcast(dim), "cue", "left").select(
        "script_id", "scene_ix", F.coalesce("gesture", F.lit("neutral")).alias("gesture"))


@query("j13_reuse_before_recompute", """
  SELECT s.script_id, s.sent_ix, CASE WHEN c.text IS NULL THEN 'computed' ELSE 'cached' END AS origin, length(s.text) / 10 AS seconds
  FROM sents s LEFT JOIN (SELECT DISTINCT text FROM sents WHERE script_id % 4 = 0) c ON c.text = s.text""", "sents")
def reuse_before_recompute(spark, folder):
    rows = T.sentences(spark, folder).withColumn("unit_key", F.sha2("text", 256))
    value = (F.length("text") / 10).alias("seconds")
    cache = rows.where("script_id % 4 = 0").select("unit_key", value, F.lit("cached").alias("origin")).dropDuplicates(["unit_key"])
    misses = I.split_cached(rows, cache)[1].select("unit_key", value, F.lit("computed").alias("origin"))
    return rows.join(cache.unionByName(misses), "unit_key").select("script_id", "sent_ix", "origin", "seconds")


@query("j14_zip_lists", """
  SELECT script_id, scene_ix, i - 1 AS ix, units[i] || '|' || length(units[i]) AS pair FROM scn, unnest(range(1, len(units) + 1)) r(i)""", "scn")
def zip_lists(spark, folder):
    z = F.arrays_zip("units", F.transform("units", lambda u: F.length(u)).alias("n"))
    return T.scenes(spark, folder).select("script_id", "scene_ix", F.posexplode(z).alias("ix", "z")).select(
        "script_id", "scene_ix", "ix", F.concat_ws("|", "z.units", C("z.n").cast("string")).alias("pair"))


# ------------------------------------------------------------------ incremental -----------
@query("i1_script_changes", """
  SELECT doc_id AS script_id, CASE WHEN doc_id % 7 = 6 THEN 'plan' WHEN doc_id % 10 = 0 THEN 'error' ELSE 'reuse' END AS action FROM documents""")
def script_changes(spark, folder):
    docs = T.table(spark, folder, "documents").select(C("doc_id").alias("script_id"), "text")
    before = F.when(C("script_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(C("text"))
    states = docs.where("script_id % 7 <> 6").select("script_id", F.sha2(before, 256).alias("script_sha"))
    return I.script_changes(docs, states)


@query("i3_stage_reset", """
  SELECT stage, scene, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN '' ELSE 'r' || scene END AS rendered_file,
    CASE WHEN hit AND stage <> 'render' THEN 0 ELSE 1 END AS clips, CASE WHEN NOT hit THEN '' ELSE 'r' || scene || CASE WHEN stage <> 'render' THEN ',v' || scene ELSE '' END
      || CASE WHEN stage = 'audio' THEN ',a' || scene || ',w' || scene || ',u' || scene || ',u' || scene || 'b' ELSE '' END END AS archived
  FROM (SELECT *, project % 5 = 2 AND scene % 3 = 0 AS hit FROM osc), unnest(['audio', 'video', 'render']) s(stage)""", "osc")
def stage_reset(spark, folder):
    k = C("scene").cast("string")
    rows = T.order_scenes(spark, folder).select(
        "project", "scene", "status", F.concat(F.lit("r"), k).alias("rendered_file"),
        F.array(F.concat(F.lit("v"), k)).alias("video_files"), F.lit("e").alias("error"), F.lit("f").alias("render_fingerprint"),
        F.concat(F.lit("a"), k).alias("audio_file"), F.concat(F.lit("w"), k).alias("raw_file"), F.lit(2.5).alias("actual_audio_duration"), F.lit("t").alias("audio_sha"),
        F.array(F.concat(F.lit("u"), k), F.concat(F.lit("u"), k, F.lit("b"))).alias("unit_files"))
    chosen = (C("project") % 5 == 2) & (C("scene") % 3 == 0)
    out = None
    for stage in ("audio", "video", "render"):
        one = I.reset_scenes(rows, chosen, stage).withColumn("stage", F.lit(stage))
        out = one if out is None else out.unionByName(one)
    return out.select("stage", "scene", "status", "rendered_file", F.size("video_files").alias("clips"),
                      F.coalesce(F.array_join("archived", ","), F.lit("")).alias("archived"))


@query("i4_fingerprint_skip", """
  SELECT project, scene_id FROM (SELECT project, scene_id, string_agg(name || length, ';' ORDER BY name) AS fp,
    string_agg(name || CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE length END, ';' ORDER BY name) AS old, max(length) AS len FROM fil GROUP BY ALL)
  WHERE NOT (fp = old AND len > 0)""", "fil")
def fingerprint_skip(spark, folder):
    def prints(length):
        one = F.struct("name", length.alias("length"), F.lit(0).alias("mtime_ns"))
        return T.files(spark, folder).groupBy("project", "scene_id").agg(
            F.array_sort(F.collect_list(one)).alias("f"), F.max("length").alias("length")).select(
            "project", "scene_id", D.files_fingerprint(C("f"), F.lit("x")).alias("fingerprint"), "length")

    old = prints(F.when((C("mtime_ns") - 1_700_000_000_000_000_000) % 5 == 0, F.lit(0)).otherwise(C("length")))
    return I.fingerprint_stale(prints(C("length")).drop("length"), ["project", "scene_id"], old).select("project", "scene_id")


@query("i5_unit_cache", """
  SELECT count(DISTINCT text) AS units, count(DISTINCT text) FILTER (text NOT IN (SELECT text FROM sents WHERE script_id % 2 = 0)) AS misses FROM sents""", "sents")
def unit_cache(spark, folder):
    rows = T.sentences(spark, folder).select("script_id", F.sha2("text", 256).alias("unit_key"))
    cache = rows.where("script_id % 2 = 0").select("unit_key").distinct()
    misses = I.split_cached(rows, cache)[1].select("unit_key", F.lit(1).alias("miss"))
    return rows.select("unit_key").distinct().join(misses, "unit_key", "left").agg(
        F.count(F.lit(1)).alias("units"), F.count("miss").alias("misses"))


@query("m1_layered_settings", """
  SELECT o.l_orderkey AS owner, o.path, arg_max(o.value, o.layer) AS value FROM lay o WHERE NOT EXISTS (
    SELECT 1 FROM lay h WHERE h.l_orderkey = o.l_orderkey AND h.layer > o.layer AND (starts_with(o.path, h.path || '.') OR starts_with(h.path, o.path || '.')))
  GROUP BY o.l_orderkey, o.path""", "lay")
def layered_settings(spark, folder):
    paths = F.array(*[F.lit(p) for p in ("sync", "sync.max", "sync.max.up", "audio.tail", "audio", "video.fps", "mode")])
    rows = T.table(spark, folder, "lineitem").select(
        C("l_orderkey").alias("owner"), F.get(paths, (C("l_partkey") % 7).cast("int")).alias("path"),
        C("l_suppkey").cast("string").alias("value"), C("l_linenumber").alias("layer"), "l_extendedprice")
    one = rows.groupBy("owner", "path", "layer").agg(F.max("value").alias("value"))
    return I.merge_layers(one)


block("lay", """
  SELECT l_orderkey, (['sync', 'sync.max', 'sync.max.up', 'audio.tail', 'audio', 'video.fps', 'mode'])[l_partkey % 7 + 1] AS path,
    l_linenumber AS layer, max(l_suppkey::VARCHAR) AS value FROM lineitem GROUP BY ALL""")


# ------------------------------------------------------------------ sorts and sets --------
@query("t1_sorted_lists", "SELECT script_id, scene_ix, array_to_string(list_sort(list_transform(units, lambda u: length(u)), 'DESC'), ',') AS lens FROM scn", "scn")
def sorted_lists(spark, folder):
    lens = F.sort_array(F.transform("units", lambda u: F.length(u)), asc=False)
    return T.scenes(spark, folder).select("script_id", "scene_ix", F.array_join(lens.cast("array<string>"), ",").alias("lens"))


@query("t2_fewest_first", "SELECT scene, len(string_split(clips, '+'))::INT AS n FROM (" + """
  SELECT scene, arg_min(clips, (n, NOT (total / t BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9),
      CASE WHEN total / t BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9 THEN abs(ln(total / t)) ELSE total END, total, k)) AS clips
    FROM (SELECT scene, audio_ms / 1000 * 2::DOUBLE AS t FROM osc) CROSS JOIN combo WHERE total / t >= 0.9::DOUBLE - 1e-9 GROUP BY scene)""", "osc", "combo")
def fewest_first(spark, folder):
    from cuegrid.operators.sync import choose_clips

    return T.order_scenes(spark, folder).select("scene", F.size(choose_clips(
        C("audio_ms") / 1000 * F.lit(2.0))).alias("n"))


@query("t5_slices", f"SELECT script_id, sent_ix, array_to_string({T.sql_words('text')}[2:4], ' ') AS middle FROM sents", "sents")
def slices(spark, folder):
    return T.sentences(spark, folder).select("script_id", "sent_ix", F.array_join(
        F.slice(X.words_of(C("text")), 2, 3), " ").alias("middle"))


@query("u1_distinct_candidates", "SELECT scene_key, count(DISTINCT m1 - m0) AS n FROM clip GROUP BY scene_key", "clip")
def distinct_candidates(spark, folder):
    rows = T.track(T.tracks(spark, folder), "clip").groupBy("scene_key").agg(F.collect_list(C("m1") - C("m0")).alias("v"))
    return rows.select("scene_key", F.size(F.array_distinct("v")).cast("bigint").alias("n"))


@query("u2_sorted_parameters", f"""
  SELECT script_id, array_to_string(list_sort(list_distinct(list_transform({T.sql_words('text')}, lambda w: length(w)))), ',') AS lens
  FROM (SELECT doc_id AS script_id, text FROM documents)""")
def sorted_parameters(spark, folder):
    lens = F.array_sort(F.array_distinct(F.transform(X.words_of(C("text")), lambda w: F.length(w))))
    return T.scripts(spark, folder).select("script_id", F.array_join(lens.cast("array<string>"), ",").alias("lens"))


@query("u3_union_listings", """
  SELECT kind, count(*) AS n FROM (SELECT 'video' AS kind FROM fil WHERE ext = '.mp4' UNION ALL SELECT 'audio' FROM fil WHERE ext = '.mov'
    UNION ALL SELECT 'rendered' FROM fil WHERE length > 0) GROUP BY kind""", "fil")
def union_listings(spark, folder):
    f = T.files(spark, folder)

    def tag(rows, name):
        return rows.select(F.lit(name).alias("kind"), "path")

    return tag(f.where("ext = '.mp4'"), "video").unionByName(tag(f.where("ext = '.mov'"), "audio")).unionByName(
        tag(f.where("length > 0"), "rendered")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("u4_wanted_minus_present", """
  SELECT project, scene_id, seg FROM (SELECT DISTINCT project, scene_id, unnest([0, 1, 2, 3]) AS seg FROM fil)
  EXCEPT SELECT project, scene_id, (p_partkey % 4)::INT FROM fil WHERE length > 0""", "fil")
def wanted_minus_present(spark, folder):
    f = T.files(spark, folder)
    wanted = f.select("project", "scene_id").distinct().withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(3))))
    have = f.where("length > 0").select("project", "scene_id", D.segment_number(C("stem")).alias("seg"))
    return wanted.join(have, ["project", "scene_id", "seg"], "left_anti")


# ------------------------------------------------------------------ quality ---------------
_FORMAT_SQL = """list_filter([CASE WHEN NOT has_video THEN '{l}: no video stream' END,
    CASE WHEN has_video AND (width <> 1280 OR height <> 720) THEN '{l}: resolution ' || width || 'x' || height || ', expected 1280x720' END,
    CASE WHEN has_video AND (fps IS NULL OR abs(fps - 24) > 0.01) THEN '{l}: fps ' || coalesce(fps::VARCHAR, 'None') || ', expected 24' END,
    CASE WHEN has_video AND NOT has_audio THEN '{l}: no audio stream' END,
    CASE WHEN has_video AND has_audio AND sample_rate <> 48000 THEN '{l}: audio ' || sample_rate || ' Hz, expected 48000 Hz' END], lambda x: x IS NOT NULL)"""


@query("q1_format_rules", "SELECT part_key, array_to_string(" + _FORMAT_SQL.format(l="rendered") + ", '; ') AS errors FROM med", "med")
def format_rules(spark, folder):
    m = F.struct(*[C(n) for n in ("has_video", "width", "height", "fps", "has_audio", "sample_rate")])
    return T.media(spark, folder).withColumn("m", m).select("part_key", F.array_join(
        Q.problems(*Q.format_rules(C("m"), "rendered")), "; ").alias("errors"))


@query("q2_speech_cut_off", """
  SELECT scene_key FROM (SELECT scene_key, arg_max(t1, (t0, t1)) AS last FROM clip WHERE t1 - t0 >= 0.25::DOUBLE GROUP BY scene_key)
  WHERE 5.8 - last < 0.15::DOUBLE AND NOT (scene_key % 4 = 1) AND scene_key % 7 <> 0""", "clip")
def speech_cut_off(spark, folder):
    rows = T.track(T.tracks(spark, folder), "clip")
    clips = rows.select("scene_key").distinct().select(
        "scene_key", F.lit(5.8).alias("clip_len"), F.when(C("scene_key") % 4 == 1, 5.0).alias("window_end"),
        (C("scene_key") % 7 != 0).alias("has_audio"))
    return Q.cut_off_clips(rows, clips, "scene_key").select("scene_key")


def _quality_rows(spark, folder):
    s, a = C("scene"), C("audio_ms")
    media = F.struct((s % 17 != 0).alias("present"), (s % 19 != 0).alias("readable"), ((a + s % 5 * 100 - 150) / 1000).alias("duration"),
                     (s % 23 != 0).alias("has_video"), F.lit(True).alias("has_audio"), F.lit(1280).alias("width"), F.lit(720).alias("height"),
                     F.lit(24.0).alias("fps"), F.lit(48000).alias("sample_rate"), (a / 1000).alias("video_duration"),
                     ((a + s % 4 * 25) / 1000).alias("audio_duration"))
    audio = F.struct((s % 13 != 0).alias("present"), F.lit(True).alias("readable"), ((a + s % 3 * 80) / 1000).alias("duration"), (s % 29 != 0).alias("has_audio"))
    sync = F.struct(F.when(s % 3 == 0, "trim").when(s % 3 == 1, "video_master").otherwise("lip_voice").alias("action"),
                    (1 + s % 8 / 8).alias("ratio"), (s % 6 / 8).alias("freeze_pad"), F.array(F.lit(1.0), F.lit(1.25)).alias("tempos"),
                    (s % 11 == 0).alias("off_script"), (s % 31 == 0).alias("voice_failed"))
    return T.order_scenes(spark, folder).select(
        "project", "scene", "status", s.cast("string").alias("id"), F.when(s % 37 != 0, "text").alias("text"), F.lit("nods").alias("visual_action"),
        (a / 1000).alias("measured"), media.alias("rendered"), audio.alias("audio"), sync.alias("sync"),
        F.when(s % 82 == 0, F.array(F.lit("clip.mp4"), F.lit("clip_b.mp4"))).when(s % 41 == 0, F.array(F.lit("clip.mp4"))).otherwise(F.array().cast("array<string>")).alias("cut_clips"))


block("qrows", """
  SELECT *, CASE WHEN s % 17 = 0 OR s % 19 = 0 THEN false ELSE true END AS ok, CASE WHEN s % 3 = 2 THEN 0 WHEN s % 3 = 1 THEN a / 1.25 ELSE a END / 1000 AS need,
    (a + s % 5 * 100 - 150) / 1000 AS rd, (a + s % 3 * 80) / 1000 AS ad, a / 1000 AS m, (a + s % 4 * 25) / 1000 AS aw
  FROM (SELECT project, scene, status, scene AS s, audio_ms AS a FROM osc)""", "osc")


@query("q3_scene_rules", """
  SELECT scene, array_to_string(e, '; ') AS errors, array_to_string(w, '; ') AS warnings, CASE WHEN len(e) > 0 THEN 'fail' WHEN len(w) > 0 THEN 'warn' ELSE 'ok' END AS qa FROM (
  SELECT scene, list_filter([CASE WHEN s % 37 = 0 THEN 'metadata missing: text' END, CASE WHEN s % 13 = 0 THEN 'audio file missing or empty' END,
    CASE WHEN s % 13 <> 0 AND s % 29 = 0 THEN 'audio unreadable or too short (' || printf('%.2f', ad) || 's)' END,
    CASE WHEN s % 13 <> 0 AND s % 29 <> 0 AND abs(ad - m) > 0.1::DOUBLE THEN 'audio file changed since its duration was measured; re-run to re-sync' END,
    CASE WHEN s % 17 = 0 THEN 'rendered clip missing or empty' END, CASE WHEN s % 17 <> 0 AND s % 19 = 0 THEN 'rendered clip unreadable' END,
    CASE WHEN ok AND s % 23 = 0 THEN 'rendered: no video stream' END,
    CASE WHEN ok AND s % 41 = 0 THEN 'speech cut off by the end of the clip (clip.mp4); regenerate this scene (long lines get a longer clip)' END,
    CASE WHEN ok AND s % 82 = 0 THEN 'speech cut off by the end of the clip (clip_b.mp4); regenerate this scene (long lines get a longer clip)' END,
    CASE WHEN ok AND rd + 0.1::DOUBLE < need THEN 'rendered ' || printf('%.2f', rd) || 's is shorter than narration ' || printf('%.2f', need) || 's (speech would be cut)' END,
    CASE WHEN ok AND abs(m - aw) > 1.5 / 24 THEN 'A/V length mismatch: video ' || printf('%.2f', m) || 's vs audio ' || printf('%.2f', aw) || 's' END], lambda x: x IS NOT NULL) AS e,
   list_filter([CASE WHEN ok AND s % 31 = 0 THEN 'voice could not be re-timed to the lips (voice service error); this scene uses the fitted narration. Re-run with --scene <id> --regenerate --stage render later' END,
    CASE WHEN ok AND s % 11 = 0 THEN 'clip does not say the script line closely (repeated/garbled words); regenerate this scene''s video for good lip sync' END,
    CASE WHEN ok AND s % 6 / 8 > 0.3::DOUBLE THEN printf('%.2f', s % 6 / 8) || 's frozen frame at end (video clip too short)' END,
    CASE WHEN ok AND s % 3 = 0 AND 1 + s % 8 / 8 > 1.6::DOUBLE THEN 'video was ' || printf('%.2f', 1 + s % 8 / 8) || 'x longer than narration; much of the clip was trimmed' END], lambda x: x IS NOT NULL) AS w
  FROM qrows)""", "qrows")
def scene_rules(spark, folder):
    return Q.scene_quality(_quality_rows(spark, folder)).select(
        "scene", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "qa")


@query("q4_final_rules", """
  SELECT project, array_to_string(list_filter([CASE WHEN project % 9 = 0 THEN 'final video missing or empty' END,
    CASE WHEN project % 9 <> 0 AND abs(d - x) > 0.5 THEN 'final duration ' || printf('%.2f', d) || 's, expected ' || printf('%.2f', x) || 's' END,
    CASE WHEN project % 9 <> 0 AND abs(d - (d + project % 4 / 16)) > 0.15::DOUBLE THEN 'final A/V drift: video ' || printf('%.2f', d) || 's vs audio ' || printf('%.2f', d + project % 4 / 16) || 's' END],
    lambda v: v IS NOT NULL), '; ') AS errors
  FROM (SELECT project, x, x + project % 5 / 4 AS d FROM (SELECT project, sum(rendered_ms) / 1000 AS x FROM osc WHERE rendered_ms IS NOT NULL GROUP BY project))""", "osc")
def final_rules(spark, folder):
    expected = T.order_scenes(spark, folder).where("rendered_ms is not null").groupBy("project").agg(
        (F.sum("rendered_ms") / 1000).alias("expected"))
    p, x = C("project"), C("expected")
    d = x + p % 5 / 4
    media = F.struct(d.alias("duration"), F.lit(True).alias("has_video"), F.lit(True).alias("has_audio"), F.lit(1280).alias("width"),
                     F.lit(720).alias("height"), F.lit(24.0).alias("fps"), F.lit(48000).alias("sample_rate"), d.alias("video_duration"),
                     (d + p % 4 / 16).alias("audio_duration"))
    finals = expected.select("project", (p % 9 != 0).alias("present"), media.alias("media"))
    return Q.final_quality(finals, expected, "project").select("project", F.array_join("errors", "; ").alias("errors"))


@query("q5_release_gate", """
  SELECT project, count(*) FILTER (status <> 'complete') AS incomplete, count(*) FILTER (status = 'complete' AND audio_ms > 8500) AS failing,
    bool_and(status = 'complete' AND audio_ms <= 8500) AS release FROM osc GROUP BY project""", "osc")
def release_gate(spark, folder):
    rows = T.order_scenes(spark, folder).withColumn("qa", F.when(C("audio_ms") > 8500, "fail").otherwise("ok"))
    return Q.release_gate(rows, "project")


@query("q6_review_listing", """
  SELECT scene, CASE status WHEN 'complete' THEN CASE qa WHEN 'ok' THEN '✓' WHEN 'warn' THEN '⚠' ELSE '✗' END WHEN 'failed' THEN 'x' ELSE '…' END AS mark,
    printf('%.2f', audio_ms / 1000) || 's' AS audio FROM warned""", "warned")
def review_listing(spark, folder):
    return _warned(spark, folder).select("scene", Q.review_mark(C("status"), C("qa")).alias("mark"), D.format_seconds(C("audio_ms") / 1000).alias("audio"))


@query("q7_request_limits", """
  SELECT doc_id AS script_id, array_to_string(list_filter([CASE WHEN length(text) > 2000 THEN 'text is ' || length(text) || ' characters; 2000 are allowed per request' END,
    CASE WHEN doc_id % 5 = 3 THEN 'duration 5.0s is not offered' END], lambda x: x IS NOT NULL), '; ') AS problems FROM documents""")
def request_limits(spark, folder):
    seconds = F.when(C("script_id") % 5 == 3, F.lit(5.0)).otherwise(F.lit(8.0))
    return T.scripts(spark, folder).select("script_id", F.array_join(Q.request_problems(C("text"), seconds), "; ").alias("problems"))
