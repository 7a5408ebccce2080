"""Queries for sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.catalog import tables as T
from cuegrid.catalog.base import query
from cuegrid.functions import scalars as D, text as X
from cuegrid.operators import reports as R
from cuegrid.operators.subtitles import build_cues, cue_blocks
from cuegrid.sources import documents as DOC, files as FILES, logs as L, sinks as SINKS, texts as TEXTS
from cuegrid.streaming.run import work_folder

C = F.col


@query("s2_discover_projects", """
  SELECT DISTINCT CASE WHEN doc_id % 6 = 0 THEN '_' ELSE '' END || lang || '-' || doc_id AS project FROM documents
  WHERE doc_id % 6 <> 0 AND doc_id % 4 <> 1""")
def discover_projects(spark, folder):
    k = C("doc_id")
    path = F.concat(F.lit("file:/data/projects/"), F.when(k % 6 == 0, "_").otherwise(""), C("lang"), F.lit("-"),
                    k.cast("string"), F.when(k % 4 == 1, "/scenes/scenes.json").otherwise("/input/script.txt"))
    return FILES.discover_projects(T.table(spark, folder, "documents").select(path.alias("path")))


def _states(spark, folder):
    """Nested state documents: a script's sentences as scenes."""
    scene = F.transform("sents", lambda s, i: F.struct(
        F.format_string("scene_%03d", i + 1).alias("id"), s.alias("text"),
        F.when(i % 3 == 0, "complete").otherwise("pending").alias("status"),
        F.when(i % 3 == 0, F.length(s) / 10).alias("rendered_duration")))
    return T.sentence_arrays(spark, folder).select(C("script_id").alias("project"), F.lit("p").alias("presenter"),
                                                   scene.alias("scenes"))


@query("s4_state_scenes", """
  SELECT script_id AS project, sent_ix AS scene_ix, 'scene_' || CASE WHEN sent_ix < 999 THEN lpad((sent_ix + 1)::VARCHAR, 3, '0') ELSE (sent_ix + 1)::VARCHAR END AS id,
    text, CASE WHEN sent_ix % 3 = 0 THEN 'complete' ELSE 'pending' END AS status FROM sents""", "sents")
def state_scenes(spark, folder):
    return DOC.state_scenes(_states(spark, folder)).select("project", "scene_ix", "id", "text", "status")


@query("s6_probe_documents", """
  SELECT part_key, has_video, has_audio, CASE WHEN has_video THEN width END AS width,
    CASE WHEN has_video THEN CASE WHEN part_key % 3 = 0 THEN 25.0 ELSE 24000 / 1001 END END::DOUBLE AS fps,
    CASE WHEN has_audio THEN sample_rate END AS sample_rate,
    CASE WHEN part_key % 5 <> 0 THEN duration WHEN has_video AND duration > 0 THEN duration + 1 WHEN has_audio THEN 2.5 WHEN has_video THEN duration + 1 ELSE 0 END::DOUBLE AS duration
  FROM med""", "med")
def probe_documents(spark, folder):
    m = T.media(spark, folder)
    k = C("part_key")
    cover = F.struct(F.lit("video").alias("codec_type"), F.lit("mjpeg").alias("codec_name"), F.lit(10).alias("width"), F.lit("0/0").alias("avg_frame_rate"),
                     F.lit(None).cast("string").alias("r_frame_rate"), F.lit(None).cast("string").alias("sample_rate"), F.lit(None).cast("string").alias("duration"),
                     F.struct(F.lit(1).alias("attached_pic")).alias("disposition"))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), C("width").alias("width"),
                     F.when(k % 3 == 0, "0/0").otherwise("24000/1001").alias("avg_frame_rate"), F.lit("25/1").alias("r_frame_rate"),
                     F.lit(None).cast("string").alias("sample_rate"), (C("duration") + 1).cast("string").alias("duration"),
                     F.struct(F.lit(0).alias("attached_pic")).alias("disposition"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit(None).cast("int").alias("width"), F.lit("0/0").alias("avg_frame_rate"),
                     F.lit(None).cast("string").alias("r_frame_rate"), C("sample_rate").cast("string").alias("sample_rate"), F.lit("2.5").alias("duration"),
                     F.struct(F.lit(0).alias("attached_pic")).alias("disposition"))
    doc = F.to_json(F.struct(F.array_compact(F.array(cover, F.when(C("has_video"), video), F.when(C("has_audio"), audio))).alias("streams"),
                             F.struct(F.when(k % 5 != 0, C("duration").cast("string")).alias("duration")).alias("format")))
    return DOC.parse_probe(m.select("part_key", doc.alias("probe")), "part_key").select(
        "part_key", "has_video", "has_audio", "width", "fps", "sample_rate", "duration")


@query("s7_media_catalogue", """
  SELECT project, name, length FROM fil WHERE ext IN ('.mp4', '.mov', '.webm', '.mkv') AND length > 0""", "fil")
def media_catalogue(spark, folder):
    return FILES.media_catalogue(T.files(spark, folder).drop("name")).select("project", "name", "length")


@query("s7_max_segment", "SELECT name, greatest(1.0, min(duration) - 0.05::DOUBLE) AS longest FROM med GROUP BY name", "med")
def max_segment(spark, folder):
    return T.media(spark, folder).groupBy("name").agg(FILES.max_segment(C("duration")).alias("longest"))


@query("s9_event_log", """
  SELECT event_id, event_type AS msg, (props->>'$.k')::BIGINT AS k, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events""")
def event_log(spark, folder):
    k = F.from_json("props", "k bigint")["k"]
    line = F.to_json(F.struct(
        F.date_format(C("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"),
        F.when(C("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.lit("pipe").alias("logger"),
        C("event_type").alias("msg"), C("event_id").alias("event_id"), k.alias("k")))
    rows = L.event_fields(T.table(spark, folder, "events").select(line.alias("value")))
    get = lambda name: F.try_variant_get("fields", f"$.{name}", "bigint").alias(name)
    return rows.select(get("event_id"), "msg", get("k"), "level")


@query("s10_transcripts", f"""
  SELECT script_id AS clip, i - 1 AS word_ix, w[i] AS text, (i - 1) * 0.25::DOUBLE AS t0 FROM (
    SELECT doc_id AS script_id, {T.sql_words('text')} AS w FROM documents WHERE doc_id % 3 <> 1), unnest(range(1, len(w) + 1)) r(i)""")
def transcripts(spark, folder):
    docs = T.scripts(spark, folder)
    words = F.transform(X.words_of(C("text")), lambda w, i: F.struct(
        w.alias("text"), (i * 0.25).alias("start"), (i * 0.25 + 0.2).alias("end")))
    files = docs.select(C("script_id").alias("clip"), F.length("text").alias("length"), C("script_id").alias("mtime_ns"))
    made = docs.select(C("script_id").alias("clip"), DOC.transcript_key(
        F.length("text"), C("script_id"), "base.en").alias("key"), words.alias("words"))
    stale = F.when(C("clip") % 3 == 1, F.concat("key", F.lit("-old"))).otherwise(C("key"))
    return DOC.usable_transcripts(files, made.withColumn("key", stale), "base.en").select("clip", "word_ix", "text", "t0")


@query("s12_subtitle_rows", """
  SELECT script_id, count(*) AS cues, sum(length(line)) AS chars FROM cue GROUP BY script_id""", "cue")
def subtitle_rows(spark, folder):
    rows = T.scenes(spark, folder).select("script_id", "scene_ix", "text", F.lit(4.0).alias("speech"), F.lit(4.5).alias("rendered"))
    return build_cues(rows).groupBy("script_id").agg(F.count(F.lit(1)).alias("cues"), F.sum(F.length("line")).alias("chars"))


@query("s12_subtitle_files", """
  SELECT '=' || script_id || '.srt' AS file, count(*) AS lines, sha256(string_agg(line || chr(10), '' ORDER BY scene_ix, j, k)) AS text_sha256 FROM cue GROUP BY script_id""", "cue")
def subtitle_files(spark, folder):
    """One file for each script, published together and read back."""
    rows = T.scenes(spark, folder).select("script_id", "scene_ix", "text", F.lit(4.0).alias("speech"), F.lit(4.5).alias("rendered"))
    path = work_folder(rows)
    TEXTS.write_texts(build_cues(rows), path, 1, "script_id", ["cue_ix"], "line", ".srt")
    return TEXTS.read_texts(spark, path).select("file", (F.length("text") - F.length(F.replace("text", F.lit("\n")))).cast("long").alias("lines"), F.sha2("text", 256).alias("text_sha256"))


@query("s1_script_files", "SELECT doc_id::VARCHAR AS script_id, sha256(coalesce(text, '') || chr(10)) AS text_sha256 FROM documents")
def script_files(spark, folder):
    """Every script written as a file of its own and read as a source."""
    docs = T.scripts(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    path = work_folder(docs)
    TEXTS.write_texts(docs, path, 1, "script_id", ["script_id"], "text")
    return FILES.read_scripts(spark, f"{path}/data", r"=(\d+)\.txt$").select("script_id", F.sha2("text", 256).alias("text_sha256"))


@query("s3_documents_or_default", """
  SELECT script_id AS project, CASE WHEN script_id % 3 = 0 THEN 'p' ELSE 'none' END AS presenter, CASE WHEN script_id % 3 = 0 THEN count(*) END AS scenes FROM sents GROUP BY script_id""", "sents")
def documents_or_default(spark, folder):
    """State documents of a third of the projects, written as JSON and read by their schema."""
    states = _states(spark, folder).where(F.size("scenes") > 0)
    path = work_folder(states)
    states.where(C("project") % 3 == 0).withColumn("project", C("project").cast("string")).write.json(f"{path}/states")
    docs = spark.read.schema(DOC.STATE_SCHEMA).json(f"{path}/states").select(C("project").cast("long").alias("project"), "presenter", F.size("scenes").cast("long").alias("scenes"))
    full = DOC.with_default(states.select("project"), docs, "project", "presenter", F.lit("none"))
    return full.join(docs.select("project", "scenes"), "project", "left").select("project", "presenter", "scenes")


@query("s5_published_state", "SELECT event_id, event_type FROM events WHERE event_id % 2 = 0")
def published_state(spark, folder):
    """The newest version that was published; one written behind it but not published stays unseen."""
    rows = T.table(spark, folder, "events").select("event_id", "event_type")
    path = work_folder(rows)
    SINKS.write_version(rows, path, 1)
    SINKS.write_version(rows.where("event_id % 2 = 0"), path, 2)
    rows.where("event_id % 3 = 0").write.parquet(f"{path}/data/version=3")
    return SINKS.read_version(spark, path)


@query("s11_filled_template", "SELECT doc_id, 'Say: ' || text || chr(10) AS prompt FROM documents WHERE text IS NOT NULL")
def filled_template(spark, folder):
    """A template read from a file and filled with each text; it is one small row."""
    docs = T.table(spark, folder, "documents").where("text IS NOT NULL")
    path = work_folder(docs)
    spark.range(1).select(F.lit("Say: {{DIALOGUE}}").alias("value")).write.text(f"{path}/template")
    template = DOC.read_template(spark, f"{path}/template").first().template
    return docs.select("doc_id", F.replace(F.lit(template), F.lit("{{DIALOGUE}}"), C("text")).alias("prompt"))


@query("s13_concat_manifest", """
  SELECT project, line_no, line FROM (SELECT project, row_number() OVER (PARTITION BY project ORDER BY path) - 1 AS line_no,
    'file ''' || replace(replace(path, 'video', 'it''s'), '''', '''\\''''') || '''' AS line FROM fil)
  UNION ALL SELECT DISTINCT project, -1, 'ffconcat version 1.0' FROM fil""", "fil")
def concat_manifest(spark, folder):
    from cuegrid.operators.scan import scan

    rows = scan(T.files(spark, folder).select("project", "path"), ["project"], ["path"],
                F.substring("path", 1, 30), number="n")
    return FILES.concat_manifest(rows.select("project", (C("n") - 1).alias("ix"), F.replace(
        C("path"), F.lit("video"), F.lit("it's")).alias("path")), "project", "ix")


@query("s14_work_orders", """
  SELECT scene, segment, '- [ ] `video/scene_' || scene || sfx || '.mp4` - ' || (8 - 2 * segment) || 's - narration ' || printf('%.2f', audio_ms / 1000)
    || 's - prompt: `video/prompts/scene_' || scene || sfx || '.txt`' AS line
  FROM osc, (VALUES (0, ''), (1, '_b')) v(segment, sfx) WHERE status <> 'complete'""", "osc")
def work_orders(spark, folder):
    rows = T.order_scenes(spark, folder).where("status <> 'complete'").select(
        "scene", F.concat(F.lit("scene_"), C("scene").cast("string")).alias("scene_id"),
        F.array(F.lit(8.0), F.lit(6.0)).alias("clip_durations"), (C("audio_ms") / 1000).alias("audio_s"))
    return FILES.work_orders(rows, D.segment_suffix(C("segment"))).select("scene", "segment", "line")


@query("s15_report_documents", """
  SELECT project, '{"total_scenes":' || count(*) || ',"successful_scenes":' || count(*) FILTER (status = 'complete') || ',"failed_scenes":'
    || count(*) FILTER (status = 'failed') || '}' AS doc FROM osc GROUP BY project""", "osc")
def report_documents(spark, folder):
    r = R.production_report(T.order_scenes(spark, folder), "project")
    return r.select("project", F.to_json(F.struct("total_scenes", "successful_scenes", "failed_scenes")).alias("doc"))


@query("s16_batch_summary", """
  SELECT count(*) FILTER (ok) AS complete, count(*) AS total, sum(ms)::BIGINT AS elapsed_ms FROM (
    SELECT project, bool_and(status = 'complete') AS ok, sum(audio_ms) AS ms FROM osc GROUP BY project)""", "osc")
def batch_summary(spark, folder):
    rows = T.order_scenes(spark, folder).groupBy("project").agg(
        F.bool_and(C("status") == "complete").alias("ok"), F.sum("audio_ms").alias("elapsed_ms"))
    return R.batch_summary(rows)


@query("s17_merged_state", """
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'old' END AS session, 'kept' AS project,
    CASE WHEN event_id % 3 = 0 THEN event_type END AS last FROM events""")
def merged_state(spark, folder):
    old = F.create_map(F.lit("session"), F.lit("old"), F.lit("project"), F.lit("kept"))
    new = F.when(C("event_id") % 3 == 0, F.create_map(F.lit("session"), F.lit("new"), F.lit("last"), C("event_type"))).otherwise(
        F.create_map().cast("map<string,string>"))
    m = DOC.merge_state(old, new)
    return T.table(spark, folder, "events").select("event_id", m.alias("m")).select(
        "event_id", C("m")["session"].alias("session"), C("m")["project"].alias("project"), C("m")["last"].alias("last"))
