"""Queries for scalar functions, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid import params as P
from cuegrid.catalog import tables as T
from cuegrid.catalog.base import query
from cuegrid.functions import scalars as D
from cuegrid.functions.rounding import fixed, round_exact

C = F.col


@query("d1_word_count", "SELECT script_id, sent_ix, len(regexp_extract_all(text, "
       "'[A-Za-z0-9À-ɏ'']+')) AS words FROM sents", "sents")
def word_count(spark, folder):
    return T.sentences(spark, folder).select("script_id", "sent_ix",
                                             D.count_words(C("text")).alias("words"))


@query("d2_speech_estimate", f"SELECT script_id, sent_ix, {T.sql_estimate('text')} AS seconds "
       "FROM sents", "sents")
def speech_estimate(spark, folder):
    return T.sentences(spark, folder).select("script_id", "sent_ix",
                                             D.estimate_speech(C("text")).alias("seconds"))


@query("d3_human_time", """
  SELECT scene, CASE WHEN rendered_ms IS NULL THEN '-'
    WHEN floor(s / 60) <> 0 THEN floor(s / 60)::BIGINT || ':' || lpad(printf('%.2f', s - floor(s / 60) * 60), 5, '0')
    ELSE printf('%.2f', s) || 's' END AS shown
  FROM (SELECT *, rendered_ms * 13 / 1000 AS s FROM osc)""", "osc")
def human_time(spark, folder):
    return T.order_scenes(spark, folder).select(
        "scene", D.format_seconds(C("rendered_ms") * 13 / 1000).alias("shown"))


@query("d4_subtitle_time", """
  SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60,
    ms // 1000 % 60, ms % 1000) AS stamp
  FROM (SELECT event_id, round_even((event_id * 7.3::DOUBLE + value) * 1000, 0)::BIGINT AS ms FROM events)""")
def subtitle_time(spark, folder):
    return T.table(spark, folder, "events").select(
        "event_id", D.subtitle_time(C("event_id") * F.lit(7.3) + C("value")).alias("stamp"))


@query("d5_frame_aligned", """
  SELECT scene, ceil(round(audio_ms / 1000 * 24, 6)) / 24 AS aligned FROM osc""", "osc")
def frame_aligned(spark, folder):
    return T.order_scenes(spark, folder).select(
        "scene", D.frame_aligned(C("audio_ms") / 1000, 24).alias("aligned"))


_RATES = ["24000/1001", "30/1", "0/0", "N/A", "25", "5/0", "", "60000/1001"]


@query("d6_ratio_parse", """
  SELECT part_key, CASE WHEN r IN ('', '0/0', 'N/A') THEN NULL
    WHEN contains(r, '/') THEN CASE WHEN split_part(r, '/', 2)::DOUBLE = 0 THEN NULL
      ELSE split_part(r, '/', 1)::DOUBLE / split_part(r, '/', 2)::DOUBLE END
    ELSE r::DOUBLE END AS ratio
  FROM (SELECT p_partkey AS part_key,
    (['24000/1001','30/1','0/0','N/A','25','5/0','','60000/1001'])[p_size % 8 + 1] AS r FROM part)""")
def ratio_parse(spark, folder):
    text = F.get(F.array(*[F.lit(r) for r in _RATES]), C("p_size") % 8)
    return T.table(spark, folder, "part").select(C("p_partkey").alias("part_key"),
                                                 D.parse_ratio(text).alias("ratio"))


@query("d7_syllables", f"""
  SELECT script_id, sent_ix, sum(greatest(1, g - CASE WHEN l LIKE '%e'
      AND NOT regexp_matches(l, '(le|ee)$') AND g > 1 THEN 1 ELSE 0 END))::BIGINT AS syllables
  FROM (SELECT script_id, sent_ix, l, len(regexp_extract_all(l, '[aeiouy]+')) AS g FROM (
    SELECT script_id, sent_ix, regexp_replace(lower(unnest({T.sql_words('text')})), '[^a-z]', '', 'g') AS l
    FROM sents)) GROUP BY ALL""", "sents")
def syllables(spark, folder):
    from cuegrid.functions.text import words_of

    total = F.aggregate(words_of(C("text")), F.lit(0),
                        lambda a, w: a + D.count_syllables(w))
    return T.sentences(spark, folder).select("script_id", "sent_ix",
                                             total.cast("bigint").alias("syllables"))


@query("d8_clamp", """
  SELECT scene, greatest(0.7::DOUBLE, least(1.45::DOUBLE, audio_ms / 4000)) AS tempo FROM osc""", "osc")
def clamp(spark, folder):
    return T.order_scenes(spark, folder).select(
        "scene", D.clamp(C("audio_ms") / 4000, *P.TEMPO_RANGE).alias("tempo"))


@query("d9_segment_suffix", """
  SELECT part_key, suffix, scene_id, CASE WHEN n > 25 THEN NULL ELSE n END AS back FROM (
    SELECT p_partkey AS part_key, p_size % 30 AS n, 'scene_' || p_partkey AS scene_id,
      CASE WHEN p_size % 30 = 0 THEN '' WHEN p_size % 30 > 25 THEN NULL
        ELSE '_' || chr((97 + p_size % 30)::INT) END AS suffix FROM part)""")
def segment_suffix(spark, folder):
    rows = T.table(spark, folder, "part").select(
        C("p_partkey").alias("part_key"), D.segment_suffix(C("p_size") % 30).alias("suffix"))
    stem = F.concat(F.lit("scene_"), C("part_key").cast("string"), C("suffix"))
    return rows.select("part_key", "suffix", F.coalesce(
        D.segment_scene(stem), F.concat(F.lit("scene_"), C("part_key").cast("string")))
        .alias("scene_id"), F.when(stem.isNotNull(), D.segment_number(stem)).alias("back"))


@query("d10_text_sha", "SELECT doc_id AS script_id, sha256(text) AS sha FROM documents")
def text_sha(spark, folder):
    return T.table(spark, folder, "documents").select(
        C("doc_id").alias("script_id"), D.text_sha(C("text")).alias("sha"))


@query("d11_fingerprint", """
  SELECT project, scene_id, substr(sha256('v1' || string_agg(name || '|' || length || '|' || mtime_ns || ';',
    '' ORDER BY name)), 1, 16) AS fp FROM fil GROUP BY ALL""", "fil")
def fingerprint(spark, folder):
    one = F.struct("name", "length", "mtime_ns")
    rows = T.files(spark, folder).groupBy("project", "scene_id").agg(
        F.array_sort(F.collect_list(one)).alias("f"))
    return rows.select("project", "scene_id", D.files_fingerprint(
        C("f"), F.lit(f"v{P.LOGIC_VERSION}")).alias("fp"))


@query("d12_cache_keys", """
  SELECT script_id, sent_ix, v AS voice, substr(sha256(v || '|' || text), 1, 16) AS unit,
    substr(sha256(v || '|' || printf('%.3f', 1 + sent_ix % 7 / 8) || '|' || text), 1, 16) AS take
  FROM (SELECT *, CASE script_id % 3 WHEN 0 THEN 'override' WHEN 1 THEN 'voice-1'
    ELSE 'unset' END AS v FROM sents)""", "sents")
def cache_keys(spark, folder):
    k = C("script_id") % 3
    voice = D.voice_key(F.when(k == 0, "override"), F.when(k == 1, "voice-1").otherwise(""))
    rows = T.sentences(spark, folder).withColumn("voice", voice)
    return rows.select("script_id", "sent_ix", "voice",
                       D.unit_key(C("voice"), C("text")).alias("unit"),
                       D.take_key(C("voice"), 1 + C("sent_ix") % 7 / 8, C("text")).alias("take"))


@query("d13_trim_signature", """
  SELECT part_key, CASE WHEN part_key % 4 = 0 THEN 'off' ELSE '-' || (30 + s) || '|0.' || (1 + s % 9) || '|0.12'
    END AS signature FROM (SELECT p_partkey AS part_key, p_size AS s FROM part)""")
def trim_signature(spark, folder):
    k, s = C("p_partkey"), C("p_size")
    return T.table(spark, folder, "part").select(k.alias("part_key"), D.trim_signature_column(
        k % 4 != 0, (F.lit(-30) - s).cast("string"),
        F.concat(F.lit("0."), (1 + s % 9).cast("string")), F.lit("0.12")).alias("signature"))


@query("d15_backoff", """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN greatest(60, d) ELSE d END::DOUBLE AS delay
  FROM (SELECT *, CASE l_linenumber WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 45
    ELSE 45 * pow(3, l_linenumber - 3) END AS d FROM lineitem)""")
def backoff(spark, folder):
    rule = P.Retry()
    return T.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        D.backoff_delay(C("l_linenumber"), rule.backoff_s, C("l_returnflag") == "R",
                        rule.rate_limit_floor_s).alias("delay"))


@query("d16_error_class", """
  SELECT event_id, CASE WHEN s < 400 THEN NULL WHEN s IN (401, 403) THEN 'permanent'
    WHEN s = 429 THEN 'rate_limit' WHEN s >= 500 THEN 'transient' ELSE 'permanent' END AS error_class
  FROM (SELECT event_id, ([200, 400, 401, 403, 404, 429, 500, 503])[event_id % 8 + 1] AS s FROM events)""")
def error_class(spark, folder):
    codes = F.array(*[F.lit(c) for c in (200, 400, 401, 403, 404, 429, 500, 503)])
    return T.table(spark, folder, "events").select("event_id", D.error_class(
        F.get(codes, (C("event_id") % 8).cast("int"))).alias("error_class"))


@query("d17_clip_rules", """
  SELECT scene, ceil(t / 7.95)::INT AS n_equal, round(t / ceil(t / 7.95), 3) AS equal_s,
    CASE WHEN t <= 7 THEN 1 ELSE greatest(1, ceil(t / 9.0)::INT) END AS n_rule,
    CASE WHEN t <= 7 THEN 8.0 ELSE 10.0 END::DOUBLE AS rule_s
  FROM (SELECT scene, audio_ms * 2 / 1000 AS t FROM osc)""", "osc")
def clip_rules(spark, folder):
    t = C("audio_ms") * 2 / 1000
    return T.order_scenes(spark, folder).select(
        "scene", D.equal_clips(t, F.lit(7.95)).alias("e"),
        D.long_or_short_clips(t).alias("r")).select(
        "scene", F.size("e").alias("n_equal"), F.get("e", F.lit(0)).alias("equal_s"),
        F.size("r").alias("n_rule"), F.get("r", F.lit(0)).alias("rule_s"))


@query("d18_sub_window", """
  SELECT scene, CASE WHEN scene % 2 = 0 THEN slack / 2
    ELSE ([0.0, slack / 2, slack])[seed % 3 + 1] END AS start
  FROM (SELECT scene, greatest(0::DOUBLE, 8::DOUBLE - least(audio_ms / 1000, 8)) AS slack,
    scene * 7 + length('scene_' || scene) AS seed FROM osc)""", "osc")
def sub_window(spark, folder):
    label = F.concat(F.lit("scene_"), C("scene").cast("string"))
    return T.order_scenes(spark, folder).select("scene", D.sub_window_start(
        F.lit(8.0), C("audio_ms") / 1000, C("scene") % 2 == 0,
        D.window_seed(label, label)).alias("start"))


@query("d19_color_term", """
  SELECT scene, channel, 's' || '=' || printf('%.4f', k) AS gain,
    channel || '=''clip((val-' || printf('%.2f', m) || ')*' || printf('%.4f', k) || '+120.00,0,255)''' AS term
  FROM (SELECT scene, channel, m, 40 / s AS k FROM (SELECT scene, channel, avg(value) AS m,
    stddev_pop(value) AS s FROM pix GROUP BY ALL))""", "pix")
def color_term(spark, folder):
    rows = T.pixels(spark, folder).groupBy("scene", "channel").agg(
        F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return rows.select("scene", "channel", F.concat(
        F.lit("s="), fixed(D.color_gain(C("s"), F.lit(40.0)), 4)).alias("gain"),
        D.color_term(C("channel"), C("m"), C("s"), F.lit(120.0), F.lit(40.0)).alias("term"))


@query("d20_interval_columns", """
  SELECT scene_key, seg_ix, c.t1 - c.t0 AS duration, (n.t1 - n.t0) / (c.t1 - c.t0) AS factor,
    c.t0 + (n.t1 - n.t0) / 1.25::DOUBLE AS out_end
  FROM clip c JOIN narr n USING (scene_key, seg_ix)""", "clip", "narr")
def interval_columns(spark, folder):
    from cuegrid.operators.intervals import placed_end

    t = T.tracks(spark, folder)
    c = T.track(t, "clip").select("scene_key", "seg_ix", "t0", "t1")
    n = T.track(t, "narration").select("scene_key", "seg_ix", C("t0").alias("n0"),
                                       C("t1").alias("n1"))
    return c.join(n, ["scene_key", "seg_ix"]).select(
        "scene_key", "seg_ix", (C("t1") - C("t0")).alias("duration"),
        ((C("n1") - C("n0")) / (C("t1") - C("t0"))).alias("factor"),
        placed_end(C("t0"), C("n0"), C("n1"), F.lit(1.25)).alias("out_end"))


@query("d21_qa_status", """
  SELECT scene, CASE WHEN status = 'failed' THEN 'fail' WHEN audio_ms > 8000 THEN 'warn'
    ELSE 'ok' END AS qa FROM osc""", "osc")
def qa_status(spark, folder):
    errors = F.array_compact(F.array(F.when(C("status") == "failed", F.lit("failed"))))
    warnings = F.array_compact(F.array(F.when(C("audio_ms") > 8000, F.lit("long"))))
    return T.order_scenes(spark, folder).select("scene",
                                                D.qa_status(errors, warnings).alias("qa"))


@query("d22_json_fields", """
  SELECT event_id, (props->>'$.k')::BIGINT AS k,
    '{"event_type":"' || event_type || '","k":' || (props->>'$.k') || '}' AS doc FROM events""")
def json_fields(spark, folder):
    k = F.from_json("props", "k bigint")["k"]
    return T.table(spark, folder, "events").select(
        "event_id", k.alias("k"),
        F.to_json(F.struct("event_type", k.alias("k"))).alias("doc"))


@query("d23_safe_label", r"""
  SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}_-]', '', 'g') AS label FROM pages""")
def safe_label(spark, folder):
    return T.table(spark, folder, "pages").select("page_id",
                                                  D.safe_label(C("url")).alias("label"))


@query("d24_non_empty", "SELECT path, length > 0 AS present FROM fil", "fil")
def non_empty(spark, folder):
    return T.files(spark, folder).select("path", D.non_empty(C("length")).alias("present"))


@query("d25_clip_length", """
  SELECT part_key, CASE WHEN has_video AND duration <> 0 THEN duration * 0.5::DOUBLE ELSE duration END AS seconds
  FROM med""", "med")
def clip_length(spark, folder):
    video = F.when(C("has_video"), C("duration") * F.lit(0.5))
    return T.media(spark, folder).select("part_key", D.clip_length(
        video, C("duration")).alias("seconds"))


@query("rounding_exact", """
  SELECT l_orderkey, l_linenumber, CAST(printf('%.2f', l_quantity * 10 / 16) AS DOUBLE) AS r2,
    CAST(printf('%.3f', l_extendedprice / 16) AS DOUBLE) AS r3 FROM lineitem""")
def rounding(spark, folder):
    return T.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", round_exact(C("l_quantity") * 10 / 16, 2).alias("r2"),
        round_exact(C("l_extendedprice") / 16, 3).alias("r3"))
