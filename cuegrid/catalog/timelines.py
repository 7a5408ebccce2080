"""Queries for interval, sequence and signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.catalog import tables as T
from cuegrid.catalog.base import block, query
from cuegrid.functions import scalars as D, text as X
from cuegrid.functions.rounding import fixed
from cuegrid.operators import intervals as I, sequences as S
from cuegrid.operators.scan import scan

C = F.col
#: Chunks far smaller than a scene (seconds) or a project (order numbers), so that what chunks hand on
#: to one another is checked here too.
SMALL_S, SMALL_ORDERS = 3.0, 256

block("sil", "SELECT scene_key AS clip_id, t0 + 0.2 AS s, t1 + 0.4 AS e FROM clip", "clip")
block("lens", "SELECT scene_key, 6.0::DOUBLE + scene_key % 5 * 0.5 AS clip_len FROM "
      "(SELECT DISTINCT scene_key FROM trk)", "trk")


def _clip(spark, folder):
    return T.track(T.tracks(spark, folder), "clip")


def _narr(spark, folder):
    return T.track(T.tracks(spark, folder), "narration")


@query("s8_silence_log", """
  SELECT clip_id, i - 1 AS ix, a[i]::DOUBLE AS s, coalesce(b[i]::DOUBLE, 6.0) AS e FROM (
    SELECT scene_key AS clip_id, list(s ORDER BY seg_ix) AS a, list(e ORDER BY seg_ix) FILTER (seg_ix < 5) AS b
    FROM (SELECT scene_key, seg_ix, printf('%.3f', t0) AS s, printf('%.3f', t1) AS e FROM clip)
    GROUP BY scene_key), unnest(range(1, len(a) + 1)) r(i)""", "clip")
def silence_log(spark, folder):
    from cuegrid.sources.logs import silences_from_log

    line = F.concat(F.lit("[silencedetect] silence_start: "), fixed(C("t0"), 3), F.lit("\n"),
                    F.when(C("seg_ix") < 5, F.concat(F.lit("[silencedetect] silence_end: "),
                                                     fixed(C("t1"), 3), F.lit(" | x\n")))
                    .otherwise(F.lit("")))
    logs = _clip(spark, folder).groupBy(C("scene_key").alias("clip_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ix", line.alias("l")))),
                                 lambda x: x["l"]), "").alias("log")).withColumn("duration", F.lit(6.0))
    return silences_from_log(logs)


@query("w2_speech_from_silence", """
  SELECT clip_id, t0, t1 FROM (
    SELECT clip_id, greatest(0, coalesce(max(e) OVER (PARTITION BY clip_id ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS t0, s AS t1
    FROM (SELECT clip_id, s, least(e, clip_len) AS e FROM sil JOIN lens ON clip_id = scene_key)
    UNION ALL SELECT scene_key, coalesce(max(least(e, clip_len)), 0), clip_len
    FROM lens LEFT JOIN sil ON clip_id = scene_key GROUP BY ALL)
  WHERE t1 - t0 > 0.05""", "sil", "lens")
def speech_from_silence(spark, folder):
    t = T.tracks(spark, folder)
    sil = T.track(t, "clip").select(C("scene_key").alias("clip_id"), (C("t0") + 0.2).alias("s"),
                                    (C("t1") + 0.4).alias("e"))
    clips = t.select(C("scene_key").alias("clip_id")).distinct().withColumn(
        "duration", T.clip_seconds(C("clip_id")))
    return I.complement(sil, clips, chunk_s=SMALL_S)


block("isl", """
  SELECT *, sum(new) OVER (PARTITION BY scene_key ORDER BY t0, t1, seg_ix) AS island FROM (
    SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY scene_key ORDER BY t0, t1, seg_ix) > 0.5
      THEN 1 ELSE 0 END AS new FROM clip)""", "clip")


@query("w3_utterance_islands", "SELECT scene_key, seg_ix, island::BIGINT AS island FROM isl", "isl")
def utterance_islands(spark, folder):
    return I.islands(_clip(spark, folder), "scene_key", 0.5, chunk_s=SMALL_S).select("scene_key", "seg_ix", "island")


@query("w4_merge_overlaps", """
  SELECT scene_key, min(t0) AS t0, max(t1) AS t1 FROM (
    SELECT *, sum(new) OVER (PARTITION BY scene_key ORDER BY t0, t1) AS g FROM (
      SELECT *, CASE WHEN t0 > coalesce(max(t1) OVER (PARTITION BY scene_key ORDER BY t0, t1
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new
      FROM (SELECT scene_key, t0, t1 + 0.3 AS t1 FROM trk))) GROUP BY scene_key, g
  HAVING max(t1) - min(t0) >= 0.05""", "trk")
def merge_overlaps(spark, folder):
    rows = T.tracks(spark, folder).withColumn("t1", C("t1") + 0.3)
    return I.merge_overlaps(rows, "scene_key", chunk_s=SMALL_S)


@query("w5_long_gaps", """
  SELECT scene_key, t1 + 0.4 / 2 AS t0, n - 0.4 / 2 AS t1 FROM (
    SELECT *, lead(t0) OVER (PARTITION BY scene_key ORDER BY t0) AS n FROM clip)
  WHERE n - t1 > 0.45::DOUBLE""", "clip")
def long_gaps(spark, folder):
    return I.long_gaps(_clip(spark, folder), "scene_key", 0.45, 0.4, chunk_s=SMALL_S)


@query("w6_monotone", """
  SELECT event_id, max(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM (
    SELECT *, (props->>'$.k')::BIGINT + rn // 4 AS k FROM (SELECT e.*, n.rn FROM events e
      JOIN evn n USING (event_id)))""", "evn")
def monotone(spark, folder):
    rows = T.numbered_events(spark, folder).join(
        T.table(spark, folder, "events").select("event_id", "props"), "event_id")
    k = F.from_json("props", "k bigint")["k"] + F.floor(C("rn") / 4)
    return scan(rows, ["user_id"], ["ts", "event_id"], F.floor(C("rn") / 4096),
                maxes={"seg": k}).select("event_id", "seg")


@query("w7_running_offset", """
  SELECT project, scene, coalesce(sum(rendered_ms) OVER (PARTITION BY project ORDER BY scene
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ms FROM osc""", "osc")
def running_offset(spark, folder):
    rows = T.order_scenes(spark, folder)
    return S.running_offset(rows, "project", "scene", F.coalesce("rendered_ms", F.lit(0)),
                            F.floor(C("scene") / SMALL_ORDERS)).select(
        "project", "scene", C("offset").cast("bigint").alias("offset_ms"))


@query("w8_push_later", """
  WITH RECURSIVE c AS (SELECT scene_key, seg_ix, m0 - 60 * seg_ix AS o, 700 + m1 % 400 AS v FROM clip),
  r AS (SELECT scene_key, seg_ix, o AS place, o + v AS fin FROM c WHERE seg_ix = 0
    UNION ALL SELECT c.scene_key, c.seg_ix, greatest(c.o, r.fin + 40), greatest(c.o, r.fin + 40) + c.v
    FROM r JOIN c ON c.scene_key = r.scene_key AND c.seg_ix = r.seg_ix + 1)
  SELECT scene_key, seg_ix, place FROM r""".replace("FROM clip)", """FROM (
    SELECT user_id * 4294967296 + rn // 12 AS scene_key, (rn % 12) // 2 AS seg_ix, m0, m0 + 300 + cents % 450 AS m1
    FROM (SELECT *, ((rn % 12) // 2) * 1000 + (event_id * 37) % 200 AS m0 FROM (
      SELECT *, CAST(round(value * 100) AS BIGINT) AS cents,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events))
    WHERE rn % 12 % 2 = 0))"""))
def push_later(spark, folder):
    rows = _clip(spark, folder).select("scene_key", C("seg_ix").alias("ix"),
                                       (C("m0") - 60 * C("seg_ix")).alias("out"),
                                       (700 + C("m1") % 400).alias("voiced"))
    return I.push_later(rows, "scene_key", 40).select("scene_key", C("ix").alias("seg_ix"), "place")


@query("w9_cut_clock", """
  SELECT n.scene_key, n.seg_ix, any_value(n.m0) - 50 - sum(CASE WHEN n.m0 > c.m1 THEN least(c.e, n.m0) - c.m1
    ELSE 0 END)::BIGINT AS out_ms
  FROM narr n LEFT JOIN (SELECT scene_key, m1, m1 + 180 AS e FROM clip) c USING (scene_key)
  GROUP BY n.scene_key, n.seg_ix""", "narr", "clip")
def cut_clock(spark, folder):
    t = T.tracks(spark, folder)
    cuts = T.track(t, "clip").select("scene_key", (C("m1") / 1000).alias("a"),
                                     ((C("m1") + 180) / 1000).alias("b"))
    points = T.track(t, "narration").select(
        "scene_key", "seg_ix", C("t0").alias("t"), F.lit(0.05).alias("w0"))
    return I.cut_clock(points, cuts, "scene_key", ["seg_ix"], chunk_s=SMALL_S).select(
        "scene_key", "seg_ix", F.rint(C("out") * 1000).cast("bigint").alias("out_ms"))


@query("w10_moving_average", """
  SELECT clip_id, frame, round((coalesce(lag(mouth) OVER w, 0) + mouth + coalesce(lead(mouth) OVER w, 0)) / 3, 6)
    AS smooth FROM frm WINDOW w AS (PARTITION BY clip_id ORDER BY frame)""", "frm")
def moving_average(spark, folder):
    return S.moving_average(T.frames(spark, folder), "clip_id", "frame", "mouth", "smooth").select(
        "clip_id", "frame", F.round("smooth", 6).alias("smooth"))


@query("w11_frame_difference", """
  SELECT clip_id, frame, round(avg(CASE WHEN i <= 40 THEN d END), 6) AS mouth,
    round(avg(CASE WHEN i > 40 THEN d END), 6) AS ref FROM (
    SELECT label AS clip_id, vec_id - 1 AS frame, i, abs(v - lag(v) OVER (PARTITION BY label, i ORDER BY vec_id)) AS d
    FROM (SELECT label, vec_id, i, embedding[i]::DOUBLE * 255 AS v FROM embeddings,
      unnest(range(1, len(embedding) + 1)) r(i))) WHERE d IS NOT NULL GROUP BY ALL""")
def frame_difference(spark, folder):
    rows = T.table(spark, folder, "embeddings").select(
        C("label").alias("clip_id"), C("vec_id").alias("frame"),
        F.posexplode("embedding").alias("px", "v")).select(
        "clip_id", "frame", "px", F.when(C("px") < 40, "mouth").otherwise("ref").alias("box"),
        (C("v").cast("double") * 255).alias("value"))
    return S.frame_difference(rows).select("clip_id", "frame", F.round("mouth", 6).alias("mouth"),
                                           F.round("ref", 6).alias("ref"))


block("curve", """
  SELECT clip_id, frame, (coalesce(lag(x) OVER w, 0) + x + coalesce(lead(x) OVER w, 0)) / 3 AS a,
    (frame + 1) / 24 AS t
  FROM (SELECT *, greatest(mouth - 0.8::DOUBLE * ref, 0) AS x FROM frm)
  WINDOW w AS (PARTITION BY clip_id ORDER BY frame)""", "frm")


@query("w12_rises", """
  SELECT clip_id, frame FROM (SELECT *, max(a) OVER (PARTITION BY clip_id ORDER BY frame
      ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM curve) WHERE frame >= 3 AND a >= 11 AND before < 11""", "curve")
def rises(spark, folder):
    curve = S.motion_curve(T.frames(spark, folder))
    level = curve.select("clip_id").distinct().withColumn("threshold", F.lit(11.0))
    return S.rises(curve, level).select("clip_id", "frame")


@query("w13_anchor_pieces", """
  SELECT scene_key, seg_ix, kind, round(f, 6) AS factor FROM (
    SELECT c.scene_key, c.seg_ix, 'speech' AS kind, (n.t1 - n.t0) / (c.t1 - c.t0) AS f
    FROM clip c JOIN narr n USING (scene_key, seg_ix) UNION ALL
    SELECT scene_key, seg_ix, 'pause', (nt - t1) / (nc - c1) FROM (
      SELECT c.scene_key, c.seg_ix, n.t1, c.t1 AS c1, lead(n.t0) OVER w AS nt, lead(c.t0) OVER w AS nc
      FROM clip c JOIN narr n USING (scene_key, seg_ix) WINDOW w AS (PARTITION BY c.scene_key ORDER BY seg_ix))
    WHERE nt IS NOT NULL)""", "clip", "narr")
def anchor_pieces(spark, folder):
    from cuegrid.operators.align import anchor_pieces as pieces

    t = T.tracks(spark, folder)
    pairs = T.track(t, "clip").select("scene_key", "seg_ix", C("t0").alias("cs"), C("t1").alias("ce")).join(
        T.track(t, "narration").select("scene_key", "seg_ix", C("t0").alias("ts"), C("t1").alias("te")),
        ["scene_key", "seg_ix"])
    out = pieces(pairs.withColumnRenamed("seg_ix", "ix"), "scene_key")
    return out.select("scene_key", C("ix").alias("seg_ix"),
                      F.when(C("speaking"), "speech").otherwise("pause").alias("kind"),
                      F.round((C("t1") - C("t0")) / (C("c1") - C("c0")), 6).alias("factor"))


@query("w14_midpoint_cuts", """
  SELECT scene_key, seg_ix, coalesce((lag(t1) OVER w + t0) / 2, 0) AS cut0,
    coalesce((t1 + lead(t0) OVER w) / 2, 6.5) AS cut1 FROM narr
  WINDOW w AS (PARTITION BY scene_key ORDER BY seg_ix)""", "narr")
def midpoint_cuts(spark, folder):
    rows = _narr(spark, folder).select("scene_key", C("seg_ix").alias("ix"), C("t0").alias("start"),
                                       C("t1").alias("end"), F.lit(6.5).alias("length"))
    return I.midpoint_cuts(rows, "scene_key").select("scene_key", C("ix").alias("seg_ix"), "cut0", "cut1")


@query("w15_failure_streak", """
  SELECT project, scene, streak, max(hit) OVER (PARTITION BY project ORDER BY scene) = 0 AS attempted FROM (
    SELECT *, CASE WHEN coalesce(lag(streak) OVER (PARTITION BY project ORDER BY scene), 0) >= 3 THEN 1 ELSE 0 END AS hit
    FROM (SELECT *, CASE WHEN status = 'failed' THEN row_number() OVER (PARTITION BY project, g, status = 'failed'
        ORDER BY scene) ELSE 0 END AS streak
      FROM (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY scene) AS g
        FROM osc)))""", "osc")
def failure_streak(spark, folder):
    return S.failure_streak(T.order_scenes(spark, folder), "project", "scene", C("status") == "failed",
                            3, F.floor(C("scene") / SMALL_ORDERS)).select("project", "scene", "streak", "attempted")


@query("w15_quota_stop", """
  SELECT project, scene, streak, coalesce(max(ends) OVER (PARTITION BY project ORDER BY scene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted FROM (
    SELECT *, CASE WHEN streak >= 3 OR spent THEN 1 ELSE 0 END AS ends FROM (
      SELECT *, CASE WHEN status = 'failed' THEN row_number() OVER (PARTITION BY project, g, status = 'failed' ORDER BY scene) ELSE 0 END AS streak
      FROM (SELECT *, status = 'failed' AND audio_ms % 5 = 0 AS spent, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY scene) AS g
        FROM osc)))""", "osc")
def quota_stop(spark, folder):
    """A failure whose audio length is a multiple of five milliseconds stands for a spent quota."""
    return S.failure_streak(T.order_scenes(spark, folder), "project", "scene", C("status") == "failed", 3, F.floor(C("scene") / SMALL_ORDERS),
                            quota=(C("status") == "failed") & (C("audio_ms") % 5 == 0)).select("project", "scene", "streak", "attempted")


@query("w16_budget", """
  SELECT project, scene FROM (SELECT *, sum(CASE WHEN status <> 'complete' THEN 1 ELSE 0 END) OVER (
    PARTITION BY project ORDER BY scene) AS used FROM osc) WHERE used <= 3""", "osc")
def budget(spark, folder):
    return S.within_budget(T.order_scenes(spark, folder), "project", "scene", C("status") != "complete",
                           3, F.floor(C("scene") / SMALL_ORDERS)).select("project", "scene")


@query("w17_leading_segments", """
  SELECT project, scene_id, CASE WHEN NOT bool_or(seg = 0) THEN 0 WHEN NOT bool_or(seg = 1) THEN 1
    WHEN NOT bool_or(seg = 2) THEN 2 WHEN NOT bool_or(seg = 3) THEN 3 ELSE 4 END AS n
  FROM (SELECT *, p_partkey % 4 AS seg FROM fil WHERE length > 0) GROUP BY ALL""", "fil")
def leading_segments(spark, folder):
    rows = T.files(spark, folder).where("length > 0").withColumn("seg", D.segment_number(C("stem")))
    return S.leading_segments(rows, ["project", "scene_id"], "seg")


@query("w21_phrase_ranges", """
  SELECT script_id, first_ix, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE first_ix END AS i0,
    coalesce(lead(first_ix) OVER w - 1, n - 1) AS i1
  FROM (SELECT script_id, sent_ix AS first_ix, max(sent_ix) OVER (PARTITION BY script_id) + 1 AS n FROM sents)
  WHERE first_ix % 3 = 1 WINDOW w AS (PARTITION BY script_id ORDER BY first_ix)""", "sents")
def phrase_ranges(spark, folder):
    from cuegrid.operators.lips import phrase_ranges as ranges

    base = T.sentence_arrays(spark, folder).withColumn("n", F.size("sents"))
    firsts = base.where("n > 1").select("script_id", "n", F.filter(F.sequence(F.lit(0), C("n") - 1),
                                                   lambda i: i % 3 == 1).alias("firsts"))
    return firsts.select("script_id", F.explode(ranges(C("firsts"), C("n"))).alias("r")).select(
        "script_id", "r.first_ix", "r.i0", "r.i1")


@query("w22_work_requests", """
  SELECT scene_key, i - 1 AS segment, CASE i WHEN 1 THEN 8.0 ELSE 4.0 END::DOUBLE AS duration,
    CASE i WHEN 1 THEN 'master.jpg' ELSE f || '.mp4' END AS reference,
    CASE i WHEN 1 THEN array_to_string(w[1:k], ' ') ELSE array_to_string(w[k + 1:], ' ') END AS dialogue
  FROM (SELECT script_id * 4294967296 + scene_ix AS scene_key, 'scene_' || (scene_ix + 1) AS f, """
       + T.sql_words("text") + """ AS w, round_even(len(""" + T.sql_words("text") + """) * 8.0::DOUBLE / 12, 0)::INT AS k
    FROM scn), unnest([1, 2]) r(i)""", "scn")
def work_requests(spark, folder):
    name = F.concat(F.lit("scene_"), (C("scene_ix") + 1).cast("string"))
    rows = T.scenes(spark, folder).select(
        (C("script_id") * T.SCENES + C("scene_ix")).alias("scene_key"), "text",
        F.array(F.lit(8.0), F.lit(4.0)).alias("clip_durations"),
        F.array(F.concat(name, F.lit(".mp4")), F.concat(name, F.lit("_b.mp4"))).alias("video_files"))
    return S.work_requests(rows, F.lit("master.jpg"), anchored=False).select(
        "scene_key", "segment", "duration", "reference", "dialogue")


@query("t3_merge_to", """
  SELECT scene_key, row_number() OVER (PARTITION BY scene_key ORDER BY min(t0)) - 1 AS seg_ix, min(t0) AS t0, max(t1) AS t1
  FROM (SELECT *, sum(CASE WHEN closed THEN 0 ELSE 1 END) OVER (PARTITION BY scene_key ORDER BY seg_ix) AS g FROM (
    SELECT *, gap IS NOT NULL AND row_number() OVER (PARTITION BY scene_key, gap IS NULL ORDER BY gap, seg_ix) <= n - 3 AS closed
    FROM (SELECT *, t0 - lag(t1) OVER (PARTITION BY scene_key ORDER BY seg_ix) AS gap,
      count(*) OVER (PARTITION BY scene_key) AS n FROM clip))) GROUP BY scene_key, g""", "clip")
def merge_to(spark, folder):
    rows = _clip(spark, folder)
    sizes = rows.select("scene_key").distinct().withColumn("wanted", F.lit(3))
    return I.merge_to(rows, sizes, "scene_key")


@query("k10_pick_utterance", """
  SELECT scene_key, seg_ix FROM isl JOIN (
    SELECT scene_key, arg_min(island, (abs(b - a - 2.2), island)) AS island FROM (
      SELECT scene_key, island, min(t0) AS a, max(t1) AS b FROM isl GROUP BY ALL) GROUP BY scene_key)
  USING (scene_key, island)""", "isl")
def pick_utterance(spark, folder):
    rows = _clip(spark, folder)
    lengths = rows.select("scene_key").distinct().withColumn("narration", F.lit(2.2))
    return I.pick_island(rows, lengths, "scene_key", 0.5).select("scene_key", "seg_ix")


@query("j3_locate_words", """
  SELECT scene_key, word_ix, seg_ix FROM (
    SELECT *, row_number() OVER (PARTITION BY scene_key, word_ix ORDER BY tier, k1, seg_ix) AS r FROM (
      SELECT w.scene_key, w.seg_ix AS word_ix, s.seg_ix, CASE WHEN s.t0 <= p AND p < s.t1 THEN 0
          WHEN least(s.t1, w.e) > greatest(s.t0, w.t0) THEN 1 ELSE 2 END AS tier,
        CASE WHEN s.t0 <= p AND p < s.t1 THEN 0
          WHEN least(s.t1, w.e) > greatest(s.t0, w.t0) THEN -(least(s.t1, w.e) - greatest(s.t0, w.t0))
          ELSE least(abs(s.t0 - p), abs(s.t1 - p)) END AS k1
      FROM (SELECT *, greatest(t0, e - 0.05) AS p FROM (SELECT *, t1 + m1 % 5 * 0.1 AS e FROM narr)) w
      JOIN clip s USING (scene_key))) WHERE r = 1""", "narr", "clip")
def locate_words(spark, folder):
    t = T.tracks(spark, folder)
    segs = T.track(t, "clip")
    words = T.track(t, "narration").join(segs.select("scene_key").distinct(), "scene_key", "left_semi").select(
        "scene_key", C("seg_ix").cast("long").alias("word_ix"), "t0",
        (C("t1") + C("m1") % 5 * 0.1).alias("t1"))
    return I.locate(words, segs, "scene_key", chunk_s=SMALL_S).select("scene_key", "word_ix", "seg_ix")


@query("j4_placed_voice", """
  SELECT scene_key, n.seg_ix, p.seg_ix AS piece, p.t0 + (greatest(n.t0, p.t0) - p.t0) / 1.25 AS v0,
    p.t0 + (least(n.t1, p.e) - p.t0) / 1.25 AS v1
  FROM narr n JOIN (SELECT *, t1 + 0.35 AS e FROM clip) p USING (scene_key)
  WHERE least(n.t1, p.e) > greatest(n.t0, p.t0)""", "narr", "clip")
def placed_voice(spark, folder):
    from cuegrid.operators.fit import placed_voice as place

    t = T.tracks(spark, folder)
    pieces = T.track(t, "clip").select("scene_key", C("seg_ix").alias("piece"), C("t0").alias("narr_start"),
                                       (C("t1") + 0.35).alias("narr_end"), F.lit(1.25).alias("tempo"),
                                       C("t0").alias("out_start"))
    return place(T.track(t, "narration"), pieces, "scene_key").select("scene_key", "seg_ix", "piece", "v0", "v1")


@query("j5_window_clip", """
  SELECT scene_key, seg_ix, t0 - 1.2 AS s, t1 - 1.2 AS e FROM clip WHERE t1 > 1.2 AND t0 < 4.1""", "clip")
def window_clip(spark, folder):
    rows = _clip(spark, folder)
    windows = rows.select("scene_key").distinct().select("scene_key", F.lit(1.2).alias("w0"), F.lit(4.1).alias("w1"))
    from cuegrid.operators.fit import window_clip as clip
    return clip(rows, windows, "scene_key").select("scene_key", "seg_ix", "s", "e")


@query("j6_nearest_onset", """
  SELECT n.scene_key, n.seg_ix, arg_min(c.t0, (abs(c.t0 - n.t0), c.t0)) FILTER (
    c.t0 BETWEEN n.t0 - 0.1 AND n.t0 + 0.1) AS onset FROM narr n LEFT JOIN clip c USING (scene_key) GROUP BY ALL""", "narr", "clip")
def nearest_onset(spark, folder):
    t = T.tracks(spark, folder)
    marks = T.track(t, "clip").select("scene_key", C("t0").alias("m"))
    return I.nearest_within(T.track(t, "narration").select("scene_key", "seg_ix", "t0"), marks, ["scene_key"],
                            "t0", "m", ["seg_ix"], 0.1).select("scene_key", "seg_ix", C("found").alias("onset"))


block("edges", """
  SELECT scene_key, t, sum(da) AS da, sum(db) AS db FROM (
    SELECT scene_key, unnest([greatest(m0, 500), least(m1, 5200)]) AS t, unnest([1, -1]) * (CASE track WHEN 'clip' THEN 1 ELSE 0 END) AS da,
      unnest([1, -1]) * (CASE track WHEN 'clip' THEN 0 ELSE 1 END) AS db
    FROM trk WHERE least(m1, 5200) > greatest(m0, 500)) GROUP BY ALL""", "trk")


@query("k8_disagreement", """
  SELECT scene_key, round(coalesce(sum(CASE WHEN (a > 0) <> (b > 0) THEN nt - t END), 0) / 1000, 3) AS seconds
  FROM (SELECT DISTINCT scene_key FROM trk) LEFT JOIN (
    SELECT scene_key, t, sum(da) OVER w AS a, sum(db) OVER w AS b, lead(t) OVER w AS nt FROM edges
    WINDOW w AS (PARTITION BY scene_key ORDER BY t)) USING (scene_key) GROUP BY scene_key""", "edges")
def disagreement(spark, folder):
    t = T.tracks(spark, folder)
    windows = t.select("scene_key").distinct().select("scene_key", F.lit(0.5).alias("w0"), F.lit(5.2).alias("w1"))
    return I.disagreement(T.track(t, "clip"), T.track(t, "narration"), windows, "scene_key", chunk_s=SMALL_S)


@query("k18_cuts", """
  SELECT scene_key, min(t0) AS t0, max(t1) AS t1 FROM (
    SELECT *, sum(new) OVER (PARTITION BY scene_key ORDER BY t0, t1) AS g FROM (
      SELECT *, CASE WHEN t0 > coalesce(max(t1) OVER (PARTITION BY scene_key ORDER BY t0, t1
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) THEN 1 ELSE 0 END AS new FROM (
        SELECT scene_key, t0 - 0.04 AS t0, t1 + 0.04 AS t1 FROM rng WHERE NOT used AND t1 - t0 >= 0.25
        UNION ALL SELECT scene_key, t1 + 0.225, n - 0.225 FROM (
          SELECT *, lead(t0) OVER (PARTITION BY scene_key ORDER BY seg_ix) AS n FROM rng
          WHERE used OR t1 - t0 < 0.25) WHERE n - t1 > 0.7::DOUBLE))) GROUP BY scene_key, g
  HAVING max(t1) - min(t0) >= 0.05""", "rng")
def cuts(spark, folder):
    from cuegrid.operators.lips import plan_cuts

    rows = _clip(spark, folder)
    used = rows.where("m1 % 3 <> 0").select("scene_key", "seg_ix")
    return plan_cuts(rows, used, "scene_key")


block("rng", """
  SELECT c.*, m1 % 3 <> 0 AS used FROM clip c JOIN (SELECT scene_key, min(seg_ix) AS lo, max(seg_ix) AS hi
    FROM clip WHERE m1 % 3 <> 0 GROUP BY ALL) USING (scene_key) WHERE seg_ix BETWEEN lo AND hi""", "clip")


@query("k22_onsets", """
  SELECT clip_id, near, onset FROM (SELECT clip_id, near, arg_min(t, (abs(t - near), t)) FILTER (ok) AS onset FROM (
    SELECT c.clip_id, near, c.t, l.peak - l.base >= 0.3 AND c.frame >= 3 AND a >= l.base + 0.35 * (l.peak - l.base)
      AND max(a) OVER (PARTITION BY c.clip_id, near ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
        < l.base + 0.35 * (l.peak - l.base) AND t BETWEEN near - 0.6 AND near + 0.6 AS ok
    FROM curve c JOIN (SELECT clip_id, near, coalesce(median(a) FILTER (t < near - 0.6), quantile_cont(a, 0.2)) AS base,
      quantile_cont(a, 0.9) AS peak FROM curve, unnest([1.3::DOUBLE, 2.0::DOUBLE]) n(near) GROUP BY clip_id, near) l USING (clip_id)) GROUP BY clip_id, near)""", "curve")
def onsets(spark, folder):
    curve = S.motion_curve(T.frames(spark, folder))
    points = T.table(spark, folder, "embeddings").select(C("vec_id").alias("clip_id"), F.explode(F.array(F.lit(1.3), F.lit(2.0))).alias("near"))
    return S.speaking_onsets(curve, points).select("clip_id", "near", "onset")


@query("k23_color_match", """
  SELECT scene, 'lutrgb=' || string_agg(channel || '=''clip((val-' || printf('%.2f', m) || ')*' || printf('%.4f', ts / s)
    || '+' || printf('%.2f', tm) || ',0,255)''', ':' ORDER BY channel DESC) AS filter
  FROM (SELECT scene % 3 AS project, scene, channel, avg(value) AS m, stddev_pop(value) AS s FROM pix GROUP BY ALL)
  JOIN (SELECT project, channel, median(m) AS tm, median(s) AS ts FROM (SELECT scene % 3 AS project, scene, channel, avg(value) AS m,
    stddev_pop(value) AS s FROM pix GROUP BY ALL) GROUP BY project, channel) USING (project, channel) GROUP BY scene""", "pix")
def color_match(spark, folder):
    from cuegrid.plans.color import color_filters

    return color_filters(T.pixels(spark, folder).withColumn("project", C("scene") % 3)).select("scene", "filter")


@query("a7_percentiles", """
  SELECT clip_id, median(mouth) AS mid, quantile_cont(mouth, 0.2) AS p20, quantile_cont(mouth, 0.9) AS p90
  FROM frm GROUP BY ALL""", "frm")
def exact_percentiles(spark, folder):
    return I.percentiles(T.frames(spark, folder), ["clip_id"], "mouth",
                         {"mid": 0.5, "p20": 0.2, "p90": 0.9}, 1.0)


@query("f6_min_length", """
  SELECT scene_key, seg_ix FROM (SELECT *, max(t1 - t0) OVER (PARTITION BY scene_key) AS longest FROM clip)
  WHERE t1 - t0 >= 0.6::DOUBLE OR longest < 0.6::DOUBLE""", "clip")
def min_length(spark, folder):
    from cuegrid.operators.fit import long_segments

    rows = T.speech_arrays(spark, folder)
    return rows.select("scene_key", F.explode(long_segments(C("clip"), 0.6)).alias("s")).select(
        "scene_key", F.floor(C("s.t0")).cast("int").alias("seg_ix"))


@query("f7_no_end_touch", """
  SELECT scene_key, seg_ix FROM (SELECT *, row_number() OVER (PARTITION BY scene_key ORDER BY seg_ix DESC) AS back,
    count(*) OVER (PARTITION BY scene_key) AS n FROM clip)
  WHERE NOT (n > 1 AND back = 1 AND 5.75 - t1 < 0.15)""", "clip")
def no_end_touch(spark, folder):
    from cuegrid.operators.fit import without_end_touch

    return T.speech_arrays(spark, folder).where(F.size("clip") > 0).select(
        "scene_key", F.explode(without_end_touch(C("clip"), F.lit(5.75))).alias("s")).select(
        "scene_key", F.floor(C("s.t0")).cast("int").alias("seg_ix"))
