"""Queries for planning and alignment: clip choice, fitting, retiming, words, pace, modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid import params as P
from cuegrid.catalog import tables as T
from cuegrid.catalog.base import block, query
from cuegrid.functions import text as X
from cuegrid.operators import align as A, fit as FT, lips as L, sync as S
from cuegrid.operators.rows import keep_parallel, settled

C = F.col
_COMBOS = ", ".join(f"({n}, {k}, {sum(c)}::DOUBLE, '{'+'.join(str(int(x)) for x in sorted(c, reverse=True))}')"
                    for n, k, c in S.clip_combinations(P.Clips().allowed))
block("combo", f"SELECT * FROM (VALUES {_COMBOS}) v(n, k, total, clips)")
_CHOICE = """SELECT {key}, arg_min(clips, (n, NOT (total / t BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9),
      CASE WHEN total / t BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9 THEN abs(ln(total / t)) ELSE total END, total, k)) AS clips
    FROM {rows} CROSS JOIN combo WHERE total / t >= 0.9::DOUBLE - 1e-9 AND (total / t <= 1.15::DOUBLE + 1e-9 OR total / t > 1.15) GROUP BY {key}"""


def _joined(clips):
    return F.array_join(F.transform(clips, lambda c: c.cast("int").cast("string")), "+")


def _speech(spark, folder):
    key = C("scene_key")
    return T.speech_arrays(spark, folder).withColumn("clip_len", T.clip_seconds(key)).withColumn(
        "narr_len", F.lit(6.2)).withColumn("target", F.lit(6.4))


@query("k3_clip_choice", "SELECT scene, clips FROM osc LEFT JOIN (" + _CHOICE.format(
    key="scene", rows="(SELECT scene, audio_ms / 1000 * 3.7::DOUBLE AS t FROM osc)") + ") USING (scene)", "osc", "combo")
def clip_choice(spark, folder):
    return T.order_scenes(spark, folder).select("scene", _joined(S.choose_clips(
        C("audio_ms") / 1000 * F.lit(3.7))).alias("clips"))


@query("j7_fitting_combinations", """
  SELECT scene, count(*) AS fitting, min(n) AS fewest FROM (SELECT scene, audio_ms / 1000 * 3::DOUBLE AS t FROM osc) JOIN combo
    ON total / t BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9 GROUP BY scene""", "osc", "combo")
def fitting_combinations(spark, folder):
    combos = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(sum(c))).alias("total"))
                       for n, _, c in S.clip_combinations(P.Clips().allowed)])
    target = C("audio_ms") / 1000 * F.lit(3.0)
    fits = F.filter(combos, lambda c: S.in_range(c["total"] / target))
    return T.order_scenes(spark, folder).select("scene", fits.alias("f")).where(F.size("f") > 0).select(
        "scene", F.size("f").cast("bigint").alias("fitting"),
        F.array_min(F.transform("f", lambda c: c["n"])).alias("fewest"))


block("syn", """
  SELECT *, CASE WHEN v <= 0 THEN 'insufficient' WHEN abs(v / t - 1) < 0.005 THEN 'exact'
    WHEN v / t BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9 THEN 'retime' WHEN v / t > 1.15 THEN 'trim' ELSE 'insufficient' END AS action
  FROM (SELECT scene, ceil(round((audio_ms / 1000 + 0.2::DOUBLE) * 24, 6)) / 24 AS t,
    (CASE scene % 4 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 6 END)::DOUBLE AS v FROM osc)""", "osc")


def _sync_rows(spark, folder):
    k = C("scene") % 4
    clips = (F.when(k == 0, F.array().cast("array<double>")).when(k == 1, F.array(F.lit(4.0)))
             .when(k == 2, F.array(F.lit(8.0))).otherwise(F.array(F.lit(6.0))))
    return T.order_scenes(spark, folder).select("scene", (C("audio_ms") / 1000).alias("a"), clips.alias("c"))


@query("k4_sync_plan", """
  SELECT scene, action, round(CASE WHEN v <= 0 OR action = 'exact' THEN 1 WHEN action = 'retime' THEN t / v
      WHEN action = 'trim' THEN 1 / 1.15 ELSE 1 / 0.9 END, 6) AS factor,
    round(CASE WHEN v <= 0 THEN t WHEN action = 'insufficient' THEN greatest(0, t - v * (1 / 0.9)) + 1 / 24 ELSE 0 END, 3) AS freeze
  FROM syn""", "syn")
def sync_plan(spark, folder):
    p = S.sync_plan(C("a"), C("c"))
    return _sync_rows(spark, folder).select("scene", p.alias("p")).select(
        "scene", "p.action", F.round("p.retime_factor", 6).alias("factor"),
        F.round("p.freeze_pad", 3).alias("freeze"))


@query("k25_top_up", """
  SELECT scene, n_clips, total FROM (
    WITH RECURSIVE g AS (SELECT scene, t, CASE WHEN v > 0 THEN 1 ELSE 0 END AS n, v FROM syn UNION ALL
      SELECT g.scene, g.t, g.n + 1, g.v + CASE WHEN d < 0.9::DOUBLE * 0 THEN 0 ELSE x END FROM (
        SELECT *, t - v AS d, (SELECT CASE WHEN t - v <= 0 THEN NULL
          ELSE CAST(split_part(arg_min(clips, (n, NOT (total / (t - v) BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9),
            CASE WHEN total / (t - v) BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9 THEN abs(ln(total / (t - v))) ELSE total END, total, k)), '+', 1) AS DOUBLE) END
          FROM combo WHERE total / (t - v) >= 0.9::DOUBLE - 1e-9) AS x FROM g
        WHERE g.n < 4 AND (v <= 0 OR v / t < 0.9::DOUBLE - 1e-9)) g WHERE x IS NOT NULL)
    SELECT scene, max(n) AS n_clips, max(v) AS total FROM g GROUP BY scene)""", "syn", "combo")
def top_up(spark, folder):
    return _sync_rows(spark, folder).select("scene", S.top_up(C("a"), C("c")).alias("c")).select(
        "scene", F.size("c").alias("n_clips"), S.total(C("c")).alias("total"))


@query("f8_prune_edges", """
  SELECT scene_key, min(seg_ix) AS first_seg, max(seg_ix) AS last_seg FROM (
    SELECT *, min(CASE WHEN seg_ix = hi OR NOT sf THEN seg_ix END) OVER (PARTITION BY scene_key) AS lo FROM (
      SELECT *, t1 - t0 < 0.25::DOUBLE AND n0 - t1 > 0.5 AS sf FROM (
        SELECT *, max(CASE WHEN seg_ix = 0 OR NOT sb THEN seg_ix END) OVER (PARTITION BY scene_key) AS hi FROM (
          SELECT *, t1 - t0 < 0.25::DOUBLE AND t0 - lag(t1) OVER w > 0.5 AS sb, lead(t0) OVER w AS n0
          FROM (SELECT scene_key, seg_ix, t0, CASE WHEN m1 % 2 = 0 THEN t0 + 0.2 ELSE t1 END AS t1 FROM clip)
          WINDOW w AS (PARTITION BY scene_key ORDER BY seg_ix)))
      WHERE seg_ix <= hi)) WHERE seg_ix >= lo GROUP BY scene_key""", "clip")
def prune_edges(spark, folder):
    rows = T.track(T.tracks(spark, folder), "clip").groupBy("scene_key").agg(F.array_sort(F.collect_list(
        F.struct("t0", F.when(C("m1") % 2 == 0, C("t0") + 0.2).otherwise(C("t1")).alias("t1")))).alias("s"))
    kept = FT.prune_edges(C("s"))
    return rows.select("scene_key", kept.alias("k")).select(
        "scene_key", F.floor(F.get("k", F.lit(0))["t0"]).cast("int").alias("first_seg"),
        F.floor(F.element_at("k", -1)["t0"]).cast("int").alias("last_seg"))


_RUNS = """
  SELECT r.*, min(score) OVER (PARTITION BY scene_key) AS best FROM (
    SELECT a.scene_key, a.seg_ix AS i, b.seg_ix AS j, abs(ln(greatest(nn, 1e-3) / greatest(b.p1 - a.p0, 1e-3)))
      + CASE WHEN b.seg_ix > a.seg_ix AND clip_len - b.t1 < 0.15 THEN 0.15 ELSE 0 END AS score
    FROM (SELECT *, sum(t1 - t0) OVER w AS p1, sum(t1 - t0) OVER w - (t1 - t0) AS p0 FROM clip
        WINDOW w AS (PARTITION BY scene_key ORDER BY seg_ix)) a
    JOIN (SELECT *, sum(t1 - t0) OVER w AS p1 FROM clip WINDOW w AS (PARTITION BY scene_key ORDER BY seg_ix)) b
      ON a.scene_key = b.scene_key AND a.seg_ix <= b.seg_ix
    JOIN (SELECT scene_key, sum(t1 - t0) * SHARE AS nn FROM narr GROUP BY ALL) n ON n.scene_key = a.scene_key
    JOIN lens l ON l.scene_key = a.scene_key) r"""
block("runs", _RUNS.replace("SHARE", "0.6"), "clip", "narr", "lens")


def _line_rows(spark, folder):
    short = F.transform("narr", lambda s: FT.span(s["t0"], s["t0"] + (s["t1"] - s["t0"]) * 0.6))
    rows = _speech(spark, folder).where((F.size("clip") > 0) & (F.size("narr") > 0)).withColumn("n2", short)
    return FT.select_speech(rows, "clip", "n2", C("clip_len"))


@query("k5_select_speech", """
  SELECT scene_key, (q).i AS first_seg, (q).j AS last_seg FROM (
    SELECT scene_key, arg_min({'i': i, 'j': j}, (-(j - i), round(score, 9), i)) AS q FROM runs
    WHERE score <= best + 0.08 GROUP BY scene_key)""", "runs")
def select_speech(spark, folder):
    return _line_rows(spark, folder).select(
        "scene_key", F.floor(F.get("line", F.lit(0))["t0"]).cast("int").alias("first_seg"),
        F.floor(F.element_at("line", -1)["t0"]).cast("int").alias("last_seg"))


@query("w20_run_scores", """
  SELECT scene_key, count(*) AS runs, round(min(score), 6) AS best FROM runs GROUP BY scene_key""", "runs")
def run_scores(spark, folder):
    """Number of contiguous runs and the best score among them, found without listing them."""
    n = F.size("clip")
    return _line_rows(spark, folder).select(
        "scene_key", (n * (n + 1) / 2).cast("bigint").alias("runs"),
        F.round("line_score", 6).alias("best"))


# The search in SQL: every way to pair a scene's segments, listed by recursion.
block("fullruns", _RUNS.replace("SHARE", "1"), "clip", "narr", "lens")
block("sel", """
  SELECT scene_key, row_number() OVER (PARTITION BY scene_key ORDER BY min(ix)) - 1 AS ix, i0, i1 FROM (
    SELECT scene_key, 0 AS ix, (q).i AS i0, (q).j AS i1 FROM (
      SELECT scene_key, arg_min({'i': i, 'j': j}, (-(j - i), round(score, 9), i)) AS q FROM fullruns WHERE score <= best + 0.08 GROUP BY scene_key)
    UNION ALL SELECT scene_key, 1, 0, max(seg_ix) FROM clip GROUP BY scene_key
    UNION ALL SELECT scene_key, 2, 0, max(seg_ix) - CASE WHEN count(*) > 1 AND any_value(clip_len) - max(t1) < 0.15::DOUBLE THEN 1 ELSE 0 END
      FROM clip JOIN lens USING (scene_key) GROUP BY scene_key)
  WHERE scene_key IN (SELECT scene_key FROM narr) GROUP BY scene_key, i0, i1""", "fullruns", "clip", "narr", "lens")
block("arr", """
  SELECT scene_key, ix, i1 - i0 + 1 AS size, nl, al[i0 + 1:i1 + 1] AS cl, clip_len FROM sel JOIN lens USING (scene_key)
  JOIN (SELECT scene_key, list({'a': t0, 'b': t1} ORDER BY seg_ix) AS al FROM clip GROUP BY scene_key) USING (scene_key)
  JOIN (SELECT scene_key, list({'a': t0, 'b': t1} ORDER BY seg_ix) AS nl FROM narr GROUP BY scene_key) USING (scene_key)""", "sel", "lens", "clip", "narr")
block("walk", """
  SELECT * FROM (WITH RECURSIVE w AS (
    SELECT scene_key, ix, 0::BIGINT AS n, 0::BIGINT AS c, []::BIGINT[] AS path, 0.0::DOUBLE AS price, 1e9::DOUBLE AS lo, 0.0::DOUBLE AS hi FROM arr
    UNION ALL SELECT scene_key, ix, n2, c2, list_concat(path, [n2, c2]), price + ln(said / greatest(seen, 1e-3)) ** 2 * (said + seen),
      least(lo, said / greatest(seen, 1e-3)), greatest(hi, said / greatest(seen, 1e-3)) FROM (
      SELECT w.*, n2, c2, nl[n2].b - nl[n + 1].a AS said, cl[c2].b - cl[c + 1].a AS seen FROM w JOIN arr USING (scene_key, ix),
        unnest(range(n + 1, least(n + 4, len(nl)) + 1)) x(n2), unnest(range(c + 1, least(c + 4, len(cl)) + 1)) y(c2))
    WHERE said / greatest(seen, 1e-3) BETWEEN 0.45::DOUBLE AND 2.2::DOUBLE) SELECT * FROM w)""", "arr")
block("grid", "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, {b}::DOUBLE, {lo}::DOUBLE, {hi}::DOUBLE)" for k, (b, lo, hi) in enumerate(
        (b, lo, hi) for b in P.SEARCH_BONUS for lo, hi in P.SEARCH_RATIO)) + ") g(setting, bonus, least_rate, most_rate)")
block("paired", """
  SELECT scene_key, ix, setting, coalesce(path, [len(nl), len(cl)]) AS path FROM arr CROSS JOIN grid LEFT JOIN (
    SELECT w.scene_key, w.ix, setting, arg_min(path, price - len(path) / 2 * bonus) AS path FROM walk w JOIN arr a USING (scene_key, ix), grid
    WHERE n = len(nl) AND c = len(cl) AND lo >= least_rate AND hi <= most_rate GROUP BY w.scene_key, w.ix, setting) USING (scene_key, ix, setting)""",
      "arr", "walk", "grid")
_PHRASES = """
  SELECT scene_key, ix, setting, size, clip_len, k, len(path) // 2 AS n, nl[CASE WHEN k = 0 THEN 0 ELSE path[2 * k - 1] END + 1].a AS ns, nl[path[2 * k + 1]].b AS ne,
    cl[CASE WHEN k = 0 THEN 0 ELSE path[2 * k] END + 1].a AS cs, cl[path[2 * k + 2]].b AS ce
  FROM {paths} JOIN arr USING (scene_key, ix), unnest(range(0, len(path) // 2)) r(k)"""
block("phr", _PHRASES.format(
    paths="(SELECT scene_key, ix, min(setting) AS setting, path FROM paired GROUP BY scene_key, ix, path)"), "paired", "arr")


@query("k6_pair_phrases", "SELECT scene_key, ix AS sel_ix, setting, k, ns, ne, cs, ce FROM (" + _PHRASES.format(paths="paired") + ")",
       "paired", "arr")
def pair_phrases(spark, folder):
    """One row per phrase of every selection under every setting."""
    c = FT.candidates(_speech(spark, folder), C("clip_len"))
    return c.select("scene_key", "sel_ix", "setting", F.posexplode("phrases").alias("k", "p")).select(
        "scene_key", "sel_ix", "setting", "k", "p.*")


@query("j10_candidate_settings", """
  SELECT scene_key, b AS bonus, lo, hi FROM (SELECT DISTINCT scene_key FROM trk),
    (VALUES (0.3::DOUBLE), (0.8::DOUBLE), (1.5::DOUBLE)) x(b), (VALUES (0.55::DOUBLE, 1.8::DOUBLE), (0.45::DOUBLE, 2.2::DOUBLE)) y(lo, hi)""", "trk")
def candidate_settings(spark, folder):
    grid = F.array(*[F.struct(F.lit(b).alias("bonus"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                     for b in P.SEARCH_BONUS for lo, hi in P.SEARCH_RATIO])
    return T.speech_arrays(spark, folder).select("scene_key", F.inline(grid))


def sql_apart(first: str, second: str, keys: str, total: str) -> str:
    """Seconds in [0, total) where only one of two tables of intervals (keys, s, e) is on."""
    cut = "SELECT {k}, greatest(0, least(s, {t})) AS s, greatest(0, least(e, {t})) AS e FROM ({x})"
    edges = " UNION ALL ".join(
        f"SELECT {keys}, unnest([s, e]) AS t, unnest([{a}]) AS da, unnest([{b}]) AS db FROM ({cut.format(k=keys, t=total, x=x)}) WHERE e > s"
        for x, a, b in ((first, "1, -1", "0, 0"), (second, "0, 0", "1, -1")))
    return f"""SELECT {keys}, round(coalesce(sum(CASE WHEN (a > 0) <> (b > 0) THEN nt - t END), 0), 3) AS mismatch FROM (
      SELECT {keys}, t, sum(da) OVER w AS a, sum(db) OVER w AS b, lead(t) OVER w AS nt FROM (
        SELECT {keys}, t, sum(da) AS da, sum(db) AS db FROM ({edges}) GROUP BY ALL)
      WINDOW w AS (PARTITION BY {keys} ORDER BY t)) GROUP BY {keys}"""


def sql_exact(expression: str, digits: int = 3) -> str:
    return f"CAST(printf('%.{digits}f', {expression}) AS DOUBLE)"


_CAND = "scene_key, ix, setting"
_PLACED = """
  SELECT *, greatest(0, cs - w0 - (ns - a) / v) AS o FROM (
    SELECT *, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE (lag(ne) OVER w + ns) / 2 END AS a,
      CASE WHEN k = n - 1 THEN 6.2::DOUBLE ELSE (ne + lead(ns) OVER w) / 2 END AS b,
      greatest(0.7::DOUBLE, least(1.45::DOUBLE, (ne - ns) / greatest(ce - cs, 1e-3))) AS v,
      {w0} AS w0 FROM {phrases} WINDOW w AS (PARTITION BY {keys} ORDER BY k))"""
block("plc", _PLACED.format(w0="greatest(0, first_value(cs) OVER w - 0.25::DOUBLE)", phrases="phr", keys=_CAND), "phr")
block("fitted", f"""
  SELECT *, {sql_exact('greatest(0, w0 + dur - clip_len)')} AS held FROM (
    SELECT {_CAND}, any_value(size) AS size, any_value(clip_len) AS clip_len, any_value(w0) AS w0, any_value(n) AS n,
      count(*) FILTER (v IN (0.7::DOUBLE, 1.45::DOUBLE)) AS clamped,
      ceil(round((greatest(arg_max(ce, k) - any_value(w0), arg_max(o + (ne - a) / v, k)) + 0.3::DOUBLE) * 24, 6)) / 24 AS dur
    FROM plc GROUP BY {_CAND})""", "plc")
block("fitmiss", sql_apart(
    f"SELECT {_CAND}, t0 - w0 AS s, t1 - w0 AS e, dur FROM clip JOIN fitted USING (scene_key) WHERE t1 > w0 AND t0 < w0 + dur",
    f"SELECT {_CAND}, o + (greatest(t0, a) - a) / v AS s, o + (least(t1, b) - a) / v AS e, dur FROM narr JOIN plc USING (scene_key)"
    f" JOIN (SELECT {_CAND}, dur FROM fitted) USING ({_CAND}) WHERE least(t1, b) > greatest(t0, a)", _CAND, "dur"),
      "clip", "narr", "fitted", "plc")
block("bestfit", f"""
  SELECT scene_key, f.* FROM (SELECT scene_key, arg_min({{'w0': w0, 'dur': dur, 'freeze_pad': held, 'mismatch': mismatch, 'n': n}},
      ({sql_exact('mismatch + 0.05::DOUBLE * clamped + 0.5::DOUBLE * held')}, -size, ix, setting)) AS f
    FROM fitted JOIN fitmiss USING ({_CAND}) GROUP BY scene_key)""", "fitted", "fitmiss")
block("plain_phr", """
  SELECT scene_key, n.seg_ix AS k, count(*) OVER (PARTITION BY scene_key) AS n, n.t0 AS ns, n.t1 AS ne, coalesce(c.t0, l.t0) AS cs, coalesce(c.t1, l.t1) AS ce
  FROM narr n LEFT JOIN clip c USING (scene_key, seg_ix)
  JOIN (SELECT scene_key, arg_max(t0, seg_ix) AS t0, max(t1) AS t1 FROM clip GROUP BY scene_key) l USING (scene_key)""", "narr", "clip")


@query("k7_fit_placement", "SELECT scene_key, k AS ix, round(a, 9) AS narr_start, round(b, 9) AS narr_end, round(v, 9) AS tempo, round(o, 9) AS out_start FROM ("
       + _PLACED.format(w0="0.0::DOUBLE", phrases="plain_phr", keys="scene_key") + ")", "plain_phr")
def fit_placement(spark, folder):
    """One phrase a segment, on the clip's segment of its number or the last one."""
    rows = _speech(spark, folder).where((F.size("clip") > 0) & (F.size("narr") > 0))
    phrases = F.transform("narr", lambda s, k: X.bound(
        F.coalesce(F.get("clip", k), F.element_at("clip", -1)), lambda c: F.struct(
            s["t0"].alias("ns"), s["t1"].alias("ne"), c["t0"].alias("cs"), c["t1"].alias("ce"))))
    return rows.select("scene_key", F.posexplode(FT.placements(phrases, C("narr_len"), F.lit(0.0))).alias("ix", "p")).select(
        "scene_key", "ix", *[F.round(C("p")[n], 9).alias(n) for n in ("narr_start", "narr_end", "tempo", "out_start")])


@query("k9_fit_search", f"""
  SELECT {_CAND.replace('ix,', 'ix AS sel_ix,')}, n AS n_phrases, clamped, round(w0, 6) AS w0, round(dur, 6) AS dur, held AS freeze_pad, mismatch
  FROM fitted JOIN fitmiss USING ({_CAND})""", "fitted", "fitmiss")
def fit_search(spark, folder):
    """Every candidate's plan; settings that pair alike count once."""
    c = FT.fit_plans(FT.candidates(_speech(spark, folder), C("clip_len"), once=True), C("narr_len"), C("clip_len"))
    return c.select("scene_key", "sel_ix", "setting", F.size("phrases").alias("n_phrases"), F.col("clamped").cast("bigint").alias("clamped"),
                    F.round("w0", 6).alias("w0"), F.round("dur", 6).alias("dur"), "freeze_pad", "mismatch")


@query("k9_fit_plans", """
  SELECT scene_key, CASE WHEN n > 1 THEN 'phrases' ELSE 'span' END AS mode, n AS n_phrases, round(w0, 6) AS w0, round(dur, 6) AS dur, freeze_pad, mismatch
  FROM bestfit""", "bestfit")
def fit_plans(spark, folder):
    return FT.plan_fit(_speech(spark, folder), "scene_key").select(
        "scene_key", "mode", "n_phrases", F.round("w0", 6).alias("w0"), F.round("dur", 6).alias("dur"),
        "freeze_pad", "mismatch")


def _two_sided(spark, folder):
    return _speech(spark, folder).where((F.size("clip") > 0) & (F.size("narr") > 0))


_PAIRS = """SELECT c.scene_key, c.seg_ix, c.t0 AS cs, c.t1 AS ce, n.t0 AS ns, n.t1 AS ne FROM clip c JOIN narr n USING (scene_key, seg_ix)"""
block("prs", _PAIRS, "clip", "narr")
block("tmap", """
  SELECT scene_key, seg_ix, cs, ce, ns, ne, (ne - ns) BETWEEN 0.6::DOUBLE * (ce - cs) AND 1.6::DOUBLE * (ce - cs) AS ok1,
    coalesce((lead(ns) OVER w - ne) BETWEEN 0.3::DOUBLE * (lead(cs) OVER w - ce) AND 3 * (lead(cs) OVER w - ce), true) AS ok2,
    lead(ns) OVER w AS nn, lead(cs) OVER w AS nc FROM prs WINDOW w AS (PARTITION BY scene_key ORDER BY seg_ix)""", "prs")


def _time_maps(spark, folder):
    rows = _two_sided(spark, folder)
    phrases = F.filter(F.zip_with("narr", "clip", lambda x, y: F.struct(
        x["t0"].alias("ns"), x["t1"].alias("ne"), y["t0"].alias("cs"), y["t1"].alias("ce"))),
        lambda p: p["ne"].isNotNull() & p["ce"].isNotNull())
    return rows.withColumn("m", A.time_map(phrases, C("target"), C("clip_len")))


@query("k11_time_map", """
  SELECT scene_key, bool_and(ok1 AND ok2) AS plausible, CASE WHEN bool_and(ok1 AND ok2) THEN
    round(greatest(0, arg_min(ns, seg_ix) - arg_min(cs, seg_ix)), 6) END AS pre_hold FROM tmap GROUP BY scene_key""", "tmap")
def time_map(spark, folder):
    return _time_maps(spark, folder).select("scene_key", C("m").isNotNull().alias("plausible"),
                                            F.round("m.pre_hold", 6).alias("pre_hold"))


@query("a14_extent", """
  SELECT scene_key, round(CASE WHEN arg_min(ns, seg_ix) > 0.0010001 THEN greatest(0, arg_min(cs, seg_ix) - arg_min(ns, seg_ix)) ELSE arg_min(cs, seg_ix) END, 6) AS c0,
    round(least(6.0 + scene_key % 5 * 0.5, max(ce) + 6.4 - max(ne)), 6) AS c1 FROM tmap GROUP BY scene_key HAVING bool_and(ok1 AND ok2)""", "tmap")
def extent(spark, folder):
    p = C("m.pieces")
    return _time_maps(spark, folder).where("m is not null").select(
        "scene_key", F.round(F.array_min(F.transform(p, lambda x: x["c0"])), 6).alias("c0"),
        F.round(F.array_max(F.transform(p, lambda x: x["c1"])), 6).alias("c1"))


@query("k12_simple_alignment", """
  SELECT DISTINCT scene_key, true AS tiled FROM (SELECT scene_key FROM clip INTERSECT SELECT scene_key FROM narr)""", "clip", "narr")
def simple_alignment(spark, folder):
    """A plan, where there is one, covers its output axis without gaps."""
    plan = A.plan_alignment(C("narr"), C("clip"), C("target"), C("clip_len"))
    p = C("plan.map.pieces")
    end = F.element_at(p, -1)["t1"] + C("plan.map.post_hold")
    # pieces of a millisecond or less are dropped, so an edge may be open by that much
    ok = F.coalesce((F.abs(end - C("target")) < 2e-3) & (F.abs(
        F.get(p, F.lit(0))["t0"] - C("plan.map.pre_hold")) < 2e-3), F.lit(True))
    return _two_sided(spark, folder).withColumn("plan", plan).select("scene_key", ok.alias("tiled"))


@query("k13_map_mismatch", """
  SELECT scene_key, round(coalesce(sum(CASE WHEN (a > 0) <> (b > 0) THEN nt - t END), 0), 2) AS seconds FROM (
    SELECT scene_key, t, sum(da) OVER w AS a, sum(db) OVER w AS b, lead(t) OVER w AS nt FROM (
      SELECT scene_key, t, sum(da) AS da, sum(db) AS db FROM (
        SELECT scene_key, unnest([s, e]) AS t, unnest([1, -1]) AS da, 0 AS db FROM lipmap WHERE e > s
        UNION ALL SELECT scene_key, unnest([t0, t1]), 0, unnest([1, -1]) FROM narr WHERE scene_key IN (SELECT scene_key FROM lipmap))
      GROUP BY ALL) WINDOW w AS (PARTITION BY scene_key ORDER BY t)) GROUP BY scene_key""", "lipmap", "narr")
def map_mismatch(spark, folder):
    rows = _time_maps(spark, folder).where("m is not null")
    return rows.select("scene_key", F.round(A.map_mismatch(
        C("m.pieces"), C("narr"), C("clip"), C("target")), 2).alias("seconds"))


block("okmap", "SELECT scene_key FROM tmap GROUP BY scene_key HAVING bool_and(ok1 AND ok2)", "tmap")
block("pcs", """
  SELECT scene_key, cs AS c0, ce AS c1, ns AS t0, ne AS t1 FROM tmap UNION ALL
  SELECT scene_key, ce, nc, ne, nn FROM tmap WHERE nc IS NOT NULL UNION ALL
  SELECT scene_key, greatest(0, arg_min(cs, seg_ix) - arg_min(ns, seg_ix)), arg_min(cs, seg_ix),
    greatest(0, arg_min(ns, seg_ix) - arg_min(cs, seg_ix)), arg_min(ns, seg_ix) FROM tmap GROUP BY scene_key HAVING arg_min(ns, seg_ix) > 0 UNION ALL
  SELECT scene_key, max(ce), least(6.0 + scene_key % 5 * 0.5, max(ce) + 6.4 - max(ne)), max(ne),
    max(ne) + least(6.0 + scene_key % 5 * 0.5, max(ce) + 6.4 - max(ne)) - max(ce) FROM tmap GROUP BY scene_key""", "tmap")
block("lipmap", """
  SELECT p.scene_key, p.t0 + (greatest(c.t0, c0) - c0) * (p.t1 - p.t0) / (c1 - c0) AS s,
    least(6.4, p.t0 + (least(c.t1, c1) - c0) * (p.t1 - p.t0) / (c1 - c0)) AS e
  FROM pcs p JOIN clip c USING (scene_key) JOIN okmap USING (scene_key) WHERE c1 - c0 > 1e-3 AND p.t1 - p.t0 > 1e-3""", "pcs", "clip", "okmap")


def _alignment_blocks(name: str, target: str) -> None:
    """`name`: the best time map of each scene that has one, for narrations of `target` seconds."""
    w = f"WINDOW w AS (PARTITION BY {_CAND} ORDER BY k)"
    block(name + "_held", f"""
      SELECT *, CASE WHEN tail > 0 THEN greatest(0, tail - (seen_end - ce1)) ELSE 0 END AS post FROM (
        SELECT {_CAND}, any_value(size) AS size, any_value(n) AS n, arg_min(cs, k) AS cs0, arg_min(ns, k) AS ns0, arg_max(ce, k) AS ce1, arg_max(ne, k) AS ne1,
          greatest(0, arg_min(ns, k) - arg_min(cs, k)) AS pre, {target} - arg_max(ne, k) AS tail,
          least(any_value(clip_len), arg_max(ce, k) + ({target} - arg_max(ne, k))) AS seen_end
        FROM (SELECT *, lead(cs) OVER w - ce AS cp, lead(ns) OVER w - ne AS np FROM phr {w}) GROUP BY {_CAND}
        HAVING bool_and(ne - ns >= 1e-3 AND ce - cs >= 1e-3 AND (ne - ns) / (ce - cs) BETWEEN 0.6::DOUBLE AND 1.6::DOUBLE
          AND coalesce(np >= 1e-3 AND cp >= 1e-3 AND np / cp BETWEEN 0.3::DOUBLE AND 3, true)))""", "phr")
    block(name + "_pieces", f"""
      SELECT {_CAND}, c0, c1, p.t0, p.t1, (p.t1 - p.t0) / (c1 - c0) AS f FROM (
        SELECT {_CAND}, cs AS c0, ce AS c1, ns AS t0, ne AS t1 FROM phr UNION ALL
        SELECT {_CAND}, ce, lead(cs) OVER w, ne, lead(ns) OVER w FROM phr {w} UNION ALL
        SELECT {_CAND}, greatest(0, cs0 - ns0), cs0, pre, ns0 FROM {name}_held WHERE ns0 > 0 UNION ALL
        SELECT {_CAND}, ce1, seen_end, ne1, ne1 + (seen_end - ce1) FROM {name}_held WHERE tail > 0) p
      WHERE c1 - c0 > 1e-3 AND p.t1 - p.t0 > 1e-3 AND ({_CAND}) IN (SELECT ({_CAND}) FROM {name}_held)""", "phr", name + "_held")
    block(name + "_miss", sql_apart(
        f"SELECT {_CAND}, p.t0 + (greatest(c.t0, c0) - c0) * f AS s, p.t0 + (least(c.t1, c1) - c0) * f AS e FROM clip c JOIN {name}_pieces p"
        " USING (scene_key) WHERE least(c.t1, c1) > greatest(c.t0, c0)",
        f"SELECT {_CAND}, t0 AS s, t1 AS e FROM narr JOIN {name}_held USING (scene_key)", _CAND, target),
          "clip", "narr", name + "_pieces", name + "_held")
    block(name, f"""
      SELECT scene_key, a.* FROM (SELECT scene_key, arg_min({{'n': n, 'pre': pre, 'post': post, 'mismatch': mismatch}},
          ({sql_exact('mismatch + 0.5::DOUBLE * (pre + post)')}, -size, ix, setting)) AS a
        FROM {name}_held JOIN {name}_miss USING ({_CAND}) GROUP BY scene_key)""", name + "_held", name + "_miss")


_alignment_blocks("bestmap", "6.4::DOUBLE")
_alignment_blocks("framemap", "(154 / 24)")


@query("k14_alignment_search", """
  SELECT scene_key, CASE WHEN n > 1 THEN 'phrases' ELSE 'span' END AS mode, n AS n_phrases, round(pre, 3) AS pre_hold, round(post, 3) AS post_hold, mismatch
  FROM bestmap""", "bestmap")
def alignment_search(spark, folder):
    return A.search_alignment(_speech(spark, folder), "scene_key").select(
        "scene_key", "mode", "n_phrases", F.round("pre_hold", 3).alias("pre_hold"),
        F.round("post_hold", 3).alias("post_hold"), "mismatch")


def _transcripts(spark, folder):
    """A scene's line and what was heard of it: every seventh word is missing, and one word
    is said twice where the line has more than ten."""
    rows = T.scenes(spark, folder)
    rows = settled(rows, text=C("text"), w=X.words_of(C("text")))
    heard = F.filter("w", lambda _, i: i % 7 != 3)
    twice = F.when(F.size("w") > 10, F.concat(F.slice(heard, F.lit(1), F.lit(1)), heard)).otherwise(heard)
    return rows.select("script_id", "scene_ix", "text", twice.alias("heard"))


@query("k15_align_words", f"""
  SELECT script_id, scene_ix, len(w) AS n_words, true AS in_order, true AS same_words FROM (
    SELECT script_id, scene_ix, {T.sql_words('text')} AS w FROM scn)""", "scn")
def align_words(spark, folder):
    a = A.align_words(_transcripts(spark, folder))
    inc = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("pairs") - 1)), lambda k: F.coalesce(
        (F.get("pairs", k)["i"] > F.get("pairs", k - 1)["i"]) & (F.get("pairs", k)["j"] > F.get("pairs", k - 1)["j"]), F.lit(True)))
    sides = F.struct(X.matching_words(C("script_words")).alias("said"), X.matching_words(C("heard")).alias("heard"))
    same = X.bound(sides, lambda s: F.forall("pairs", lambda p: F.get(s["said"], p["i"]) == F.get(s["heard"], p["j"])))
    return a.select("script_id", "scene_ix", F.size("script_words").alias("n_words"), inc.alias("in_order"), same.alias("same_words"))


@query("a13_coverage", f"""
  SELECT script_id, scene_ix, CAST(printf('%.3f', k / n) AS DOUBLE) AS coverage, greatest(0, last_j + 1 - k) AS extra, h - 1 - last_j AS trailing_extra FROM (
    SELECT script_id, scene_ix, greatest(1, len(w)) AS n, k, k - 1 AS last_j, k + 2 AS h FROM (
      SELECT script_id, scene_ix, w, len(w) AS k FROM (SELECT script_id, scene_ix, {T.sql_words('text')} AS w FROM scn)) WHERE k > 0)""", "scn")
def coverage(spark, folder):
    """Heard exactly, with two foreign words behind the line."""
    rows = T.scenes(spark, folder).select("script_id", "scene_ix", "text", F.concat(
        X.words_of(C("text")), F.array(F.lit("#1"), F.lit("@@"))).alias("heard"))
    a = A.align_words(rows)
    return a.where(F.size("script_words") > 0).select("script_id", "scene_ix", "coverage", "extra", "trailing_extra")


@query("f10_transcript_usable", """
  SELECT scene, c >= 0.85::DOUBLE AND x <= greatest(2, n // 8) AS usable FROM (
    SELECT scene, (audio_ms % 100) / 100 AS c, audio_ms % 9 AS x, audio_ms // 100 AS n FROM osc)""", "osc")
def transcript_usable(spark, folder):
    return T.order_scenes(spark, folder).select("scene", A.transcript_usable(
        C("audio_ms") % 100 / 100, C("audio_ms") % 9, F.floor(C("audio_ms") / 100)).alias("usable"))


def _chunk_inputs(spark, folder):
    """Lines whose words are a scene's narration events, heard in the clip's segments."""
    span = (C("seg_ix"), C("word"), C("t0"), C("t1"))
    rows = keep_parallel(T.tracks(spark, folder).where("scene_key is not null"), "scene_key").groupBy("scene_key").agg(
        F.array_sort(F.collect_list(F.when(C("track") == "narration", F.struct(*span)))).alias("words"),
        F.collect_list(F.when(C("track") == "clip", F.struct("seg_ix", "t0", "t1"))).alias("speech"))
    return rows.select(
        "scene_key", "words", "speech", F.transform("words", lambda x: x["word"]).alias("script_words"),
        F.transform("words", lambda _, k: F.struct(k.cast("int").alias("i"), k.cast("int").alias("j"))).alias("pairs"))


@query("k16_lip_chunks", """
  SELECT scene_key, string_agg(word, ' ' ORDER BY seg_ix) AS line FROM narr
  WHERE scene_key IN (SELECT scene_key FROM clip) GROUP BY scene_key""", "narr", "clip")
def lip_chunks(spark, folder):
    chunks = L.make_chunks(_chunk_inputs(spark, folder), "scene_key")
    return chunks.groupBy("scene_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("ix", "text"))), lambda c: c["text"]), " ").alias("line"))


@query("k17_balanced_chunks")
def balanced_chunks(spark, folder):
    rows = _chunk_inputs(spark, folder).withColumn("onsets", F.transform("speech", lambda s: s["t0"] + 0.04))
    return L.make_chunks(rows, "scene_key").select(
        "scene_key", "ix", "text", "seg_ix", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))


block("pace", """
  SELECT scene_key, seg_ix, nat, greatest(0.15, t1 - t0) AS d, exp(sum(ln(nat / greatest(0.15, t1 - t0)) * nat) OVER w / sum(nat) OVER w) AS pace
  FROM (SELECT *, 0.3::DOUBLE + m0 % 900 / 1000 AS nat FROM clip) WINDOW w AS (PARTITION BY scene_key)""", "clip")


def _natural(spark, folder):
    return T.track(T.tracks(spark, folder), "clip").withColumn("natural", F.lit(0.3) + C("m0") % 900 / 1000)


@query("k19_smooth_pace", """
  SELECT scene_key, seg_ix, round(nat / greatest(pace / 1.12, least(pace * 1.12, nat / d)), 6) AS fit FROM pace""", "pace")
def smooth_pace(spark, folder):
    return L.smooth_pace(_natural(spark, folder), "scene_key").select(
        "scene_key", "seg_ix", F.round("fit", 6).alias("fit"))


@query("a6_geometric_mean", "SELECT DISTINCT scene_key, round(pace, 6) AS pace FROM pace", "pace")
def geometric_mean(spark, folder):
    speed = C("natural") / F.greatest(F.lit(0.15), C("t1") - C("t0"))
    return _natural(spark, folder).groupBy("scene_key").agg(F.round(F.exp(
        F.sum(F.log(speed) * C("natural")) / F.sum("natural")), 6).alias("pace"))


@query("k20_final_window", """
  SELECT * FROM (WITH RECURSIVE r AS (SELECT scene_key, seg_ix, o AS place, o + v AS fin FROM wch WHERE seg_ix = 0 UNION ALL
    SELECT c.scene_key, c.seg_ix, greatest(c.o, r.fin + 0.04), greatest(c.o, r.fin + 0.04) + c.v FROM r JOIN wch c
      ON c.scene_key = r.scene_key AND c.seg_ix = r.seg_ix + 1)
  SELECT scene_key, round(any_value(w0), 6) AS w0, round(ceil(round((greatest(max(fin), arg_max(oe, seg_ix)) + 0.3) * 24, 6)) / 24, 6) AS dur
  FROM r JOIN wch USING (scene_key, seg_ix) GROUP BY scene_key)""", "wch")
def final_window(spark, folder):
    rows = T.track(T.tracks(spark, folder), "clip")
    chunks = rows.select("scene_key", C("seg_ix").alias("ix"), "t0", "t1", (F.lit(0.5) + C("m1") % 500 / 1000).alias("voiced"))
    cuts = rows.select("scene_key", (C("t1") + 0.01).alias("t0"), (C("t1") + 0.11).alias("t1"))
    clips = rows.select("scene_key").distinct().withColumn("clip_len", T.clip_seconds(C("scene_key")))
    scenes, _ = L.plan_window(chunks, cuts, clips, "scene_key")
    return scenes.select("scene_key", F.round("w0", 6).alias("w0"), F.round("dur", 6).alias("dur"))


block("wch", """
  SELECT c.scene_key, c.seg_ix, w0, v, c.t0 - w0 - coalesce(sum(CASE WHEN k.a < c.t0 AND k.a0 >= w0 THEN least(k.b, c.t0) - k.a END), 0) AS o,
    c.t1 - w0 - coalesce(sum(CASE WHEN k.a < c.t1 AND k.a0 >= w0 THEN least(k.b, c.t1) - k.a END), 0) AS oe
  FROM (SELECT *, greatest(0, first_value(t0) OVER (PARTITION BY scene_key ORDER BY seg_ix) - 0.25) AS w0, 0.5::DOUBLE + m1 % 500 / 1000 AS v FROM clip) c
  JOIN (SELECT scene_key, t1 + 0.01 AS a0, round_even((t1 + 0.01::DOUBLE) * 24, 0) / 24 AS a, round_even((t1 + 0.11::DOUBLE) * 24, 0) / 24 AS b FROM clip) k USING (scene_key)
  GROUP BY c.scene_key, c.seg_ix, w0, v, c.t0, c.t1""", "clip")


@query("k21_takes", """
  SELECT l_orderkey, try_no, rate, round(greatest(0.92::DOUBLE, least(1.2::DOUBLE, m / t)), 6) AS tempo, nxt FROM (
    SELECT l_orderkey, (q).n AS try_no, (q).r AS rate, (q).m AS m, (q).t AS t,
      CASE WHEN abs((q).m - (q).t) > 0.04::DOUBLE * (q).t AND abs(nr - (q).r) >= 0.01::DOUBLE THEN nr END AS nxt FROM (
      SELECT *, CAST(printf('%.2f', greatest(0.7::DOUBLE, least(1.5::DOUBLE, (q).r * (q).m / greatest((q).t, 0.1)))) AS DOUBLE) AS nr FROM (
        SELECT l_orderkey, arg_min({'n': l_linenumber, 'r': r, 'm': m, 't': t}, (abs(m - t), l_linenumber, r, m)) AS q
        FROM (SELECT *, 1.0::DOUBLE + l_discount AS r, 1.0::DOUBLE + l_quantity / 16 AS m, 2.0::DOUBLE + l_orderkey % 8 / 4 AS t FROM lineitem) GROUP BY l_orderkey)))""")
def takes(spark, folder):
    rows = T.table(spark, folder, "lineitem").select(
        "l_orderkey", C("l_linenumber").alias("try_no"), (F.lit(1.0) + C("l_discount")).alias("rate"),
        (F.lit(1.0) + C("l_quantity") / 16).alias("measured"), (F.lit(2.0) + C("l_orderkey") % 8 / 4).alias("target"))
    best = L.settle_takes(rows, ["l_orderkey"])
    target = F.lit(2.0) + C("l_orderkey") % 8 / 4
    return best.select("l_orderkey", "try_no", "rate", F.round("tempo", 6).alias("tempo"),
                       L.next_rate(C("rate"), C("measured"), target).alias("nxt"))


@query("t4_closest_take", """
  SELECT l_orderkey, arg_min(l_linenumber, (abs(l_quantity - 20), l_linenumber)) AS try_no FROM lineitem GROUP BY l_orderkey""")
def closest_take(spark, folder):
    return T.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min_by(
        "l_linenumber", F.struct(F.abs(C("l_quantity") - 20), "l_linenumber")).alias("try_no"))


@query("k24_mode_choice", """
  SELECT scene, CASE WHEN n > 1 THEN base WHEN mode = 'lip_voice' AND lv THEN 'lip_voice'
    WHEN mode = 'audio_master' THEN CASE WHEN al THEN 'lip_align' WHEN ft THEN 'video_master' ELSE base END
    WHEN ft THEN 'video_master' WHEN al THEN 'lip_align' ELSE base END AS action FROM (
    SELECT scene, scene % 3 + 0 AS mk, (['video_master', 'audio_master', 'lip_voice'])[scene % 3 + 1] AS mode, audio_ms % 2 = 0 AS lv,
      audio_ms % 3 = 0 AS ft, audio_ms % 5 = 0 AS al, 1 + (audio_ms % 7 = 0)::INT AS n, 'trim' AS base FROM osc)""", "osc")
def mode_choice(spark, folder):
    from cuegrid.plans.render import choose_action

    mode = F.get(F.array(*[F.lit(m) for m in ("video_master", "audio_master", "lip_voice")]), (C("scene") % 3).cast("int"))
    a = C("audio_ms")
    return T.order_scenes(spark, folder).select("scene", choose_action(
        mode, 1 + (a % 7 == 0).cast("int"), F.when(a % 2 == 0, F.lit(1)), F.when(a % 3 == 0, F.lit(1)),
        F.when(a % 5 == 0, F.lit(1)), F.lit("trim")).alias("action"))


@query("f9_range_predicates", """
  SELECT scene, r BETWEEN 0.9::DOUBLE - 1e-9 AND 1.15::DOUBLE + 1e-9 AS in_range, r BETWEEN 0.6::DOUBLE AND 1.6::DOUBLE AS speech_ok
  FROM (SELECT scene, audio_ms / 5000 AS r FROM osc)""", "osc")
def range_predicates(spark, folder):
    r = C("audio_ms") / 5000
    return T.order_scenes(spark, folder).select("scene", S.in_range(r).alias("in_range"),
                                                r.between(*P.SPEECH_RANGE).alias("speech_ok"))


_RENDER = """
  SELECT scene_key, CASE WHEN several THEN 'trim' WHEN {mapped} THEN 'lip_align' ELSE 'video_master' END AS action,
    round(CASE WHEN several OR {mapped} THEN 154 / 24 ELSE dur END, 4) AS target_duration,
    CASE WHEN several THEN 0.0 WHEN {mapped} THEN {hold} ELSE freeze_pad END AS freeze_pad,
    CASE WHEN several THEN NULL WHEN {mapped} THEN {miss} ELSE f.mismatch END AS mismatch,
    CASE WHEN several THEN round(1 / 1.15::DOUBLE, 4) END AS retime_factor
  FROM (SELECT *, scene_key % 6 = 5 AS several FROM bestfit) f {join}"""


def _render(spark, folder, rule):
    from cuegrid.plans.render import render_plans as plan

    clips = F.when(C("scene_key") % 6 == 5, F.array(F.lit(4.0), F.lit(4.0))).otherwise(F.array(C("clip_len")))
    rows = _two_sided(spark, folder).drop("target").withColumn("audio_s", C("narr_len")).withColumn("clip_durations", clips)
    return plan(rows, "scene_key", rule)


@query("k24_render_plans", _RENDER.format(mapped="false", hold="0.0", miss="0.0", join=""), "bestfit")
def render_plans(spark, folder):
    return _render(spark, folder, P.Sync())


@query("k24_audio_master", _RENDER.format(mapped="(m.n IS NOT NULL)", hold=sql_exact("m.pre + m.post"), miss="m.mismatch",
                                          join="LEFT JOIN framemap m USING (scene_key)"), "bestfit", "framemap")
def audio_master_plans(spark, folder):
    return _render(spark, folder, P.Sync(mode="audio_master"))
