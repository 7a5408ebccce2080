"""The library's entities derived from the corpus tables, each with the same thing in SQL.

The corpus holds no scripts, clips or words as such, so deterministic rules derive them:
documents are scripts, a user's events in blocks of twelve are one scene's two speech tracks,
orders are scenes of a customer's project, embeddings are signals, parts are media files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuegrid.catalog.base import block
from cuegrid.functions import text as X
from cuegrid.operators.rows import keep_parallel, settled, unfold
from cuegrid.operators.scan import scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Even out an input of a single split, which holds spark.sql.files.maxPartitionBytes at most;
    larger ones are never shuffled."""
    return rows if rows.rdd.getNumPartitions() > 1 else rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


# ---------------------------------------------------------------------------- text --------
def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """script_id, text"""
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("script_id"),
                                                           "text"))


def sentence_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """script_id, sents ARRAY<STRING>: sentences of all paragraphs, one row per script"""
    sents = F.flatten(F.transform(X.split_paragraphs(F.col("text")), X.split_sentences))
    return settled(scripts(spark, folder), sents=sents).drop("text")


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """script_id, sent_ix (0-based), text"""
    return unfold(sentence_arrays(spark, folder), "sents", "sent_ix", "text", "script_id")


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    """script_id, n_scenes, scene_ix (0-based), units, text: two sentences a scene"""
    rows = sentence_arrays(spark, folder).withColumn(
        "n_scenes", F.ceil(F.size("sents") / 2).cast("int"))
    starts = F.when(F.col("n_scenes") > 0, F.sequence(F.lit(0), F.col("n_scenes") - 1))
    groups = F.transform(starts, lambda i: F.slice("sents", i * 2 + 1, F.lit(2)))
    return unfold(rows, groups, "scene_ix", "units", "script_id", "n_scenes").withColumn(
        "text", F.array_join("units", " "))


SPACES = X.SPACE_CHARACTERS
_WS = " || ".join(f"chr({ord(c)})" for c in SPACES)
RE_SPACE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
            r"\x{205f}\x{3000}]")
_ABBR = "|".join(a.replace(".", r"\.") for a in X.ABBREVIATIONS)


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {_WS})"


def sql_words(expression: str) -> str:
    return f"list_filter(string_split_regex({expression}, '{RE_SPACE}+'), lambda w: w <> '')"


def sql_estimate(expression: str, wps: str = "2.5") -> str:
    return (f"(CASE WHEN len(regexp_extract_all({expression}, '[A-Za-z0-9À-ɏ'']+')) = 0 THEN 0.0 "
            f"ELSE round(CAST(len(regexp_extract_all({expression}, '[A-Za-z0-9À-ɏ'']+')) / {wps} "
            f"+ (30 * len(regexp_extract_all({expression}, '[.!?]+')) "
            f"+ 12 * len(regexp_extract_all({expression}, '[,;:—]'))) / 100.0 AS DOUBLE), 2) END)"
            "::DOUBLE")


block("norm", f"""
  SELECT doc_id, {sql_strip(f'''array_to_string(list_transform(string_split(regexp_replace(
    replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(65279), ''), '[ \\t]+', ' ', 'g'),
    chr(10)), lambda x: {sql_strip("x")}), chr(10))''')} AS t FROM documents""")
block("blk", """
  SELECT doc_id, i AS blk, list_filter(string_split(bs[i], chr(10)), lambda x: x <> '') AS lines
  FROM (SELECT doc_id, string_split_regex(t, '\\n\\n+') AS bs FROM norm),
       unnest(range(1, len(bs) + 1)) r(i)""", "norm")
block("pblk", """
  SELECT doc_id, blk, CASE WHEN coalesce(f, 0) = 0 THEN lines
    ELSE list_append(lines[1:f - 1], array_to_string(lines[f:], ' ')) END AS ps
  FROM (SELECT *, list_position(list_transform(lines, lambda x, k: NOT (length(x) < 80
      AND NOT regexp_matches(x, '[.!?:;,"''”]$')
      AND (coalesce(lines[k + 1], '') = '' OR regexp_matches(lines[k + 1], '^[\\p{Lu}\\p{Nd}]')))),
      true) AS f FROM blk)""", "blk")
block("pars", """
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY blk, j) - 1 AS paragraph,
    ps[j] AS p FROM pblk, unnest(range(1, len(ps) + 1)) r(j) WHERE ps[j] <> ''""", "pblk")
def sql_split(expression: str) -> str:
    return f"""list_filter(list_transform(string_split(regexp_replace(
    regexp_replace({expression}, '([.!?…]+["''”’)\\]]*)({RE_SPACE}+)', '\\1' || chr(30) || '\\2', 'g'),
    '(^|{RE_SPACE})(["''(“‘]*(?:(?i:{_ABBR})|\\p{{Lu}}|(?:[a-zA-Z]\\.)+[a-zA-Z])\\.)\\x1e',
    '\\1\\2', 'g'), chr(30)), lambda s: {sql_strip("s")}), lambda s: s <> '')"""


block("pieces", f"SELECT doc_id, paragraph, {sql_split('p')} AS ss FROM pars", "pars")
block("sents", """
  SELECT doc_id AS script_id, paragraph, ss[j] AS text,
    row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, j) - 1 AS sent_ix
  FROM pieces, unnest(range(1, len(ss) + 1)) r(j)""", "pieces")
block("scn", """
  SELECT script_id, sent_ix // 2 AS scene_ix, string_agg(text, ' ' ORDER BY sent_ix) AS text,
    list(text ORDER BY sent_ix) AS units,
    (max(max(sent_ix)) OVER (PARTITION BY script_id)) // 2 + 1 AS n_scenes
  FROM sents GROUP BY script_id, sent_ix // 2""", "sents")


# ---------------------------------------------------------------------- speech tracks -----
SCENE_EVENTS = 12
#: Scenes a user or a script can have: more than any table holds, so keys of two never meet.
SCENES = 1 << 32


def numbered_events(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, user_id, ts, event_type, value, cents, rn: position in the user's history"""
    rows = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", "event_type", "value",
        F.rint(F.col("value") * 100).cast("bigint").alias("cents"))
    minute = F.unix_date(F.to_date("ts")) * 1440 + F.hour("ts") * 60 + F.minute("ts")
    out = scan(rows, ["user_id"], ["ts", "event_id"], minute, number="rn")
    return out.withColumn("rn", F.col("rn") - 1)


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """scene_key, track, seg_ix, m0, m1 (milliseconds), t0, t1 (seconds), word

    Twelve events of a user are one scene: its even ones the clip's speech segments, its odd
    ones the narration's, six on each side by construction."""
    k = F.col("rn") % SCENE_EVENTS
    pos = F.floor(k / 2)
    m0 = pos * 1000 + (F.col("event_id") * 37) % 200
    return (numbered_events(spark, folder).select(
        (F.col("user_id") * SCENES + F.floor(F.col("rn") / SCENE_EVENTS)).alias("scene_key"),
        F.when(k % 2 == 0, "clip").otherwise("narration").alias("track"),
        pos.cast("int").alias("seg_ix"), m0.alias("m0"),
        (m0 + 300 + F.col("cents") % 450).alias("m1"), F.col("event_type").alias("word"))
        .withColumn("t0", F.col("m0") / 1000).withColumn("t1", F.col("m1") / 1000))


def clip_seconds(key: Column) -> Column:
    return F.lit(6.0) + (key % 5) * F.lit(0.5)


def track(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("track") == name).drop("track")


block("evn", """
  SELECT *, CAST(round(value * 100) AS BIGINT) AS cents,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events""")
block("trk", """
  SELECT user_id * 4294967296 + rn // 12 AS scene_key,
    CASE WHEN rn % 12 % 2 = 0 THEN 'clip' ELSE 'narration' END AS track,
    (rn % 12) // 2 AS seg_ix, m0, m1, m0 / 1000 AS t0, m1 / 1000 AS t1, event_type AS word
  FROM (SELECT *, m0 + 300 + cents % 450 AS m1 FROM (
    SELECT *, ((rn % 12) // 2) * 1000 + (event_id * 37) % 200 AS m0 FROM evn))""", "evn")
block("clip", "SELECT * FROM trk WHERE track = 'clip'", "trk")
block("narr", "SELECT * FROM trk WHERE track = 'narration'", "trk")


def speech_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """scene_key, clip, narr: ARRAY<STRUCT<t0,t1>> sorted, at most six entries a side"""
    pair = F.struct("t0", "t1")
    return keep_parallel(tracks(spark, folder), "scene_key").groupBy("scene_key").agg(
        F.array_sort(F.collect_list(F.when(F.col("track") == "clip", pair))).alias("clip"),
        F.array_sort(F.collect_list(F.when(F.col("track") == "narration", pair))).alias("narr"))


# ---------------------------------------------------------------------- scene states ------
def order_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """project, scene, status, audio_ms, rendered_ms, text_key: orders as scenes"""
    cents = F.rint(F.col("o_totalprice") * 100).cast("bigint")
    status = F.get(F.array(F.lit("complete"), F.lit("failed"), F.lit("pending")),
                   F.when(F.col("o_orderstatus") == "O", 0)
                   .when(F.col("o_orderstatus") == "F", 1).otherwise(2))
    audio = cents % 9000 + 500
    return spread(table(spark, folder, "orders")).select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("scene"),
        status.alias("status"), audio.alias("audio_ms"),
        F.when(status == "complete", audio + 200 + cents % 7 * 40).alias("rendered_ms"),
        F.col("o_orderpriority").alias("priority"))


block("osc", """
  SELECT o_custkey AS project, o_orderkey AS scene, status, audio_ms, priority,
    CASE WHEN status = 'complete' THEN audio_ms + 200 + cents % 7 * 40 END AS rendered_ms
  FROM (SELECT *, cents % 9000 + 500 AS audio_ms, CASE o_orderstatus WHEN 'O' THEN 'complete'
      WHEN 'F' THEN 'failed' ELSE 'pending' END AS status, o_orderpriority AS priority
    FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders))""")


# ---------------------------------------------------------------------- media and signals -
def media(spark: SparkSession, folder: str) -> DataFrame:
    """part_key, duration, has_video, has_audio, width, height, fps, sample_rate, ..."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, folder, "part").select(
        k.alias("part_key"), F.col("p_name").alias("name"),
        (F.rint(F.col("p_retailprice") * 10).cast("bigint") % 12000 / 1000).alias("duration"),
        (k % 11 != 0).alias("has_video"), (k % 13 != 0).alias("has_audio"),
        F.when(size % 5 == 0, 640).otherwise(1280).alias("width"),
        F.when(size % 7 == 0, 480).otherwise(720).alias("height"),
        F.when(size % 9 == 0, None).when(size % 4 == 0, F.lit(25.0)).otherwise(F.lit(24.0))
        .alias("fps"),
        F.when(size % 6 == 0, 44100).otherwise(48000).alias("sample_rate"))


block("med", """
  SELECT p_partkey AS part_key, p_name AS name,
    CAST(round(p_retailprice * 10) AS BIGINT) % 12000 / 1000 AS duration,
    p_partkey % 11 <> 0 AS has_video, p_partkey % 13 <> 0 AS has_audio,
    CASE WHEN p_size % 5 = 0 THEN 640 ELSE 1280 END AS width,
    CASE WHEN p_size % 7 = 0 THEN 480 ELSE 720 END AS height,
    CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 25.0 ELSE 24.0 END::DOUBLE AS fps,
    CASE WHEN p_size % 6 = 0 THEN 44100 ELSE 48000 END AS sample_rate
  FROM part""")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, stem, ext, length, mtime_ns: a listing of clip files of scenes"""
    k = F.col("p_partkey")
    scene = F.concat(F.lit("scene_"), F.lpad((F.floor(k / 4) % 900 + 1).cast("string"), 3, "0"))
    suffix = F.get(F.array(*[F.lit(x) for x in ("", "_b", "_c", "_d")]), (k % 4).cast("int"))
    ext = F.get(F.array(*[F.lit(x) for x in (".mp4", ".mov", ".webm", ".txt")]),
                (F.col("p_size") % 4).cast("int"))
    project = F.concat(F.lit("lesson"), F.floor(k / 3600).cast("string"))
    return table(spark, folder, "part").select(
        project.alias("project"), scene.alias("scene_id"),
        F.concat(scene, suffix).alias("stem"), ext.alias("ext"),
        F.concat(scene, suffix, ext).alias("name"),
        F.when(F.col("p_size") % 10 == 0, F.lit(0)).otherwise(F.col("p_size") * 1000)
        .cast("bigint").alias("length"),
        (F.lit(1_700_000_000_000_000_000) + k).alias("mtime_ns")).withColumn(
        "path", F.concat_ws("/", F.lit("projects"), "project", F.lit("video"), "name"))


block("fil", """
  SELECT *, 'projects/' || project || '/video/' || name AS path FROM (
  SELECT *, scene_id || suffix AS stem, scene_id || suffix || ext AS name FROM (
  SELECT p_partkey, 'lesson' || (p_partkey // 3600) AS project,
    'scene_' || lpad(((p_partkey // 4) % 900 + 1)::VARCHAR, 3, '0') AS scene_id,
    (['', '_b', '_c', '_d'])[p_partkey % 4 + 1] AS suffix,
    (['.mp4', '.mov', '.webm', '.txt'])[p_size % 4 + 1] AS ext,
    (CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size * 1000 END)::BIGINT AS length,
    1700000000000000000 + p_partkey AS mtime_ns FROM part))""")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, frame (0-based), mouth, ref: two signals per frame"""
    vec = F.col("embedding")
    both = F.transform(vec, lambda v, i: F.struct(
        F.abs(v.cast("double") * 100).alias("mouth"),
        F.abs(F.coalesce(F.get(vec, i + 1), v).cast("double") * 20).alias("ref")))
    rows = spread(table(spark, folder, "embeddings")).select(F.col("vec_id").alias("clip_id"), both.alias("both"))
    return unfold(rows, "both", "frame", "s", "clip_id").select("clip_id", "frame", "s.mouth", "s.ref")


block("frm", """
  SELECT vec_id AS clip_id, i - 1 AS frame, abs(embedding[i]::DOUBLE * 100) AS mouth,
    abs(coalesce(embedding[i + 1], embedding[i])::DOUBLE * 20) AS ref
  FROM embeddings, unnest(range(1, len(embedding) + 1)) r(i)""")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """scene, channel (r, g, b), value 0-255"""
    return table(spark, folder, "embeddings").select(
        F.col("label").alias("scene"), F.posexplode("embedding").alias("i", "v")).select(
        "scene", F.get(F.array(F.lit("r"), F.lit("g"), F.lit("b")), F.col("i") % 3)
        .alias("channel"), (F.lit(128.0) + F.rint(F.col("v").cast("double") * 200)).alias("value"))


block("pix", """
  SELECT label AS scene, (['r', 'g', 'b'])[(i - 1) % 3 + 1] AS channel,
    128.0::DOUBLE + round_even(embedding[i]::DOUBLE * 200, 0) AS value
  FROM embeddings, unnest(range(1, len(embedding) + 1)) r(i)""")
