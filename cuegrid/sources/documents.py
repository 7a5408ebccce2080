"""JSON documents as tables: state documents, probe output, transcripts, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cuegrid.functions.scalars import parse_ratio

SCENE = ("struct<id:string,text:string,status:string,error:string,estimated_duration:double,"
         "actual_audio_duration:double,clip_durations:array<double>,video_files:array<string>,"
         "rendered_file:string,rendered_duration:double,visual_action:string,gesture:string>")
STATE_SCHEMA = ("project string, presenter string, script_sha256 string, created string, "
                f"timings map<string,double>, scenes array<{SCENE}>")
PROBE_SCHEMA = ("streams array<struct<codec_type:string,codec_name:string,width:int,height:int,"
                "avg_frame_rate:string,r_frame_rate:string,sample_rate:string,duration:string,"
                "disposition:struct<attached_pic:int>>>, format struct<duration:string>")
WORDS_SCHEMA = "clip string, key string, words array<struct<text:string,start:double,end:double>>"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file; the schema is given, so nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", "true").option(
        "recursiveFileLookup", "true").json(path)


def with_default(wanted: DataFrame, documents: DataFrame, key: str, column: str,
                 default: Column) -> DataFrame:
    """Every wanted key with its document, or the default where there is none."""
    return wanted.join(documents.select(key, column), key, "left").withColumn(
        column, F.coalesce(F.col(column), default))


def state_scenes(states: DataFrame) -> DataFrame:
    """Scene rows of nested state documents, in document order (scene_ix from 0)."""
    return states.select("project", "presenter", F.posexplode("scenes").alias("scene_ix", "s")).select(
        "project", "presenter", "scene_ix", "s.*")


def parse_probe(rows: DataFrame, key: str, column: str = "probe") -> DataFrame:
    """Media metadata from probe JSON: the first video stream that is not a cover picture, the
    first audio stream, and the container's duration, else the video's, else the audio's."""
    doc = rows.withColumn("_d", F.from_json(F.col(column), PROBE_SCHEMA))

    def cover(s: Column) -> Column:
        return F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 0

    doc = doc.withColumn("_v", F.get(F.filter(F.col("_d.streams"), lambda s: (
        s["codec_type"] == "video") & ~cover(s)), F.lit(0))).withColumn(
        "_a", F.get(F.filter(F.col("_d.streams"), lambda s: s["codec_type"] == "audio"), F.lit(0)))
    v, a = F.col("_v"), F.col("_a")
    zero = F.lit(0.0)

    def first(*values: Column) -> Column:
        return F.coalesce(*[F.nullif(x, zero) for x in values])

    return doc.select(
        key, F.coalesce(first(parse_ratio(F.col("_d.format.duration")), parse_ratio(v["duration"]),
                              parse_ratio(a["duration"])), zero).alias("duration"),
        v.isNotNull().alias("has_video"), a.isNotNull().alias("has_audio"),
        v["width"].alias("width"), v["height"].alias("height"),
        F.coalesce(F.nullif(parse_ratio(v["avg_frame_rate"]), zero), parse_ratio(v["r_frame_rate"])).alias("fps"),
        v["codec_name"].alias("vcodec"), a["codec_name"].alias("acodec"),
        F.nullif(a["sample_rate"], F.lit("")).try_cast(T.IntegerType()).alias("sample_rate"),
        parse_ratio(v["duration"]).alias("video_duration"),
        parse_ratio(a["duration"]).alias("audio_duration"))


def transcript_key(size: Column, mtime_ns: Column, model: str) -> Column:
    return F.concat_ws("-", size.cast("string"), mtime_ns.cast("string"), F.lit(model))


def usable_transcripts(files: DataFrame, transcripts: DataFrame, model: str) -> DataFrame:
    """Word rows (clip, word_ix, text, t0, t1) of transcripts made from the file as it is now
    with this model. files(clip, length, mtime_ns)."""
    now = files.select("clip", transcript_key(F.col("length"), F.col("mtime_ns"), model).alias("key"))
    return transcripts.join(now, ["clip", "key"]).select(
        "clip", F.posexplode("words").alias("word_ix", "w")).select(
        "clip", "word_ix", "w.text", F.col("w.start").alias("t0"), F.col("w.end").alias("t1"))


def merge_state(old: Column, new: Column) -> Column:
    """MAP `old` with the entries of `new` on top."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """One row: the prompt template (a single small text by definition)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("template"))
