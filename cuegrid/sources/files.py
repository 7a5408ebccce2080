"""File listings and files as tables."""

from __future__ import annotations

import re
from functools import reduce
from unicodedata import category
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuegrid import params as P
from cuegrid.functions.rounding import round_exact
from cuegrid.session import stored
from cuegrid.sources.texts import entries_of, texts_of

#: Names that Spark's reader takes for compressed.
COMPRESSED = r"(?i)\.(bz2|deflate|gz|lz4|snappy|zst)$"


def read_scripts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row per script file: script_id (name of the project folder, or what the first group of
    `pattern` finds in the file's path), path, text.

    The tasks list and read a folder of the machines' own file system; the driver sees no file. Other
    stores, patterns of paths and trees with compressed files go through Spark's reader, whose list of files is the driver's."""
    root = _plain_folder(spark, path)
    files = None if root is None else files_below(spark, root)
    if files is None or not files.where(F.col("path").rlike(COMPRESSED)).isEmpty():
        rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
            F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    else:
        rows = texts_of(files, root, file_uri)
    where = F.col("file")
    name = project_of(where) if pattern is None else F.regexp_extract(where, pattern, 1)
    return rows.select(name.alias("script_id"), where.alias("path"), "text")


def _plain_folder(spark: SparkSession, path: str) -> str | None:
    """The place of `path` in the file system of the machines, if it is one folder there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    full = store.makeQualified(place)
    if full.toUri().getScheme() != "file" or re.search(r"[{}\[\]*?\\]", path) or not store.exists(full) or not store.getFileStatus(full).isDirectory():
        return None
    return full.toUri().getPath()


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files anywhere below a folder, seen from it: a job and a stored list for each level of the
    tree, its folders dealt over the tasks."""
    folders, files = spark.createDataFrame([("",)], "path string"), []
    while not folders.isEmpty():
        found = stored(entries_of(folders, root))
        files.append(found.where(~F.col("folder")).select("path"))
        folders = found.where("folder").select("path")
    return reduce(DataFrame.unionByName, files)


def file_uri(path: str) -> str:
    """A local path as Spark names it: per cent for what Java allows in no path."""
    return "file:" + re.sub(r"[^\w\-.!~*'():@&=+$,;/]", lambda c: c[0] if c[0] > "\x7f" and category(c[0])[0] != "Z" and category(c[0]) != "Cc" else quote(c[0]), path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of files below `path`; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime"))


def project_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/input/script\.txt$", 1)


def discover_projects(listing: DataFrame) -> DataFrame:
    """(project) with a script, not hidden by an underscore, in name order."""
    rows = listing.select(project_of(F.col("path")).alias("project")).where(
        (F.col("project") != "") & ~F.col("project").startswith("_")).distinct()
    return rows.orderBy("project")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def media_catalogue(listing: DataFrame, extensions=P.VIDEO_EXTENSIONS) -> DataFrame:
    """Usable clips of a listing(path, length): known extension, not hidden, not empty."""
    name = file_name(F.col("path"))
    ext = F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    return listing.withColumn("name", name).where(
        ext.isin(*extensions) & ~F.col("name").rlike("^[_.]") & (F.col("length") > 0))


def max_segment(durations: Column) -> Column:
    """Longest window every clip of a library can deliver (aggregate expression)."""
    return F.greatest(F.lit(1.0), F.min(durations) - 0.05)


def first_by_extension(files: DataFrame, keys: list[str], extensions=P.VIDEO_EXTENSIONS) -> DataFrame:
    """Per stem the file with the first extension of the ordered list."""
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.col("ext"))
    return files.where(F.col("ext").isin(*extensions)).groupBy(*keys).agg(
        F.min_by("path", F.struct(rank, "path")).alias("path"))


def concat_manifest(clips: DataFrame, key: str, order: str, path: str = "path") -> DataFrame:
    """(key, line_no, line): the concatenation list of each project, quotes escaped. Lines
    stay rows, ordered by line_no, until a sink writes them."""
    quoted = F.concat(F.lit("file '"), F.replace(F.col(path), F.lit("'"), F.lit("'\\''")), F.lit("'"))
    head = clips.select(key).distinct().select(key, F.lit(-1).cast("bigint").alias("line_no"),
                                               F.lit("ffconcat version 1.0").alias("line"))
    return head.unionByName(clips.select(key, F.col(order).cast("bigint").alias("line_no"), quoted.alias("line")))


def work_orders(scenes: DataFrame, suffix: Column) -> DataFrame:
    """One line per clip to be made by hand: scenes(scene_id, clip_durations, audio_s)."""
    rows = scenes.select(*scenes.columns, F.posexplode("clip_durations").alias("segment", "seconds"))
    stem = F.concat("scene_id", suffix)
    seconds = F.regexp_replace(F.col("seconds").cast("string"), r"\.0$", "")
    narr = F.format_string("%.2f", round_exact(F.col("audio_s"), 2))
    return rows.withColumn("line", F.concat(
        F.lit("- [ ] `video/"), stem, F.lit(".mp4` - "), seconds, F.lit("s - narration "), narr,
        F.lit("s - prompt: `video/prompts/"), stem, F.lit(".txt`")))
