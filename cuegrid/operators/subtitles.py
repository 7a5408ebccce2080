"""Subtitle cues on a running time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid.functions.scalars import subtitle_time
from cuegrid.functions.text import cue_lines
from cuegrid.operators.rows import unfold
from cuegrid.operators.scan import scan
from cuegrid.session import cut_lineage
from cuegrid.operators.sequences import ordinal_chunk


def build_cues(scenes: DataFrame, key: str = "script_id", order: str = "scene_ix",
               chunk: Column | None = None) -> DataFrame:
    """scenes(key, order, text, speech, rendered) -> (key, cue_ix, start, stop, line).

    A scene begins after the rendered length of the scenes before it and shares its speech
    among its cues by their characters. Cue numbers and scene starts are running sums over
    scenes; the cues themselves stay inside their scene's row."""
    rows = scenes.withColumn("_lines", cue_lines(F.col("text"))).withColumn(
        "_n", F.size("_lines")).drop("text")
    rows = cut_lineage(rows)  # the scan reads its input twice; lines are costly to make
    place = ordinal_chunk(order) if chunk is None else chunk
    timed = scan(rows, [key], [order], place, sums_before={
        "_t": F.col("rendered"), "_k": F.col("_n")})

    def chars(lines: Column) -> Column:
        return F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))

    timed = timed.withColumn("_total", F.greatest(F.lit(1), chars(F.col("_lines"))))
    cue = F.transform("_lines", lambda line, i: F.struct(
        line.alias("line"), chars(F.slice("_lines", F.lit(1), i)).alias("before")))
    out = unfold(timed, cue, "i", "c", key, order, "_t", "_k", "_total", "speech")
    start = F.col("_t") + F.col("speech") * F.col("c.before") / F.col("_total")
    stop = F.col("_t") + F.col("speech") * (F.col("c.before") + F.length("c.line")) / F.col("_total")
    return out.select(key, order, (F.col("_k") + F.col("i") + 1).alias("cue_ix"),
                      start.alias("start"), stop.alias("stop"), F.col("c.line").alias("line"))


def cue_blocks(cues: DataFrame, key: str = "script_id") -> DataFrame:
    """(key, cue_ix, block): numbered subtitle blocks."""
    return cues.select(key, "cue_ix", F.concat(
        F.col("cue_ix").cast("string"), F.lit("\n"), subtitle_time(F.col("start")), F.lit(" --> "),
        subtitle_time(F.col("stop")), F.lit("\n"), F.col("line"), F.lit("\n")).alias("block"))
