"""Log texts as tables: silence logs and run events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def silences_from_log(logs: DataFrame, key: str = "clip_id") -> DataFrame:
    """logs(key, log, duration) -> (key, ix, s, e): silences in order; the last start without
    an end runs to the clip's duration."""
    starts = F.regexp_extract_all("log", F.lit(r"silence_start: (-?[\d.]+)"), 1)
    ends = F.regexp_extract_all("log", F.lit(r"silence_end: ([\d.]+)"), 1)
    spans = F.transform(starts, lambda s, i: F.struct(
        s.cast("double").alias("s"),
        F.coalesce(F.get(F.col("_ends"), i).cast("double"), F.col("duration")).alias("e")))
    return logs.withColumn("_ends", ends).select(key, F.posexplode(spans).alias("ix", "x")).select(
        key, "ix", "x.s", "x.e")


def event_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON log lines -> ts, level, logger, msg and the whole document as VARIANT `fields`;
    a line that is not JSON becomes an all-null row with its text in `bad`."""
    doc = F.try_parse_json(F.col(column))

    def get(path: str, kind: str):
        return F.try_variant_get(F.col("fields"), path, kind)

    return lines.select(F.col(column), doc.alias("fields")).select(
        get("$.ts", "timestamp").alias("ts"), get("$.level", "string").alias("level"),
        get("$.logger", "string").alias("logger"), get("$.msg", "string").alias("msg"), "fields",
        F.when(F.col("fields").isNull(), F.col(column)).alias("bad"))
