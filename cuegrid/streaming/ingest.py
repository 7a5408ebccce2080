"""Log lines as a stream: parsed rows, a side output of bad lines, and counts that tell late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cuegrid.sources.logs import event_fields
from cuegrid.streaming.run import work_folder

PARSED = "ts timestamp, level string, logger string, msg string, fields variant, bad string, good boolean"


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The lines of the text files that arrive in a folder, as a stream with one column `value`."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).text(path)


def _run(stream: DataFrame, root: str, step) -> None:
    stream.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def ingest(lines: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Process what is there now; returns (events, bad lines) of this and all earlier calls with
    `folder`. Events have ts, level, logger, msg and the whole document as VARIANT `fields`, so a
    field that no schema names is kept. A line that is not JSON, or is JSON but no object with a
    readable ts, is a bad line with its text.

    Lines are parsed once, and a micro-batch is one write under its number: repeating it overwrites
    it. Bad lines lie in a partition of their own, so readers of events never see them."""
    spark, root = lines.sparkSession, folder or work_folder(lines)

    def step(batch: DataFrame, number: int) -> None:
        rows = event_fields(batch).withColumn("good", F.col("ts").isNotNull())
        told = F.when(~F.col("good"), F.coalesce(F.col("bad"), F.to_json("fields")))
        rows.withColumn("bad", told).write.mode("overwrite").partitionBy("good").parquet(f"{root}/lines/batch={number}")

    _run(lines, root, step)
    seen = spark.read.schema(f"{PARSED}, batch long").option("basePath", f"{root}/lines").parquet(f"{root}/lines")
    return seen.where("good").select("ts", "level", "logger", "msg", "fields"), seen.where("NOT good").select(F.col("bad").alias("line"))


def late_counts(events: DataFrame, keys: list[str], width: str = "1 day", delay_s: int = 3600, ts: str = "ts", folder: str | None = None) -> DataFrame:
    """(start, keys, n, late) over tumbling windows of a stream: rows on time and rows that arrived
    after their window was closed.

    A window is closed for a micro-batch when its end is not behind the latest event time of all
    earlier micro-batches less `delay_s`; that is where a stateful aggregation would drop its rows
    without a word. Each micro-batch adds partial counts under its number, which are summed when
    read, so nothing is kept in a state store; the latest event time is one row. Null keys
    count as a key; rows without a time are in no window. With the same `folder`, a later call
    goes on."""
    spark, root = events.sparkSession, folder or work_folder(events)
    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    rows = events.select(F.col(ts).cast("timestamp").alias("_ts"), *keys)

    def step(batch: DataFrame, number: int) -> None:
        before = None if number == 0 else spark.read.parquet(f"{root}/latest/batch={number - 1}").first()["at"]
        window = F.window("_ts", width)
        late: Column = F.lit(False) if before is None else F.unix_micros(F.col("w.end")) <= before - delay_s * 1_000_000
        counted = batch.where("_ts IS NOT NULL").select(window.alias("w"), *keys).groupBy("w", *keys).agg(F.count(F.lit(1)).alias("rows")).select(
            F.col("w.start").alias("start"), *keys, F.when(late, 0).otherwise(F.col("rows")).alias("n"), F.when(late, F.col("rows")).otherwise(0).alias("late"))
        counted.write.mode("overwrite").parquet(f"{root}/counts/batch={number}")
        newest = batch.agg(F.greatest(F.max(F.unix_micros("_ts")), F.lit(before).cast("long")).alias("at"))
        newest.write.mode("overwrite").parquet(f"{root}/latest/batch={number}")

    _run(rows, root, step)
    parts = spark.read.schema(f"start timestamp, {kinds}, n long, late long").parquet(f"{root}/counts")
    return parts.groupBy("start", *keys).agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
