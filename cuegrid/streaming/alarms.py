"""Alarms on runs of failures and spent quotas, over micro-batches of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid.operators.runs import CARRIED, LIMIT, carried, failure_runs
from cuegrid.streaming.run import work_folder

#: Seconds of event time that make one chunk of a key.
CHUNK_S = 3600


def chunk_of(ts: str, seconds: int = CHUNK_S) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def run_alarms(events: DataFrame, key: str, limit: int = LIMIT, seconds: int = CHUNK_S, folder: str | None = None) -> DataFrame:
    """Process what a stream events(key, ts, seq, failed, quota) holds now; returns all alarms so far:
    (key, seq, alarm): 'streak' at the event that makes `limit` failures in a row, 'quota' at every
    event that meets a spent quota.

    A micro-batch is ordered by (ts, seq) and cut into chunks of event time, so a key with a third of
    its rows is spread over tasks, and no key's events are gathered. Between micro-batches a key is
    one row (failures in a row, whether its work has ended), written as Parquet under the number of
    the batch, as are the alarms: a repeated batch overwrites what it wrote. With the same `folder`
    a later call goes on where this one stopped. Null keys are a key of their own."""
    spark, root = events.sparkSession, folder or work_folder(events)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "ts", "seq", "failed", "quota")

    def step(batch: DataFrame, number: int) -> None:
        before = None if number == 0 else spark.read.schema(f"key struct<k0:{kind}>, {CARRIED}").parquet(f"{root}/state/batch={number - 1}")
        told = dict(quota=F.col("quota"), limit=limit, before=before)
        at = ([key], ["ts", "seq"], F.col("failed"), chunk_of("ts", seconds))
        seen = failure_runs(batch, *at, **told)
        alarm = F.when(F.col("quota"), "quota").when(F.col("streak") == limit, "streak")
        seen.select(key, "seq", alarm.alias("alarm")).where("alarm IS NOT NULL").write.mode("overwrite").parquet(f"{root}/alarms/batch={number}")
        carried(batch, *at, **told).write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    query = rows.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()
    if query.lastProgress is None and not _exists(spark, f"{root}/alarms"):  # nothing has ever arrived
        return spark.createDataFrame([], f"{key} {kind}, seq bigint, alarm string")
    return spark.read.schema(f"{key} {kind}, seq bigint, alarm string").parquet(f"{root}/alarms").select(key, "seq", "alarm")


def _exists(spark, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
