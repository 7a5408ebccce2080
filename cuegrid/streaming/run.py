"""Running a bounded stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cuegrid.session import shared_folder


def work_folder(df: DataFrame) -> str:
    """A fresh folder under the folder that all executors share. It may go once the results that
    were read from it are stored."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process what is there now and return the written rows. Results go to files, never
    through the driver; in update mode every micro-batch's rows carry its `batch` number."""
    spark, root = stream.sparkSession, folder or work_folder(stream)
    out = f"{root}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/progress").trigger(
        availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def keep(batch: DataFrame, number: int) -> None:
        # overwriting makes a repeated micro-batch harmless
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(out)
