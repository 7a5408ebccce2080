"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cuegrid.session import shared_folder


def settled(df: DataFrame) -> DataFrame:
    """`df` written as Parquet under the folder of ``spark.checkpoint.dir`` and read from there: what
    follows does not run it again, also when executors are lost, and reads only the columns it
    needs. The files are scratch; nothing reads them once the query's result is stored."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
