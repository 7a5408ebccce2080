"""Sharding: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column
from cuegrid.llm.lineage import settled

_RANGED = "doc_id long, size long, text_crc32 long, part int, before_bytes long, before_rows long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows of the task's range before each row."""
    from pyspark import TaskContext

    part, size_so_far, rows_so_far = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        sizes = column(batch, "size").to_numpy()
        before = size_so_far + np.cumsum(sizes) - sizes
        yield pa.record_batch({
            "doc_id": column(batch, "doc_id"), "size": column(batch, "size"), "text_crc32": column(batch, "text_crc32"),
            "part": pa.array(np.full(n, part, np.int32)), "before_bytes": pa.array(before),
            "before_rows": pa.array(np.arange(rows_so_far, rows_so_far + n))})
        size_so_far, rows_so_far = size_so_far + int(sizes.sum()), rows_so_far + n


def byte_shards(docs: DataFrame, shards: int = 16, rows_per_part: int = 250_000) -> DataFrame:
    """Documents in order of doc_id, cut where the running size passes equal targets.

    A row's size is its text's UTF-8 bytes (null: none) plus one. Sizes are sorted by range,
    summed within each range by one pass, and the totals of the ranges (one row each) give
    where each range begins. A document goes where its middle byte lies, so a shard is off its
    target by less than one document. Only sizes and checksums are shuffled, never texts.

    Equal doc_ids are ordered by checksum and size; a null doc_id comes first. Repeated rows
    are placed each. An empty table gives no rows; a shard may stay empty if documents are
    fewer than shards or larger than a target. Extra columns are ignored.

    Returns doc_id, size, text_crc32, shard, slot (rank in the shard), first_byte (global)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    parts = max(1, -(-docs.count() // rows_per_part), min(64, docs.sparkSession.sparkContext.defaultParallelism))
    ranged = settled(rows.repartitionByRange(parts, "doc_id", "text_crc32", "size")
                     .sortWithinPartitions("doc_id", "text_crc32", "size").mapInArrow(_running, _RANGED))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = _offsets(totals)
    placed = (ranged.join(starts, "part")
              .withColumn("first_byte", F.col("before_bytes") + F.col("part_byte"))
              .withColumn("row", F.col("before_rows") + F.col("part_row"))
              .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * first_byte + size) * {shards} div (2 * all_bytes)")).cast("int")))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))
    return (placed.join(F.broadcast(firsts), "shard")  # at most `shards` rows
            .select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("shard_row")).alias("slot"), "first_byte"))


def _offsets(totals: DataFrame) -> DataFrame:
    """Exclusive prefix sums over the ranges: one row for each, so one sorted pass over them all."""
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_byte"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_row"), F.sum("bytes").over(whole).alias("all_bytes"))


def checksum(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
