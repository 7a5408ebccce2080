"""Vectors in blocks: packing rows where they lie, and meeting blocks with chunks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column

#: Rows of one block, and of one chunk of queries, at most.
BLOCK_ROWS, CHUNK_ROWS = 8192, 1024

_PACKED = "part int, number int, size int, ids binary, data binary, extra binary"


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part: an id, and components that are all
    there and finite; with `zero` false not all of them zero. Empty vectors take no part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    if not zero:
        fine = fine & F.exists(x, lambda v: v != 0)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))


def packed(rows: DataFrame, most: int, prepare: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, bytes]]) -> DataFrame:
    """Rows of one task and of equal size packed into blocks of at most `most`: no shuffle, and no
    value decides where a row goes. `prepare` takes (ids, matrix) and returns both, in whatever
    order and type it wants, with what else the block's search needs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(size: int) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in waiting[size]])
            matrix = np.concatenate([x[1] for x in waiting.pop(size)])
            ids, matrix, extra = prepare(ids, matrix)
            return pa.record_batch({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "size": pa.array([size], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([matrix.tobytes()], pa.binary()), "extra": pa.array([extra], pa.binary())})

        for batch in batches:
            lists = column(batch, "embedding")
            ids, sizes = column(batch, "vec_id").to_numpy(), np.diff(lists.offsets.to_numpy())
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                matrix = flat[offsets[at][:, None] + np.arange(size)[None]]
                for k in range(0, len(at), most):
                    piece = (ids[at[k:k + most]], matrix[k:k + most])
                    if size in waiting and sum(len(x[0]) for x in waiting[size]) + len(piece[0]) > most:
                        yield block(size)
                        number += 1
                    waiting.setdefault(size, []).append(piece)
        for size in list(waiting):
            yield block(size)
            number += 1

    return rows.mapInArrow(pack, _PACKED)


def pairs(vectors: DataFrame, queries: DataFrame, prepare, total: int, asked: int) -> DataFrame:
    """A row for each block of vectors and each chunk of queries of the same size.

    Blocks are dealt over a number of groups that grows with the rows; each group gets all chunks
    (the stated query set), streamed past its blocks. Blocks are shuffled once."""
    groups = max(8, -(-total // (2 * BLOCK_ROWS)))
    blocks = packed(vectors, BLOCK_ROWS, prepare).withColumn("g", F.expr(f"pmod(xxhash64(part, number), {groups})").cast("int"))
    plain = lambda ids, matrix: (ids, matrix, b"")
    chunks = packed(queries.repartition(max(1, -(-asked // CHUNK_ROWS))), CHUNK_ROWS, plain).select(
        F.col("size"), F.col("part").alias("q_part"), F.col("number").alias("q_number"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    return blocks.join(chunks, ["g", "size"]).drop("g")


def array_of(batch: pa.RecordBatch, name: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(column(batch, name)[row].as_buffer(), kind)


def best(found: DataFrame, k: int, *order) -> DataFrame:
    """The first `k` rows of each query, ranked from 1. Spark drops rows beyond the k-th before the
    shuffle as well."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
