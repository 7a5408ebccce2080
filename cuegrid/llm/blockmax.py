"""Exact top-k search by block-max pruning: blocks in order of their bounds, until they cannot matter."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column
from cuegrid.llm.vectors import array_of, best, pairs, usable

#: Documents of one range, whose term maxima are kept together.
RANGE_ROWS = 64
#: Chunks of queries whose thresholds a task remembers from block to block.
REMEMBERED = 256
#: Components of larger size leave the exact range of the fast product.
_SAFE = 2 ** 53


def _ordered(matrix: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Row numbers in ranges of alike vectors: halved at the median of the widest component."""
    if len(rows) <= RANGE_ROWS:
        return [rows]
    part = matrix[rows]
    order = rows[np.argsort(part[:, np.argmax(part.max(0) - part.min(0))], kind="stable")]
    half = -(-len(rows) // (2 * RANGE_ROWS)) * RANGE_ROWS
    return _ordered(matrix, order[:half]) + _ordered(matrix, order[half:])


def _forward_index(scale: int):
    def prepare(ids: np.ndarray, matrix: np.ndarray):
        terms = np.clip(np.floor(scale * matrix), -2.0 ** 62, 2.0 ** 62).astype(np.int64)
        ranges = _ordered(terms, np.arange(len(ids)))
        order = np.concatenate(ranges)
        ids, terms = ids[order], terms[order]
        edges = np.arange(0, len(ids), RANGE_ROWS)
        return ids, terms, np.stack([np.maximum.reduceat(terms, edges), np.minimum.reduceat(terms, edges)]).tobytes()

    return prepare


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T; in doubles where no sum can leave their exact range."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < _SAFE:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def search_block(query_ids, queries, ids, terms, high, low, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(vec_ids, scores, ranges scored) of the k best of one block for each query, -1 where there are
    fewer. A query's ranges come in falling order of their bounds; it stops at the first bound below
    its k-th score so far, of this block or of blocks before (`floor`)."""
    n, none = len(queries), np.iinfo(np.int64).min
    bounds = _exact(np.maximum(queries, 0), high) + _exact(np.minimum(queries, 0), low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    top, top_ids, scored = np.full((n, k), none), np.full((n, k), -1), 0
    kth = floor.copy()
    active = np.arange(n)
    for r in range(bounds.shape[1]):
        ranges = order[active, r]
        on = bounds[active, ranges] >= kth[active]
        active, ranges = active[on], ranges[on]
        if not len(active):
            break
        by = np.argsort(ranges, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(ranges[by])) + 1):
            rows, a = active[group], int(ranges[group[0]]) * RANGE_ROWS
            scores = _exact(queries[rows], terms[a:a + RANGE_ROWS])
            own = ids[a:a + RANGE_ROWS]
            scores[query_ids[rows][:, None] == own[None]] = none
            scored += len(rows)
            better = np.flatnonzero(scores.max(axis=1) >= kth[rows])
            if not len(better):
                continue
            rows, scores = rows[better], scores[better]
            all_scores = np.concatenate([top[rows], scores], axis=1)
            all_ids = np.concatenate([top_ids[rows], np.where(scores == none, -1, np.broadcast_to(own, scores.shape))], axis=1)
            pick = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            top[rows] = np.take_along_axis(all_scores, pick, axis=1)
            top_ids[rows] = np.take_along_axis(all_ids, pick, axis=1)
            kth[rows] = np.maximum(kth[rows], top[rows, k - 1])
    return top_ids, top, scored


def _search(k: int, scale: int):
    none = np.iinfo(np.int64).min

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: OrderedDict[tuple[int, int, int], np.ndarray] = OrderedDict()
        for batch in batches:
            for row in range(batch.num_rows):
                size = column(batch, "size")[row].as_py()
                ids, terms = array_of(batch, "ids", row, np.int64), array_of(batch, "data", row, np.int64).reshape(-1, size)
                high, low = array_of(batch, "extra", row, np.int64).reshape(2, -1, size)
                query_ids = array_of(batch, "q_ids", row, np.int64)
                queries = np.clip(np.floor(scale * array_of(batch, "q_data", row, float)), -2.0 ** 62, 2.0 ** 62).astype(np.int64).reshape(-1, size)
                key = (size, column(batch, "q_part")[row].as_py(), column(batch, "q_number")[row].as_py())
                held = floors.pop(key, np.full((len(queries), k), none))
                found, scores, scored = search_block(query_ids, queries, ids, terms, high, low, k, held[:, k - 1])
                # the k best scores that this task has given out for each query
                floors[key] = -np.sort(-np.concatenate([held, scores], axis=1), axis=1)[:, :k] if k else held
                if len(floors) > REMEMBERED:
                    floors.popitem(last=False)
                i, j = np.nonzero(scores > none)
                yield pa.record_batch({
                    "query_id": pa.array(query_ids[i]), "vec_id": pa.array(found[i, j]), "score": pa.array(scores[i, j])})

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k vectors with the largest integer
    inner product; ties go to the smaller vec_id, and a row never answers its own vec_id.

    A component x is the integer floor(scale * x), its sign kept. Rows are packed into blocks where
    they lie; a block's rows are put into ranges of 64 alike ones, each with the largest and the
    smallest value of every term. A range's bound for a query is the sum over terms of the query's
    value times the maximum (or the minimum, where the value is negative).

    Vectors that are null, empty or hold a null or non-finite component take no part, on either side.
    Vectors meet only queries of their own number of components. Repeated rows count each: a copy of
    a vector may take a rank of its own, and a repeated query shares one list with its copies.
    Empty tables give no rows; other columns are ignored."""
    rows, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    found = pairs(rows, asked, _forward_index(scale), rows.count(), asked.count()).mapInArrow(
        _search(k, scale), "query_id long, vec_id long, score long")
    return best(found, k, F.desc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")
