"""Approximate nearest neighbours: a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column
from cuegrid.llm.vectors import array_of, best, pairs, usable

#: Trees of the forest, and bits of each hash string.
TREES, BITS = 12, 64
#: Share of a block's rows that a query gathers before it stops ascending. The test embeddings lie
#: nearly evenly on a sphere (a nearest neighbour at 63 degrees, others at 90), where a recall of
#: 0.9 needs such a share; clustered vectors need far less.
SHARE = 0.8


def planes(tree: int, size: int) -> np.ndarray:
    """Normals of the tree's hyperplanes: one for each bit, the same on every machine."""
    return np.random.default_rng([9721, tree, size]).standard_normal((size, BITS))


def strings(matrix: np.ndarray, tree: int) -> np.ndarray:
    """Hash strings as 64-bit numbers, the first bit highest, so that order is by prefix."""
    bits = matrix @ planes(tree, matrix.shape[1]) > 0
    return np.packbits(bits, axis=1, bitorder="big").view(">u8").ravel().astype(np.uint64)


def _trees(ids: np.ndarray, matrix: np.ndarray):
    parts = []
    for tree in range(TREES):
        hashes = strings(matrix, tree)
        order = np.argsort(hashes, kind="stable")
        parts += [hashes[order].tobytes(), order.astype(np.uint64).tobytes()]
    return ids, matrix, b"".join(parts)


def candidates(sorted_hashes: list[np.ndarray], asked: np.ndarray, wanted: int, enough=None) -> tuple[np.ndarray, np.ndarray]:
    """First and last place, per query and tree, of the rows gathered by ascending in step.

    Descending, the longest prefix that a query shares with any row of a tree is where its hash
    falls in the sorted array. From there all trees ascend together: the rows that share at least x
    bits are one stretch of each array, and x falls until the stretches hold `wanted` rows in all
    and `enough`, asked with a query and its stretches' ends, agrees: stretches may hold the same
    few rows in every tree."""
    trees, n = asked.shape
    first, last = np.zeros((trees, n), np.int64), np.zeros((trees, n), np.int64)
    open_ = np.ones(n, bool)
    for shared in range(BITS, -1, -1):
        low_bits = np.uint64((1 << (BITS - shared)) - 1)
        at = np.flatnonzero(open_)
        for t in range(trees):
            h = asked[t, at]
            first[t, at] = np.searchsorted(sorted_hashes[t], h & ~low_bits, side="left")
            last[t, at] = np.searchsorted(sorted_hashes[t], h | low_bits, side="right")
        open_[at] = (last[:, at] - first[:, at]).sum(axis=0) < wanted
        if enough is not None:
            full = at[~open_[at]]
            open_[full] = [not enough(q, first[:, q], last[:, q]) for q in full.tolist()]
        if not open_.any():
            break
    return first, last


def search_block(query_ids, queries, ids, matrix, trees, k: int, share: float):
    """(query number, row number, distance) of the k nearest gathered rows of one block."""
    n = len(ids)
    # stretches of several trees overlap; so many rows in all hold about `share` of the block's rows once each
    wanted = int(np.ceil(-np.log1p(-min(share, 0.999)) * n)) + 2 * k
    asked = np.stack([strings(queries, t) for t in range(TREES)])

    def gathered(q: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        mark = np.zeros(n, bool)
        for t, (_, order) in enumerate(trees):
            mark[order[first[t]:last[t]]] = True
        return np.flatnonzero(mark & (ids != query_ids[q]))

    def enough(q: int, first: np.ndarray, last: np.ndarray) -> bool:
        longest = int((last - first).max())  # distinct rows of one tree; the query's own may be among them
        if longest < n and longest <= k + own.get(query_ids[q], 0):
            return len(gathered(q, first, last)) >= min(k, n - own.get(query_ids[q], 0))
        return True

    own = dict(zip(*np.unique(ids[np.isin(ids, query_ids)], return_counts=True)))
    first, last = candidates([h for h, _ in trees], asked, wanted, enough)
    out_q, out_r, out_d = [], [], []
    for q in range(len(queries)):
        rows = gathered(q, first[:, q], last[:, q])
        distance = np.sqrt(((matrix[rows] - queries[q]) ** 2).sum(axis=1))
        if len(rows) > k:
            near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
            rows, distance = rows[near], distance[near]
        pick = np.lexsort((ids[rows], distance))[:k]
        out_q.append(np.full(len(pick), q))
        out_r.append(rows[pick])
        out_d.append(distance[pick])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_d)


def _search(k: int, share: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size = column(batch, "size")[row].as_py()
                ids, matrix = array_of(batch, "ids", row, np.int64), array_of(batch, "data", row, float).reshape(-1, size)
                extra = array_of(batch, "extra", row, np.uint64).reshape(TREES, 2, -1)
                query_ids = array_of(batch, "q_ids", row, np.int64)
                queries = array_of(batch, "q_data", row, float).reshape(-1, size)
                q, r, d = search_block(query_ids, queries, ids, matrix, [(x[0], x[1].astype(np.int64)) for x in extra], k, share)
                yield pa.record_batch({"query_id": pa.array(query_ids[q]), "vec_id": pa.array(ids[r]), "score": pa.array(d)})

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k nearest vectors found, by the
    Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id,
    and a row never answers its own vec_id.

    Every row is indexed: rows are packed into blocks where they lie, and each block holds, for each
    tree, the sorted array of its rows' hash strings (signs of random projections). `share` is the
    only knob: how much of a block a query gathers before it stops ascending.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part, on
    either side; vectors meet only queries of their own number of components. Repeated rows count
    each; repeated queries share one list. Empty tables give no rows; other columns are ignored."""
    rows, asked = usable(vectors, zero=False), usable(queries, zero=False).dropDuplicates(["vec_id"])
    found = pairs(rows, asked, _trees, rows.count(), asked.count()).mapInArrow(_search(k, share), "query_id long, vec_id long, score double")
    return best(found, k, F.asc("score"), F.asc("vec_id")).select("query_id", "rank", "vec_id", "score")
