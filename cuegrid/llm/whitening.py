"""Whitening of embeddings by Jacobi-Davidson: the covariance is never formed, only multiplied by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column
from cuegrid.llm.lineage import settled

#: Entries are multiplied by this and rounded down.
SCALE = 256
#: Whole numbers beyond this are not exact in a double; rows with such entries take no part.
LARGEST = 2.0 ** 53
#: Residuals, as a share of the largest Ritz value, that count as double precision.
RESIDUAL = 256 * np.finfo(float).eps
#: MINRES steps of a correction, and how many further pairs are sought to guard the order.
INNER_STEPS, GUARDS = 6, 2
#: Vectors in the basis before it is cut back to the best Ritz vectors.
BASIS = 48
#: Rows of the blocks that products run over, and of the files that hold them, unless those are few.
BLOCK_ROWS, FILE_ROWS = 4096, 1 << 16


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part, entries as whole numbers."""
    c = F.col("embedding").cast("array<double>")
    fine = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < LARGEST))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * SCALE)).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        rows = np.concatenate(waiting)
        waiting.clear()
        return pa.record_batch({"rows": pa.array([len(rows)], pa.int32()), "data": pa.array([rows.tobytes()], pa.binary())})

    for batch in batches:
        lists = column(batch, "x")
        if not batch.num_rows:
            continue
        rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for k in range(0, len(rows), BLOCK_ROWS):
            if sum(map(len, waiting)) + len(rows[k:k + BLOCK_ROWS]) > BLOCK_ROWS:
                yield block()
            waiting.append(rows[k:k + BLOCK_ROWS])
    if waiting:
        yield block()


class Fit:
    """The fit list in blocks, and products with its covariance. The driver holds bases of a few
    dozen vectors as long as an embedding; what is summed over rows is summed by Spark."""

    def __init__(self, xs: DataFrame, size: int):
        self.size = size
        distinct = settled(xs.select("x").dropDuplicates(["x"]))
        count = distinct.count()
        # as many files as rows call for, not as many as the shuffle had partitions: each costs every pass a task
        files = max(1, min(8, -(-count // BLOCK_ROWS)), -(-count // FILE_ROWS))
        self.blocks = settled(distinct.coalesce(files).mapInArrow(_blocks, "rows int, data binary"))
        self.passes = 0
        # halves of 32 bits, so that sums within a block stay whole
        self.n, low, high = 0, [0] * size, [0] * size
        for r in self._sums(lambda rows: np.concatenate([[len(rows)], (rows & 0xFFFFFFFF).sum(0), (rows >> 32).sum(0)]), "bigint", "decimal(38,0)"):
            place, value = r["place"], int(r["value"])
            if place == 0:
                self.n = value
            else:
                (low if place <= size else high)[(place - 1) % size] = value
        self.sums = [a + (b << 32) for a, b in zip(low, high)]
        self.mean = np.array([s / max(1, self.n) for s in self.sums])
        # the mean's rounding error, so that centred rows are centred beyond it
        self.rest = np.array([(s - int(m) * self.n) / max(1, self.n) - (m - int(m)) for s, m in zip(self.sums, self.mean)])

    def _sums(self, of_block: Callable[[np.ndarray], np.ndarray], kind: str, total: str) -> list:
        """`of_block` of every block, summed by place: in each task first, then by Spark."""
        size, self.passes = self.size, self.passes + 1
        number = pa.int64() if kind == "bigint" else pa.float64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = None
            for batch in batches:
                for data in column(batch, "data"):
                    more = np.asarray(of_block(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, size))).ravel()
                    values = more if values is None else values + more
            if values is not None:
                yield pa.record_batch({"place": pa.array(np.arange(len(values), dtype=np.int32)), "value": pa.array(values, number)})

        parts = self.blocks.mapInArrow(run, f"place int, value {kind}")
        return parts.groupBy("place").agg(F.sum(F.col("value").cast(total)).alias("value")).collect()

    def summed(self, of_centred: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The mean of `of_centred` over the blocks' centred rows."""
        mean, rest = self.mean, self.rest
        out = np.zeros(int(np.prod(shape)))
        for r in self._sums(lambda rows: of_centred((rows - mean) - rest), "double", "double"):
            out[r["place"]] = r["value"]
        return out.reshape(shape) / max(1, self.n)

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance times each column: one pass over the blocks for all of them."""
        return self.summed(lambda rows: rows.T @ (rows @ vectors), vectors.shape)

    def trace(self) -> float:
        return float(self.summed(lambda rows: np.array([(rows * rows).sum()]), (1,))[0])


def _apart(vectors: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what of the columns lies outside the bases."""
    scale = np.linalg.norm(vectors, axis=0)
    vectors = vectors[:, scale > 0] / scale[scale > 0]
    out = np.zeros((vectors.shape[0], 0))
    for v in vectors.T:
        for _ in range(3):
            for basis in (*bases, out):
                v = v - basis @ (basis.T @ v)
            norm = np.linalg.norm(v)
            if norm < 1e-13:
                break
            v = v / norm
        else:
            out = np.column_stack([out, v])
    return out


def _minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, right: np.ndarray, out_of: np.ndarray, count: int) -> np.ndarray:
    """For each column the vector of the Krylov space that leaves the smallest residual of
    (I - P)(V - shift)(I - P) t = right, P the projection on `out_of`. All columns step together,
    so a step is one product. The three-term recurrence keeps the space orthonormal."""
    def outside(x: np.ndarray) -> np.ndarray:
        return x - out_of @ (out_of.T @ x)

    b = outside(outside(right))
    columns = b.shape[1]
    beta = [np.linalg.norm(b, axis=0)]
    alpha: list[np.ndarray] = []
    safe = np.where(beta[0] > 0, beta[0], 1)
    spaces, before = [b / safe], np.zeros_like(b)
    for _ in range(count):
        v = spaces[-1]
        w = outside(product(v) - shifts * v)
        if alpha:
            w -= beta[-1] * before
        alpha.append((v * w).sum(0))
        w = outside(w - alpha[-1] * v)
        beta.append(np.linalg.norm(w, axis=0))
        before = v
        spaces.append(w / np.where(beta[-1] > 0, beta[-1], 1))
    found = np.zeros_like(b)
    for c in range(columns):
        steps = next((k + 1 for k in range(count) if beta[k + 1][c] <= 1e-14 * (beta[0][c] or 1)), count)
        t = np.zeros((steps + 1, steps))
        for k in range(steps):
            t[k, k], t[k + 1, k] = alpha[k][c], beta[k + 1][c]
            if k:
                t[k - 1, k] = beta[k][c]
        goal = np.zeros(steps + 1)
        goal[0] = beta[0][c]
        weights = np.linalg.lstsq(t, goal, rcond=None)[0]
        found[:, c] = sum(weight * space[:, c] for weight, space in zip(weights, spaces))
    return outside(found)


def leading_pairs(fit: Fit, wanted: int, most_rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of the covariance, falling, and their unit eigenvectors.

    Ritz pairs of a growing basis; each that has not converged adds the solution of its projected
    correction equation. Pairs at the top whose residuals reach double precision are locked
    and everything later stays orthogonal to them. A pair counts only if a fresh product
    confirms its residual."""
    d = fit.size
    wanted = min(wanted, d)
    sought = min(d, wanted + GUARDS)
    locked, values = np.zeros((d, 0)), []
    basis = _apart(np.random.default_rng(7).standard_normal((d, sought)))
    image = fit.product(basis)
    for _ in range(most_rounds):
        square = basis.T @ image
        ritz, turn = np.linalg.eigh((square + square.T) / 2)
        turn = turn[:, ::-1]
        basis, image, ritz = basis @ turn, image @ turn, ritz[::-1]
        aim = RESIDUAL * max(values[0] if values else 0.0, ritz[0] if len(ritz) else 0.0)
        full = basis.shape[1] + locked.shape[1] >= d
        residuals = image - basis * ritz
        residuals -= locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0)
        done = 0
        while done < min(len(ritz), wanted - len(values)) and norms[done] <= aim:
            done += 1
        if done:
            fresh = fit.product(basis[:, :done])
            image[:, :done] = fresh
            exact = (basis[:, :done] * fresh).sum(0)
            off = fresh - basis[:, :done] * exact
            sound = np.linalg.norm(off - locked @ (locked.T @ off), axis=0) <= 2 * aim
            done = int(np.argmin(sound)) if not sound.all() else done
            if done:
                locked = np.column_stack([locked, basis[:, :done]])
                values += exact[:done].tolist()
                basis, image, residuals, norms, ritz = basis[:, done:], image[:, done:], residuals[:, done:], norms[done:], ritz[done:]
                # what is kept is made exactly orthogonal to what is locked
                share = locked.T @ basis
                basis, image = basis - locked @ share, image - (locked * np.array(values)) @ share
        if len(values) >= wanted:
            break
        if full:  # nothing is left to add: the remaining pairs are those of the whole space
            basis = _apart(basis, locked)
            image = fit.product(basis)
            square = basis.T @ image
            ritz, turn = np.linalg.eigh((square + square.T) / 2)
            take = wanted - len(values)
            locked = np.column_stack([locked, (basis @ turn[:, ::-1])[:, :take]])
            values += ritz[::-1][:take].tolist()
            break
        if basis.shape[1] + sought > BASIS:
            keep = min(basis.shape[1], 2 * sought)
            basis = _apart(basis[:, :keep], locked)
            image = fit.product(basis)
            continue
        open_ = np.flatnonzero(norms[:sought - len(values)] > aim)
        around = _apart(np.column_stack([locked, basis[:, :sought - len(values)]]))
        step = _minres(fit.product, ritz[open_], -residuals[:, open_], around, min(INNER_STEPS, max(1, d - around.shape[1])))
        fresh = _apart(step, locked, basis)
        if not fresh.shape[1]:
            fresh = _apart(np.random.default_rng(len(values) + basis.shape[1]).standard_normal((d, 1)), locked, basis)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, fit.product(fresh)])
    else:
        raise ArithmeticError(f"residuals {norms[:wanted]} above {aim} after {most_rounds} rounds")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(xs: DataFrame, fit: Fit, values: np.ndarray, vectors: np.ndarray, explained: np.ndarray, error: float) -> DataFrame:
    n, sums, mean, rest, scale = fit.n, fit.sums, fit.mean, fit.rest, np.sqrt(values)
    most = max(abs(s) for s in sums)

    def deviations(rows: np.ndarray) -> pa.Array:
        """Sums of (n x - S)**2 as whole numbers; null where a long cannot hold them."""
        if rows.shape[1] * (n * int(np.abs(rows).max(initial=0)) + most) ** 2 < 2 ** 63:
            return pa.array(((rows * n - np.array(sums, np.int64)) ** 2).sum(1))
        exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in rows.tolist()]
        return pa.array([x if x < 2 ** 63 else None for x in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            projected = (((rows - mean) - rest) @ vectors) / scale
            k = len(values)
            at = pa.array(np.repeat(np.arange(len(rows)), k))
            m = len(rows) * k
            yield pa.record_batch({
                "vec_id": column(batch, "vec_id").take(at), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                "n": pa.array(np.full(m, n)), "deviation": deviations(rows).take(at), "whitened": pa.array(projected.ravel()),
                "explained": pa.array(np.tile(explained, len(rows))), "identity_error": pa.array(np.full(m, error))})

    return xs.mapInArrow(run, _OUT)


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """The vectors on the leading components of their covariance, each scaled to variance one.

    Entries c become whole numbers x = floor(256 c). The fit list is each distinct vector once: n
    of them with sums S. Components are unit eigenvectors of its covariance (divisor n),
    numbered from 1 by falling eigenvalue; their signs are free. Eigenvalues are those of a
    Jacobi-Davidson iteration, whose products with the covariance are passes over the fit list.

    Rows whose vector is null, empty, or holds a null, a non-finite entry or one beyond 2**53 / 256
    are dropped. A null vec_id stays. Repeated rows are whitened each and fitted once. Vectors
    of unlike lengths are spaces of their own, each fitted by itself. Components without variance
    (below 1e-12 of the largest) cannot be whitened and are not returned, so a fit list of one
    vector gives no rows; so does an empty table. Extra columns are ignored.

    Returns for each row and component: vec_id, component, n, deviation (exact sum over dimensions
    of (n x - S)**2; null beyond a long), whitened, explained (share of the total variance),
    identity_error (largest entry of the whitened fit list's covariance minus the identity)."""
    xs = whole(vectors)
    out = None
    # one pass for each length there is; a table of embeddings has one
    for row in xs.select(F.size("x").alias("size")).distinct().orderBy("size").collect():
        own = xs.where(F.size("x") == row["size"])
        fit = Fit(own, row["size"])
        total = fit.trace()
        values, axes = leading_pairs(fit, components) if total > 0 else (np.zeros(0), np.zeros((row["size"], 0)))
        real = values > 1e-12 * (values[0] if len(values) else 0)
        values, axes = values[real], axes[:, real]
        if not len(values):
            continue
        scaled = axes / np.sqrt(values)
        centre = fit.summed(lambda rows: (rows @ scaled).sum(0), (len(values),))
        spread = fit.summed(lambda rows: (rows @ scaled - centre).T @ (rows @ scaled - centre), (len(values), len(values)))
        error = float(np.abs(spread - np.eye(len(values))).max())
        found = _whitened(own, fit, values, axes, values / total, error)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], _OUT) if out is None else out
