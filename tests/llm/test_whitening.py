"""Whitening against the eigenvectors of the explicit covariance."""

import numpy as np
import pytest

from cuegrid.llm import whitening

SCHEMA = "n long, embedding array<float>, x int, vec_id long, component string"


def table(spark, rows):
    """With further columns whose names the operator uses inside."""
    return spark.createDataFrame([(3, None if v is None else [None if c is None else float(c) for c in v], 4, i, "c") for i, v in rows], SCHEMA).repartition(5)


def taking_part(rows):
    return [(i, np.array([int(np.floor(256 * float(np.float32(c)))) for c in v], object)) for i, v in rows
            if v is not None and len(v) and all(c is not None and np.isfinite(np.float32(c)) for c in v)]


def check(spark, rows, components):
    """`rows` of one length; compares all columns, components by what they do up to their sign."""
    got = whitening.whiten(table(spark, rows)).collect()
    xs = taking_part(rows)
    fitted = np.array(sorted({tuple(x) for _, x in xs}), object)
    n, sums = len(fitted), fitted.sum(0)
    plain = fitted.astype(float)
    centred = plain - plain.mean(0)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == len(xs) * components
    assert sorted(str((r["vec_id"], r["component"], r["n"], r["deviation"])) for r in got) == sorted(
        str((i, c + 1, n, int(((n * x - sums) ** 2).sum()))) for i, x in xs for c in range(components))
    assert all(r["identity_error"] <= 1e-10 for r in got)
    for c in range(components):
        mine = {}
        for r in got:
            if r["component"] == c + 1:
                mine[r["vec_id"]] = r["whitened"]
                assert abs(r["explained"] - values[c] / np.trace(cov)) < 1e-12
        right = {i: float((x.astype(float) - plain.mean(0)) @ axes[:, c] / np.sqrt(values[c])) for i, x in xs}
        sign = np.sign(sum(mine[i] * right[i] for i in right))
        assert max(abs(sign * mine[i] - right[i]) for i in right) < 1e-8
    return got


def test_like_the_explicit_covariance(spark):
    made = np.random.default_rng(1)
    rows = [(k, v) for k, v in enumerate(made.standard_normal((700, 20)) * np.linspace(1, 2, 20) + 3)]
    check(spark, rows + [(1000 + k, rows[0][1]) for k in range(300)], 4)  # copies are fitted once


def test_small_spaces(spark):
    made = np.random.default_rng(2)
    for d in (1, 2, 3, 5):
        check(spark, [(k, v) for k, v in enumerate(made.standard_normal((40, d)))], min(d, 4))


def test_rows_that_take_no_part(spark):
    made = np.random.default_rng(3)
    rows = [(k, v) for k, v in enumerate(made.standard_normal((60, 6)))]
    bad = [(100, None), (101, []), (102, [1.0, None, 0, 0, 0, 0]), (103, [float("nan")] * 6), (104, [0, 0, float("inf"), 0, 0, 0]), (105, [-0.0] * 6), (None, [0.5] * 6)]
    got = check(spark, rows + bad, 4)
    assert {r["vec_id"] for r in got} == set(range(60)) | {105, None}
    assert {r["vec_id"] for r in whitening.whiten(table(spark, rows + [(106, [3e38, 0, 0, 0, 0, 0])])).collect()} == set(range(60))


def test_few_directions(spark):
    line = [(k, [k, 2 * k, 0, 1]) for k in range(9)]
    check(spark, line, 1)  # one component has variance
    assert whitening.whiten(table(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    assert whitening.whiten(table(spark, line).limit(0)).count() == 0


def test_equal_eigenvalues(spark):
    cross = [(2 * d + s, [(1 - 2 * s) * float(k == d) for k in range(6)]) for d in range(6) for s in (0, 1)]
    got = whitening.whiten(table(spark, cross)).collect()
    assert len(got) == 48 and all(abs(r["explained"] - 1 / 6) < 1e-12 and r["identity_error"] < 1e-10 for r in got)


def test_lengths_are_spaces_of_their_own(spark):
    made = np.random.default_rng(5)
    short, long = [(k, v) for k, v in enumerate(made.standard_normal((30, 3)))], [(100 + k, v) for k, v in enumerate(made.standard_normal((40, 5)))]
    got = whitening.whiten(table(spark, short + long)).collect()
    assert {(r["vec_id"] >= 100, r["n"]) for r in got} == {(False, 30), (True, 40)}


def test_deviation_is_exact_or_null(spark):
    rows = [(k, [k * 50, (k % 3) * 50]) for k in range(400)]
    check(spark, rows, 2)
    huge = whitening.whiten(table(spark, [(k, [k * 1e10, k % 2]) for k in range(400)])).collect()
    assert any(r["deviation"] is None for r in huge) and all(r["deviation"] is None or r["deviation"] < 2 ** 63 for r in huge)


@pytest.mark.parametrize("size", [9, 30])
def test_close_eigenvalues(spark, size):
    made = np.random.default_rng(size)
    rows = [(k, v) for k, v in enumerate(made.standard_normal((3000, size)))]
    assert len(check(spark, rows, 4)) == 12000
