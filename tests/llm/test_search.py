"""Exact block-max search and the prefix forest against brute force."""

import math

import numpy as np
import pytest

from cuegrid.llm import blockmax, forest

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = [(k, [float(x) for x in rng.normal(size=6).round(1)], k % 3) for k in range(330)]
    made += [(k, list(made[k - 400][1]), 0) for k in range(400, 420)]  # ties
    made += [(500, None, 0), (501, [], 0), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (503, [NAN] * 6, 0), (504, [INF] * 6, 0), (None, [1.0] * 6, 0),
             (600, [0.0] * 6, 0), (601, [1.0, 2.0], 0), (700, [3.0, 1.0], 0), (10, made[10][1], 0)]
    return made


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)


def usable(rows, zero):
    return [(i, x) for i, x, _ in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and (zero or any(x))]


def test_top_k_is_brute_force(spark, rows):
    fine = usable(rows, True)
    want = []
    for q, x in {i: x for i, x in fine if i % 100 == 0}.items():
        a = [math.floor(1024 * v) for v in x]
        scored = sorted((-sum(s * math.floor(1024 * v) for s, v in zip(a, y)), i) for i, y in fine if i != q and len(y) == len(x))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:10])]
    t = table(spark, rows)
    assert sorted(map(tuple, blockmax.top_k(t, t.where("vec_id % 100 = 0")).collect())) == sorted(want)


def test_ranges_stop_at_their_bounds():
    rng = np.random.default_rng(1)
    matrix = np.concatenate([rng.normal(c, 0.05, (64, 8)) for c in (-3, -1, 1, 3)])
    ids, terms, extra = blockmax._forward_index(1024)(np.arange(256), matrix)
    high, low = np.frombuffer(extra, np.int64).reshape(2, -1, 8)
    query = np.floor(1024 * np.full((1, 8), 3.0)).astype(np.int64)
    found, scores, scored = blockmax.search_block(np.array([-5]), query, ids, terms, high, low, 10, np.full(1, np.iinfo(np.int64).min))
    exact = terms @ query[0]
    assert scored == 1 and scores[0].tolist() == sorted(exact.tolist(), reverse=True)[:10]


def test_large_components_stay_exact(spark):
    t = spark.createDataFrame([(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [3e5, 3.0])], "vec_id long, embedding array<double>")
    got = blockmax.top_k(t, t.where("vec_id = 0")).collect()
    big = 1024 * 300_000
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, big * big + 1024 * 3072), (1, big * big + 1024 * 2048)]


def test_forest_distances_and_recall(spark, rows):
    fine = usable(rows, False)
    t = table(spark, rows)
    got = {}
    for r in forest.nearest(t, t.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = {i: x for i, x in fine if i % 100 == 0}
    assert set(got) == {q for q, x in queries.items() if any(i != q and len(y) == len(x) for i, y in fine)}
    hits = total = 0
    for q, listed in got.items():
        x = queries[q]
        exact = sorted((math.dist(x, y), i) for i, y in fine if i != q and len(y) == len(x))[:10]
        listed.sort()
        assert [r for r, _, _ in listed] == list(range(1, len(listed) + 1)) and len(listed) == len(exact)
        assert [(s, i) for _, i, s in listed] == sorted((s, i) for _, i, s in listed)
        for _, i, s in listed:
            assert s in [pytest.approx(math.dist(x, y)) for j, y in fine if j == i]
        hits += sum(s <= exact[-1][0] + 1e-12 for _, _, s in listed)
        total += len(exact)
    assert hits / total >= 0.9


def test_ascent_takes_the_longest_prefixes_first():
    hashes = np.sort(np.array([0b1010, 0b1011, 0b0100, 0b1000], np.uint64) << np.uint64(60))
    asked = np.array([[np.uint64(0b1011) << np.uint64(60)]])
    first, last = forest.candidates([hashes], asked, 1)
    assert hashes[first[0, 0]:last[0, 0]].tolist() == [0b1011 << 60]
    first, last = forest.candidates([hashes], asked, 2)
    assert [h >> 60 for h in hashes[first[0, 0]:last[0, 0]].tolist()] == [0b1010, 0b1011]


def test_recall_on_the_corpus(spark):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.1"
    t = pq.read_table(f"{folder}/embeddings.parquet")
    ids, x = np.array(t.column("vec_id")), np.array(t.column("embedding").to_pylist(), float)
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = {}
    for r in forest.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(d)[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_empty_tables(spark):
    t = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert blockmax.top_k(t, t).count() == 0 and forest.nearest(t, t).count() == 0


def test_forest_small_table_with_copies(spark):
    """Copies of the query fill every tree's stretch with the same rows; the others are candidates too."""
    rng = np.random.default_rng(6)
    made = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(8)] + [(k, [float(x) for x in rng.normal(size=4)]) for k in range(8, 40)]
    made += [(k, [5.0, 6.0]) for k in (50, 50, 51)]  # fewer candidates than k
    t = spark.createDataFrame(made, "vec_id long, embedding array<double>").coalesce(1)
    got = forest.nearest(t, t.where("vec_id IN (0, 50)")).collect()
    assert sorted(r["rank"] for r in got if r["query_id"] == 0) == list(range(1, 11))
    assert [r["vec_id"] for r in sorted(got) if r["query_id"] == 0][:7] == list(range(1, 8))
    assert [r["vec_id"] for r in got if r["query_id"] == 50] == [51]
