"""Runs of failures against a plain loop, in one go and carried over micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cuegrid.operators import runs
from cuegrid.streaming.alarms import run_alarms

SCHEMA = "p string, i long, bad boolean, spent boolean, run int, over string"


def made(seed, keys=("a", "b", None), n=60):
    chosen = random.Random(seed)
    odds = chosen.choice([0.2, 0.5, 0.9])
    return [(k, i, chosen.choice([True, True, None]) if chosen.random() < odds else False, chosen.choice([None, False, chosen.random() < 0.05]), 1, "x")
            for k in keys for i in range(chosen.randrange(1, n))]


def plain(rows, limit=3):
    out, run, over = [], {}, {}
    for p, i, bad, spent, *_ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        run[p] = run.get(p, 0) + 1 if bad else 0
        out.append((p, i, run[p], not over.get(p, False)))
        over[p] = over.get(p, False) or run[p] >= limit or bool(spent)
    return out, run, over


def go(df, size, before=None, limit=3):
    return (["p"], ["i"], F.col("bad"), F.floor(F.col("i") / size)), dict(quota=F.col("spent"), limit=limit, before=before)


@pytest.mark.parametrize("size,limit", [(1, 3), (2, 3), (7, 2), (7, 5), (1000, 3)])
def test_like_a_loop(spark, size, limit):
    rows = made(size * limit)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    at, told = go(df, size, limit=limit)
    got = [(r.p, r.i, r.streak, r.attempted) for r in runs.failure_runs(df, *at, **told).collect()]
    want, run, over = plain(rows, limit)
    assert sorted(got, key=str) == sorted(want, key=str)
    left = {r.key.k0: (r.run, r.over) for r in runs.carried(df, *at, **told).collect()}
    assert left == {p: (run[p], over[p]) for p in run}


def test_carried_into_later_rows(spark):
    rows = made(11, n=90)
    want, run, over = plain(rows)
    before, got = None, []
    for a, b in ((0, 17), (17, 18), (18, 55), (55, 99)):
        df = spark.createDataFrame([r for r in rows if a <= r[1] < b], SCHEMA)
        at, told = go(df, 4, before)
        got += [(r.p, r.i, r.streak, r.attempted) for r in runs.failure_runs(df, *at, **told).collect()]
        before = spark.createDataFrame(runs.carried(df, *at, **told).collect(), f"key struct<k0:string>, {runs.CARRIED}")
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.key.k0: (r.run, r.over) for r in before.collect()} == {p: (run[p], over[p]) for p in run}


def test_empty_and_one_hot_key(spark):
    df = spark.createDataFrame([("hot", i, i % 5 != 0, False, 1, "x") for i in range(5000)], SCHEMA)
    at, told = go(df, 100)
    out = runs.failure_runs(df, *at, **told)
    assert out.where("streak = 4").count() == 1000 and out.where("attempted").count() == 4  # rows 0 to 3
    assert runs.failure_runs(df.limit(0), *at, **told).count() == 0 and runs.carried(df.limit(0), *at, **told).count() == 0


def test_rows_are_shuffled_by_chunk_and_summaries_once(spark, capsys):
    df = spark.createDataFrame(made(3), SCHEMA)
    at, told = go(df, 10)
    runs.failure_runs(df, *at, **told).explain()
    plan = capsys.readouterr().out
    # rows by chunk (twice the same, which Spark runs once), summaries by group and back to their chunks
    assert plan.count("Exchange") <= 4


BASE = dt.datetime(2024, 1, 1)
EVENTS = "user string, ts timestamp, seq long, failed boolean, quota boolean"


def test_alarms_over_batches_and_a_restart(spark, tmp_path):
    chosen = random.Random(5)
    rows = [(chosen.choice(["u", "v", None]), BASE + dt.timedelta(minutes=7 * k), k, chosen.random() < 0.6, chosen.random() < 0.05) for k in range(200)]
    want, run = [], {}
    for u, _, k, bad, spent in rows:
        run[u] = run.get(u, 0) + 1 if bad else 0
        if spent or run[u] == 3:
            want.append((u, k, "quota" if spent else "streak"))
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    for a, b in ((0, 1), (1, 80), (80, 81), (81, 200)):  # each call goes on from the checkpoint of the one before
        spark.createDataFrame(rows[a:b], EVENTS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        got = run_alarms(stream, "user", folder=work)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([w for w in want if w[1] < b], key=str)
    again = run_alarms(spark.readStream.schema(EVENTS).parquet(source), "user", folder=work)
    assert again.count() == len(want)  # nothing new, nothing twice


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    source, work = str(tmp_path / "in"), tmp_path / "work"
    spark.createDataFrame([("u", BASE, 1, True, False), ("u", BASE, 2, True, False)], EVENTS).write.parquet(source)
    run_alarms(spark.readStream.schema(EVENTS).parquet(source), "user", folder=str(work))
    spark.createDataFrame([("u", BASE, 3, True, False)], EVENTS).write.mode("append").parquet(source)
    run_alarms(spark.readStream.schema(EVENTS).parquet(source), "user", folder=str(work))
    (work / "progress" / "commits" / "1").unlink()  # as if the driver was lost before it committed batch 1
    for name in (work / "progress" / "commits").glob(".1.*"):
        name.unlink()
    got = run_alarms(spark.readStream.schema(EVENTS).parquet(source), "user", folder=str(work))
    assert [tuple(r) for r in got.collect()] == [("u", 3, "streak")]
    assert (work / "state" / "batch=1").is_dir()
