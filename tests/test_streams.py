"""Streams fed in several steps."""

import datetime as dt

from pyspark.sql import functions as F

from cuegrid.streaming import events as E
from cuegrid.streaming.alarms import run_alarms
from cuegrid.streaming.run import run_available

BASE = dt.datetime(2024, 1, 1)


def feed(spark, folder, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return E.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def test_failure_counter_spans_batches_and_resets(spark, tmp_path):
    schema = "user string, ts timestamp, seq long, failed boolean"
    src, state = str(tmp_path / "in"), str(tmp_path / "work")
    feed(spark, src, [("u", at(1), 1, True), ("u", at(2), 2, True)], schema)
    rows = stream(spark, src, schema).withColumn("quota", F.lit(False))
    assert run_alarms(rows, "user", folder=state).count() == 0
    feed(spark, src, [("u", at(3), 3, True), ("u", at(4), 4, False), ("u", at(5), 5, True)], schema)
    rows = stream(spark, src, schema).withColumn("quota", F.lit(False))
    assert [r.seq for r in run_alarms(rows, "user", folder=state).collect()] == [3]


def test_latest_state_can_go_back(spark, tmp_path):
    schema = "scene string, ts timestamp, seq long, status string"
    src = str(tmp_path / "in")
    feed(spark, src, [("s", at(1), 1, "failed"), ("s", at(2), 2, "pending")], schema)
    feed(spark, src, [("s", at(2), 3, "complete"), ("s", at(1), 4, "failed")], schema)
    out = run_available(E.latest_states(stream(spark, src, schema), ["scene"]), "update", str(tmp_path / "w"))
    last = out.groupBy("scene").agg(F.max_by("status", F.struct("ts", "seq")).alias("status")).first()
    assert last.status == "complete"


def test_open_request_times_out(spark, tmp_path):
    schema = "user string, ts timestamp, seq long, kind string"
    src, state = str(tmp_path / "in"), str(tmp_path / "work")
    feed(spark, src, [("a", at(0), 1, "request"), ("b", at(0), 2, "request"), ("b", at(5), 3, "done")], schema)
    got = run_available(E.request_timeouts(stream(spark, src, schema), "user", 1800), folder=state)
    assert got.count() == 0
    feed(spark, src, [("c", at(600), 4, "done")], schema)
    run_available(E.request_timeouts(stream(spark, src, schema), "user", 1800), folder=state)
    feed(spark, src, [("c", at(660), 5, "done")], schema)
    got = run_available(E.request_timeouts(stream(spark, src, schema), "user", 1800), folder=state)
    assert [(r.user, r.seq) for r in got.collect()] == [("a", 1)]


def test_every_request_has_its_own_deadline(spark, tmp_path):
    schema = "user string, ts timestamp, seq long, kind string"
    src, state = str(tmp_path / "in"), str(tmp_path / "work")
    feed(spark, src, [("a", at(0), 1, "request"), ("a", at(10), 2, "request"), ("a", at(35), 3, "done")], schema)
    feed(spark, src, [("a", at(40), 4, "request"), ("a", at(41), 5, "request"), ("a", at(50), 6, "done"), ("a", at(60), 7, "request")], schema)
    feed(spark, src, [("z", at(600), 8, "done")], schema)
    got = run_available(E.answered_requests(stream(spark, src, schema), "user", 1800), folder=state)
    minute = 60_000_000
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, None, None), ("a", 2, 3, 25 * minute), ("a", 4, 6, 10 * minute), ("a", 5, 6, 9 * minute),
                                                                 ("a", 7, None, None)], key=str)
