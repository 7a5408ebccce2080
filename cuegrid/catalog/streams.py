"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuegrid.catalog import tables as T
from cuegrid.catalog.base import block, query
from cuegrid.sources.logs import event_fields
from cuegrid.streaming import events as E
from cuegrid.streaming.alarms import run_alarms
from cuegrid.streaming.ingest import ingest as ingest_lines, late_counts, stream_lines
from cuegrid.streaming.requests import timed_requests
from cuegrid.streaming.run import run_available, work_folder

C = F.col
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _stream(spark, folder) -> DataFrame:
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(folder)
    return E.with_event_time(raw)


def _micros(column: str):
    return F.unix_micros(column)


@query("r1_ingest", """
  SELECT event_id, user_id, event_type, epoch_us(ts) AS at FROM events""")
def ingest(spark, folder):
    return run_available(_stream(spark, folder).select("event_id", "user_id", "event_type", "ts")).select(
        "event_id", "user_id", "event_type", _micros("ts").alias("at"))


@query("r2_latest_state", """
  SELECT user_id, event_id % 5 AS scene, arg_max(event_type, (ts, event_id)) AS status, max(event_id) AS seq FROM events GROUP BY ALL""")
def latest_state(spark, folder):
    rows = _stream(spark, folder).select("user_id", (C("event_id") % 5).alias("scene"), C("event_type").alias("status"),
                                         "ts", C("event_id").alias("seq"))
    out = run_available(E.latest_states(rows, ["user_id", "scene"]), "update")
    # the last micro-batch that touched a key holds its state
    return out.groupBy("user_id", "scene").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("seq").alias("seq"))


@query("r3_windowed_counts", """
  SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def windowed_counts(spark, folder):
    """Every window, also those the watermark has not closed: the last count each micro-batch gave."""
    out = run_available(E.windowed_counts(_stream(spark, folder), ["event_type"]), "update")
    last = out.groupBy("start", "event_type").agg(F.max("n").alias("n"))  # counts only grow
    return last.select(_micros("start").alias("start"), "event_type", "n")


@query("r4_failure_alarms", """
  SELECT user_id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak, event_type = 'error' AS bad
    FROM (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
    WHERE event_type = 'error') WHERE streak = 3""")
def failure_alarms(spark, folder):
    rows = _stream(spark, folder).select("user_id", "ts", C("event_id").alias("seq"), (C("event_type") == "error").alias("failed"), F.lit(False).alias("quota"))
    return run_alarms(rows, "user_id").select("user_id", "seq")


@query("r4_quota_alarms", """
  SELECT user_id, event_id AS seq, CASE WHEN spent THEN 'quota' ELSE 'streak' END AS alarm FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, g, bad ORDER BY ts, event_id) AS streak FROM (
      SELECT *, event_type = 'error' AS bad, event_type = 'error' AND value > 40 AS spent,
        sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)) WHERE bad AND (spent OR streak = 3)""")
def quota_alarms(spark, folder):
    """An error of a high value stands for a spent quota."""
    bad = C("event_type") == "error"
    rows = _stream(spark, folder).select("user_id", "ts", C("event_id").alias("seq"), bad.alias("failed"), (bad & (C("value") > 40)).alias("quota"))
    return run_alarms(rows, "user_id")


#: Requests (views) with the next answer (click) of their user; one that is late is given up as soon as
#: a later event of its user or the watermark shows it.
block("answered", """
  SELECT * FROM (SELECT user_id, event_id AS seq, ts, c.at - epoch_us(ts) AS gap, c.id AS done_seq, greatest(max(epoch_us(ts)) OVER (PARTITION BY user_id),
      (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events WHERE event_type IN ('view', 'click')),
      (SELECT max(epoch_us(x.ts)) FROM events x WHERE x.user_id = v.user_id AND x.event_type IN ('view', 'click'))) - epoch_us(ts) AS seen
    FROM events v LEFT JOIN LATERAL (SELECT epoch_us(e.ts) AS at, e.event_id AS id FROM events e WHERE e.user_id = v.user_id AND e.event_type = 'click'
      AND (e.ts > v.ts OR e.ts = v.ts AND e.event_id > v.event_id) ORDER BY e.ts, e.event_id LIMIT 1) c ON true
    WHERE event_type = 'view')""")


def _requests(spark, folder) -> DataFrame:
    rows = _stream(spark, folder).where(C("event_type").isin("view", "click")).select(
        "user_id", "ts", C("event_id").alias("seq"), F.when(C("event_type") == "view", "request").otherwise("done").alias("kind"))
    return rows


@query("r5_run_durations", """
  SELECT user_id, seq AS start_id, CASE WHEN gap <= 21600000000 THEN done_seq END AS end_id, CASE WHEN gap <= 21600000000 THEN gap END AS micros FROM answered
  WHERE gap <= 21600000000 OR seen > 21600000000""", "answered")
def run_durations(spark, folder):
    return run_available(E.answered_requests(_requests(spark, folder), "user_id", 6 * 3600)).select(
        "user_id", C("seq").alias("start_id"), C("done_seq").alias("end_id"), "micros")


@query("r6_request_timeouts", """
  SELECT user_id, seq FROM answered WHERE coalesce(gap > 21600000000, true) AND seen > 21600000000""", "answered")
def request_timeouts(spark, folder):
    return run_available(E.request_timeouts(_requests(spark, folder), "user_id", 6 * 3600))


#: Requests as above, but an event counts only once the watermark (the latest event less an hour) has passed
#: its millisecond: `until` is the answer, `edge` the last millisecond that counts.
block("timed", """
  SELECT *, (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events WHERE event_type IN ('view', 'click')) AS edge FROM (
    SELECT user_id, event_id AS seq, epoch_us(ts) AS since, c.until, c.id AS done_seq FROM events v LEFT JOIN LATERAL (
      SELECT epoch_us(e.ts) AS until, e.event_id AS id FROM events e WHERE e.user_id = v.user_id AND e.event_type = 'click'
        AND (e.ts > v.ts OR e.ts = v.ts AND e.event_id > v.event_id) ORDER BY e.ts, e.event_id LIMIT 1) c ON true
    WHERE event_type = 'view')""")


@query("r5_timed_durations", """
  SELECT user_id, seq AS start_id, done_seq AS end_id, until - since AS micros FROM timed WHERE until - since <= 21600000000 AND until // 1000 <= edge""", "timed")
def timed_durations(spark, folder):
    return run_available(timed_requests(_requests(spark, folder), "user_id", 6 * 3600)).where("done_seq IS NOT NULL").select(
        "user_id", C("seq").alias("start_id"), C("done_seq").alias("end_id"), "micros")


@query("r6_timed_timeouts", """
  SELECT user_id, seq FROM timed WHERE (until IS NULL OR until - since > 21600000000) AND (since + 21600000000) // 1000 + 1 <= edge""", "timed")
def timed_timeouts(spark, folder):
    return run_available(timed_requests(_requests(spark, folder), "user_id", 6 * 3600)).where("done_seq IS NULL").select("user_id", "seq")


#: Events in four parts by number; every fiftieth comes a part later, and every 211th is a line cut short.
block("parted", """
  SELECT *, event_id * 4 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END AS part, event_id % 211 = 5 AS cut FROM events""")


def _parts(spark, folder):
    """The table's events as lines of JSON in the shared folder, one part after another: yields
    the folder of the lines each time a part has come."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] or 0
    part = F.expr(f"event_id * 4 div {last + 1} + if(event_id % 50 = 7, 1, 0)")
    whole = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.lit("INFO").alias("level"), F.lit("events").alias("logger"),
                               C("event_type").alias("msg"), "event_id", "user_id"))
    lines = events.select(part.alias("part"), F.when(C("event_id") % 211 == 5, F.concat(F.lit('{"ts": '), C("event_id").cast("string"))).otherwise(whole).alias("value"))
    root = work_folder(events)
    for k in range(5):
        lines.where(C("part") == k).select("value").write.text(f"{root}/part={k}")
        yield root


def _field(name: str):
    return F.try_variant_get("fields", f"$.{name}", "bigint").alias(name)


@query("r1_json_lines", """
  SELECT CASE WHEN NOT cut THEN event_id END AS event_id, CASE WHEN NOT cut THEN user_id END AS user_id, CASE WHEN NOT cut THEN event_type END AS event_type,
    CASE WHEN NOT cut THEN epoch_us(ts) END AS at, CASE WHEN cut THEN '{"ts": ' || event_id END AS line FROM parted""", "parted")
def json_lines(spark, folder):
    """Lines that arrive in five parts, each read by a run of its own that goes on where the last one stopped."""
    work = work_folder(spark.range(0))
    for root in _parts(spark, folder):
        good, bad = ingest_lines(stream_lines(spark, root), work)
    return good.select(_field("event_id"), _field("user_id"), C("msg").alias("event_type"), _micros("ts").alias("at"), F.lit(None).cast("string").alias("line")).unionByName(
        bad, allowMissingColumns=True)


@query("r3_late_counts", """
  SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start, event_type, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM (
    SELECT *, coalesce(epoch_us(time_bucket(INTERVAL '1 day', ts)) + 86400000000 <= mark, false) AS late FROM parted JOIN (
      SELECT part, max(top) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS mark FROM (
        SELECT part, max(epoch_us(ts)) AS top FROM parted WHERE NOT cut GROUP BY part)) USING (part) WHERE NOT cut) GROUP BY ALL""", "parted")
def late_rows(spark, folder):
    work = work_folder(spark.range(0))
    for root in _parts(spark, folder):
        lines = stream_lines(spark, root)
        out = late_counts(event_fields(lines).select("ts", C("msg").alias("event_type")), ["event_type"], folder=work)
    return out.select(_micros("start").alias("start"), "event_type", "n", "late")
