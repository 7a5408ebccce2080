"""Lines, late rows and timed requests, fed in several steps and taken up again."""

import datetime as dt
import json
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from cuegrid.catalog import check, load
from cuegrid.sources.logs import event_fields
from cuegrid.streaming import events as E, requests
from cuegrid.streaming.ingest import ingest, late_counts, stream_lines
from cuegrid.streaming.requests import timed_requests
from cuegrid.streaming.run import run_available

BASE = dt.datetime(2024, 1, 1)
MINUTE = 60_000_000


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def line(minutes, **fields):
    return json.dumps({"ts": at(minutes).isoformat() + "Z", "level": "INFO", "logger": "run", "msg": "m", **fields})


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_lines_and_bad_lines(spark, tmp_path):
    source, work = tmp_path / "in", str(tmp_path / "work")
    bad = ["not json", '{"ts": 1', "[1, 2]", '{"msg": "no time"}', '{"ts": "when"}']
    write(source, "a.log", [line(1, scene="s1"), bad[0], line(2, count=3), bad[1]])
    good, wrong = ingest(stream_lines(spark, str(source)), work)
    assert good.count() == 2 and sorted(r.line for r in wrong.collect()) == sorted(bad[:2])
    write(source, "b.log", [*bad[2:], line(3, scene={"deep": [1, 2]}), ""])
    good, wrong = ingest(stream_lines(spark, str(source)), work)
    got = good.select("ts", "level", "logger", "msg", F.to_json("fields").alias("doc")).orderBy("ts").collect()
    assert [(r.ts, r.level, r.logger, r.msg) for r in got] == [(at(k), "INFO", "run", "m") for k in (1, 2, 3)]
    assert json.loads(got[2].doc)["scene"] == {"deep": [1, 2]} and json.loads(got[1].doc)["count"] == 3
    assert sorted(r.line.replace(" ", "").replace(":", ": ") for r in wrong.collect()) == sorted(b.replace(" ", "").replace(":", ": ") for b in [*bad, ""])
    good, wrong = ingest(stream_lines(spark, str(source)), work)  # nothing new
    assert good.count() == 3 and wrong.count() == 6


def test_late_rows_are_counted(spark, tmp_path):
    source, work = tmp_path / "in", str(tmp_path / "work")

    def go():
        rows = event_fields(stream_lines(spark, str(source))).select("ts", F.try_variant_get("fields", "$.who", "string").alias("who"))
        return sorted((tuple(r) for r in late_counts(rows, ["who"], "10 minutes", 300, folder=work).collect()), key=str)

    write(source, "a.log", [line(1, who="a"), line(2, who="a"), line(14, who="b"), "broken"])
    assert go() == [(at(0), "a", 2, 0), (at(10), "b", 1, 0)]
    # up to 14 with 5 minutes' delay: nothing is closed, so 1 is in time
    write(source, "b.log", [line(1, who="a"), line(16, who="b")])
    assert go() == [(at(0), "a", 3, 0), (at(10), "b", 2, 0)]
    # up to 16: the window to 10 is closed
    write(source, "c.log", [line(3, who="a"), line(9, who="a"), line(11, who="b"), line(2)])
    assert go() == sorted([(at(0), "a", 3, 2), (at(0), None, 0, 1), (at(10), "b", 3, 0)], key=str)


def answers(rows, deadline_s, edge):
    """Of rows (key, at in microseconds, seq, kind), what a watermark at `edge` (milliseconds) has settled."""
    out = []
    for key, since, seq, kind in rows:
        if kind != "request":
            continue
        behind = sorted((a, s) for k, a, s, what in rows if k == key and what == "done" and (a, s) > (since, seq))
        most = deadline_s * 1_000_000
        if behind and behind[0][0] - since <= most:
            if behind[0][0] // 1000 <= edge:
                out.append((key, seq, behind[0][1], behind[0][0] - since))
        elif (since + most) // 1000 + 1 <= edge:
            out.append((key, seq, None, None))
    return sorted(out, key=str)


def test_timed_requests_in_any_order_of_arrival(spark, tmp_path):
    schema = "user string, ts timestamp, seq long, kind string"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    chosen = random.Random(8)
    start = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    rows = [(chosen.choice(["u", "v", "w"]), start + (k // 2) * 40_000_000 + chosen.choice([0, 300, 1500]), k, chosen.choice(["request", "request", "done"])) for k in range(150)]
    told, edge = [], 0
    for a, b in ((0, 60), (60, 61), (61, 150)):  # a restart from the checkpoint after each
        part = rows[a:b]
        chosen.shuffle(part)
        spark.createDataFrame([(u, dt.datetime.fromtimestamp(t / 1e6, dt.timezone.utc).replace(tzinfo=None), k, what) for u, t, k, what in part], schema).repartition(3).write.mode(
            "append").parquet(source)
        stream = E.with_event_time(spark.readStream.schema(schema).parquet(source), delay="5 minutes")
        got = run_available(timed_requests(stream, "user", 120), folder=work)
        told += part
        edge = max(t for _, t, _, _ in told) // 1000 - 300_000
        assert sorted(map(tuple, got.collect()), key=str) == answers(told, 120, edge)


class Store:
    """A key's states and timers, counting what is asked of them."""

    def __init__(self):
        self.calls, self.timers, self.map, self.value = 0, set(), {}, None

    def __getattr__(self, name):
        self.calls += 1
        return {"getMapState": lambda *_: self, "getValueState": lambda *_: self, "registerTimer": self.timers.add, "containsKey": self.map.__contains__,
                "keys": lambda: iter(list(self.map)), "getValue": self.map.get, "updateValue": self.map.__setitem__, "removeKey": self.map.pop,
                "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None)}[name]


def test_timed_requests_ask_the_store_by_blocks(monkeypatch):
    monkeypatch.setattr(requests, "RUN", 40)
    monkeypatch.setattr(requests, "BLOCK", 10)
    chosen = random.Random(3)
    rows = [("u", 10**12 + (k // 3) * 9_000_000 + chosen.choice([0, 300, 1500]), k, chosen.choice(["request", "request", "done"])) for k in range(400)]
    rows += rows[300:340]  # the same event twice is one
    got, told, edge, store = [], [], 0, Store()
    watch = requests.Requests(120)
    watch.init(store)
    for n, (a, b) in enumerate(((0, 150), (150, 151), (151, 440))):
        part = rows[a:b]
        chosen.shuffle(part)
        part = [r for r in part if r[1] // 1000 > edge]  # the others are dropped on arrival
        told, edge = told + part, max([edge, *(t // 1000 - 300_000 for _, t, _, _ in part)])
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: edge)
        list(watch.handleInputRows(("u",), iter([{"at": t, "seq": s, "done": what == "done"} for _, t, s, what in part]), times))
        while due := [t for t in store.timers if t <= edge]:
            store.timers.remove(min(due))
            got += [(r.key, r.seq, r.done_seq, r.micros) for r in watch.handleExpiredTimer(("u",), times, None)]
        assert sorted(got, key=str) == answers(sorted(set(told)), 120, edge), n
    assert store.calls < len(rows)  # fewer than events


def test_new_stream_queries(spark):
    queries, oracles = load()
    folder = "/root/testdata/sf0.001"
    duck = check.connect(folder)
    for name in ("a8_channel_stats", "w15_quota_stop", "r1_json_lines", "r3_late_counts", "r4_quota_alarms", "r5_timed_durations", "r6_timed_timeouts"):
        out = queries[name](spark, folder)
        cur = duck.execute(oracles[name])
        assert check.compare([tuple(r) for r in out.collect()], out.columns, cur.fetchall(), [d[0] for d in cur.description]) == "", name
    late = queries["r3_late_counts"](spark, folder)
    assert late.agg(F.sum("late")).first()[0] > 0
