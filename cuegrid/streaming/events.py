"""Run events as streams: counts, states, durations, timeouts.

Each function takes and returns a (streaming or batch) DataFrame; the caller starts the
query. Events later than the watermark are dropped by the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "1 hour"


def with_event_time(events: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Event time as TIMESTAMP (the zone-less type is refused by watermarks) plus watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, delay) if rows.isStreaming else rows


def windowed_counts(events: DataFrame, keys: list[str], width: str = "1 day", ts: str = "ts") -> DataFrame:
    """Events per key and tumbling window."""
    return events.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), *keys, "n")


def latest_states(events: DataFrame, keys: list[str], status: str = "status", ts: str = "ts",
                  seq: str = "seq") -> DataFrame:
    """Last status per key by (time, sequence): a status may go back, so the latest wins, not
    the furthest. A streaming query keeps one small row of state per key (update mode)."""
    place = F.struct(F.col(ts), F.col(seq))
    return events.groupBy(*keys).agg(F.max_by(status, place).alias(status), F.max(place).alias("_at")).select(
        *keys, status, F.col(f"_at.{ts}").alias(ts), F.col(f"_at.{seq}").alias(seq))


def answered_requests(events: DataFrame, key: str, deadline_s: int) -> DataFrame:
    """events(key, ts, seq, kind 'request'|'done') -> (key, seq, done_seq, micros): each request with
    the first 'done' of its key behind it (by time, then seq), or with nulls once its own deadline
    has passed without one, by event time. State is the key's open requests, each with its time; the
    deadline bounds how long one stays there."""
    kind = events.schema[key].dataType.simpleString()
    most = deadline_s * 1_000_000

    def watch(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get)] if state.exists else []
        out: list[tuple[int, int | None, int | None]] = []

        def expire(now: int) -> None:
            nonlocal held
            out.extend((seq, None, None) for seq, at in held if now - at > most)
            held = [x for x in held if now - x[1] <= most]

        rows = pd.concat(list(frames)).sort_values(["ts", "seq"]) if not state.hasTimedOut else pd.DataFrame()
        if len(rows):
            for ts, seq, what in zip(rows["ts"], rows["seq"], rows["kind"]):
                at = int(ts.value // 1000)
                expire(at)
                if what == "done":
                    out.extend((s, int(seq), at - t) for s, t in held)
                    held = []
                else:
                    held.append((int(seq), at))
        expire(state.getCurrentWatermarkMs() * 1000)
        if held:
            state.update(([s for s, _ in held], [t for _, t in held]))
            # the first millisecond at which the oldest is late, by the watermark
            state.setTimeoutTimestamp(max((min(t for _, t in held) + most) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [group[0]] * len(out), "seq": [x[0] for x in out], "done_seq": pd.array([x[1] for x in out], "Int64"),
                            "micros": pd.array([x[2] for x in out], "Int64")})

    return events.select(key, "ts", "seq", "kind").groupBy(key).applyInPandasWithState(
        watch, f"{key} {kind}, seq long, done_seq long, micros long", "seqs array<long>, since array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def request_timeouts(events: DataFrame, key: str, deadline_s: int = 3600) -> DataFrame:
    """(key, seq) of every request that nothing answered within its deadline."""
    return answered_requests(events, key, deadline_s).where("done_seq IS NULL").select(key, "seq")
