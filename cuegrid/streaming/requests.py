"""Requests, their answers and their deadlines, by event-time timers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps maps and timers outside the heap.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Events of one key that are sorted in memory at once, and events in one block of the waiting ones.
RUN, BLOCK = 8192, 512


class Requests(StatefulProcessor):
    """Events of one key in order of event time, however they arrive.

    Arriving events are sorted in runs of `RUN` at most, and wait in a map as blocks of `BLOCK`, each under its
    first time, until the watermark passes them. One timer a key then hands over all that is due, merging
    the blocks: a request opens, an answer takes all that are open, and a request whose deadline the
    events or the watermark have left behind is late. State is read and written once a block, not once an
    event. Held in memory are the blocks that overlap (one of each run at most) and a key's open requests."""

    def __init__(self, deadline_s: int):
        self.most = deadline_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, n int", "events array<struct<at:bigint,seq:bigint,done:boolean>>")
        self.open = handle.getValueState("open", "requests array<struct<at:bigint,seq:bigint>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = ((row["at"], row["seq"], row["done"]) for row in rows)
        first = None
        while run := sorted(islice(events, RUN)):
            self._wait(run)
            first = run[0][0] if first is None else min(first, run[0][0])
        if first is not None:  # an event that is due already is settled by this micro-batch's timers
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        kept = self.open.get()
        before = [(r[0], r[1]) for r in kept[0]] if kept else []
        held = deque(before)  # in order of time
        for at, seq, done in self._due(now):
            # requests whose deadline ended before this millisecond are late whatever happens in it
            yield from self._late(key, held, at // 1000)
            if not done:
                if not held or held[-1] != (at, seq):  # a repeated request is one
                    held.append((at, seq))
                continue
            for since, number in held:
                on_time = at - since <= self.most
                yield Row(key=key[0], seq=number, done_seq=seq if on_time else None, micros=at - since if on_time else None)
            held.clear()
        yield from self._late(key, held, now)
        if held:
            if list(held) != before:
                self.open.update((list(held),))
            self.handle.registerTimer(self._late_ms(held[0][0]))
        elif before:
            self.open.clear()

    def _wait(self, events: list[tuple]) -> None:
        """Keep sorted events in blocks. Two blocks may begin alike, so they are numbered."""
        for k in range(0, len(events), BLOCK):
            first, n = events[k][0], 0
            while self.waiting.containsKey((first, n)):
                n += 1
            self.waiting.updateValue((first, n), (events[k:k + BLOCK],))

    def _due(self, now: int) -> Iterator[tuple]:
        """Take the events up to millisecond `now` out of the waiting ones, in order."""
        blocks = sorted((k[0], k[1]) for k in self.waiting.keys())
        ready = [b for b in blocks if b[0] // 1000 <= now]
        rest, heap = [b[0] for b in blocks[len(ready):len(ready) + 1]], []
        for k, block in enumerate(ready):
            later = []
            for e in self.waiting.getValue(block)[0]:
                at, seq, done = e[0], e[1], e[2]
                if at // 1000 <= now:
                    heappush(heap, (at, seq, done))
                else:
                    later.append((at, seq, done))
            self.waiting.removeKey(block)
            if later:
                self._wait(later)
                rest.append(later[0][0])
            # what lies before the next block's first event is complete
            while heap and (k + 1 == len(ready) or heap[0][0] < ready[k + 1][0]):
                yield heappop(heap)
        if rest:
            self.handle.registerTimer(min(rest) // 1000)

    def _late_ms(self, at: int) -> int:
        """The first millisecond that lies wholly behind the deadline of a request."""
        return (at + self.most) // 1000 + 1

    def _late(self, key, held: deque, ms: int) -> Iterator[Row]:
        """Take the requests out of `held` that are late in millisecond `ms`."""
        while held and self._late_ms(held[0][0]) <= ms:
            yield Row(key=key[0], seq=held.popleft()[1], done_seq=None, micros=None)

    def close(self) -> None:
        pass


def timed_requests(events: DataFrame, key: str, deadline_s: int) -> DataFrame:
    """A stream events(key, ts, seq, kind 'request'|'done') with a watermark on ts -> (key, seq,
    done_seq, micros): every request with the first 'done' of its key behind it (by time, then seq),
    or with nulls if that is later than its deadline or has not come within it.

    Events count once the watermark has passed them, so answers come in order of event time
    whatever the order of arrival, and what is behind the watermark on arrival is dropped. State
    is the events ahead of the watermark and the requests within their deadline; both lie in the
    state store, and one key's open requests and overlapping blocks of events are in memory at once."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("at"), "seq", (F.col("kind") == "done").alias("done"))
    found = rows.groupBy("key").transformWithState(
        statefulProcessor=Requests(deadline_s), outputStructType=f"key {kind}, seq long, done_seq long, micros long", outputMode="Append", timeMode="EventTime")
    return found.withColumnRenamed("key", key)
