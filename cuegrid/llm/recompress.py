"""Substring dedup by recompression: equal word sequences get equal interior symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column, mixed, names_of_spans, signed, slices, text_bytes, word_bounds, word_names
from cuegrid.llm.lineage import settled

#: Rounds of naming pairs, after one of naming runs of words. Nine windows of ten hold a symbol of
#: the last round that their own words settle; for the others it is one of the round before.
ROUNDS = 8
_FAR = np.int64(1) << 40
#: Odd multipliers: which side a symbol takes in each round, and the two places of a pair.
_SIDES = mixed(np.arange(64, dtype=np.uint64), 5) | np.uint64(1)
_FORE, _HIND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: A place in a text: a count of windows above 32 bits of the first.
_COUNT = 255
_ANCHORS = "symbol long, region long, doc_id long, text_hash long, place long"
_WINDOWS = "window long, check long, doc_id long, text_hash long, place long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Symbols:
    """Symbols of one level over the words of several texts, left to right.

    name: what the symbol stands for; first, last: its words [first, last); low, high: the words
    [low, high) that settle that it stands here. Whatever text holds those words has this symbol at
    this place, whatever surrounds them; at a text's edge nothing more is known, so the bound there
    is far away."""

    def __init__(self, name, first, last, low, high, text):
        self.name, self.first, self.last, self.low, self.high, self.text = name, first, last, low, high, text

    @classmethod
    def of_words(cls, names: np.ndarray, text: np.ndarray) -> Symbols:
        at = np.arange(len(names))
        return cls(names, at, at + 1, at.copy(), at + 1, text)

    def _next(self) -> np.ndarray:
        """Whether each symbol and the one after it belong to one text."""
        return self.text[:-1] == self.text[1:]

    def runs(self) -> Symbols:
        """Name maximal runs of one symbol. Both neighbours settle where a run ends."""
        n = len(self.name)
        if n < 2:
            return self
        joined = self._next()
        same = joined & (self.name[:-1] == self.name[1:])
        head = np.flatnonzero(np.r_[True, ~same])
        tail = np.r_[head[1:], n] - 1
        long = tail - head
        name = self.name[head]
        name = np.where(long > 0, mixed(name + mixed(long.astype(np.uint64), 11), 12), name)
        low = np.where(np.r_[False, joined][head], self.low[np.maximum(head - 1, 0)], -_FAR)
        high = np.where(np.r_[joined, False][tail], self.high[np.minimum(tail + 1, n - 1)], _FAR)
        return Symbols(name, self.first[head], self.last[tail], np.minimum(low, self.low[head]), np.maximum(high, self.high[tail]), self.text[head])

    def pairs(self, salt: int) -> Symbols:
        """Name pairs of a left symbol and a right one; a symbol's name says which it is. A left
        symbol that stays alone is settled by the one after it, a right one by the one before."""
        n = len(self.name)
        if n < 2:
            return self
        left = (self.name * _SIDES[salt]) >= np.uint64(1 << 63)
        joined = self._next()
        begins = np.zeros(n, bool)
        begins[:-1] = joined & left[:-1] & ~left[1:]
        ends = np.r_[False, begins[:-1]]
        after = np.full(n, _FAR)
        after[:-1][joined] = self.high[1:][joined]
        before = np.full(n, -_FAR)
        before[1:][joined] = self.low[:-1][joined]
        low = np.where(left, self.low, np.minimum(self.low, before))
        high = np.where(left, np.maximum(self.high, after), self.high)
        b = np.flatnonzero(begins)
        name, last = self.name.copy(), self.last.copy()
        name[b] = mixed(self.name[b] * _FORE + self.name[b + 1] * _HIND, 14)
        last[b] = self.last[b + 1]
        low[b], high[b] = np.minimum(self.low[b], self.low[b + 1]), np.maximum(self.high[b], self.high[b + 1])
        keep = ~ends
        return Symbols(name[keep], self.first[keep], last[keep], low[keep], high[keep], self.text[keep])


def levels(names: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> Iterator[Symbols]:
    """The symbols after the runs and after each round of pairs."""
    now = Symbols.of_words(names, text).runs()
    yield now
    for r in range(rounds):
        now = now.pairs(r)
        yield now


class Texts:
    """Words of a slice of documents: two names that do not follow from one another, the text of each,
    and each text's first word."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(column(batch, "text"))
        starts, ends, self.firsts = word_bounds(data, offsets)
        self.names, self.others = word_names(data, starts, ends, 1), word_names(data, starts, ends, 2)
        self.text = np.repeat(np.arange(batch.num_rows), np.diff(self.firsts))
        self.doc_ids = column(batch, "doc_id").to_numpy()
        self.hashes = column(batch, "text_hash").to_numpy()

    def places(self, first: np.ndarray, count: np.ndarray) -> dict[str, pa.Array]:
        """Which text so many windows from `first` on belong to, and where they begin in it."""
        text = self.text[first]
        return {"doc_id": pa.array(self.doc_ids[text]), "text_hash": pa.array(self.hashes[text]),
                "place": pa.array(count.astype(np.int64) << 32 | (first - self.firsts[text]))}


def count_of(place):
    return place >> 32 & 0xFF


def first_of(place):
    return place & 0xFFFFFFFF


def _anchors(window: int, rounds: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            t = Texts(batch)
            n = len(t.names)
            if n < window:
                continue
            windows = np.flatnonzero(t.text[:n - window + 1] == t.text[window - 1:])
            if not len(windows):
                continue
            rounds_done = list(levels(t.names, t.text, rounds))
            key, anchor = np.zeros(len(windows), np.uint64), np.full(len(windows), -1)
            known = np.zeros(len(windows), bool)
            for level in rounds_done[:-3:-1]:
                # the first symbol that a window's own words settle
                ahead = np.maximum.accumulate(level.low)
                at = np.minimum(np.searchsorted(ahead, windows), len(ahead) - 1)
                fits = ~known & (level.low[at] >= windows) & (level.high[at] <= windows + window)
                used, back = np.unique(at[fits], return_inverse=True)
                key[fits] = (names_of_spans(t.names, level.low[used], level.high[used], 21) + level.name[used])[back]
                anchor[fits] = level.first[at[fits]]
                known |= fits
            rest = windows[~known]  # inside long repetitions: the window itself is the symbol
            key[~known] = names_of_spans(t.names, rest, rest + window, 22)
            # neighbouring windows with one symbol make one row
            cut = np.r_[True, (key[1:] != key[:-1]) | (windows[1:] != windows[:-1] + 1)]
            head = np.flatnonzero(cut)
            within = np.arange(len(windows)) - np.repeat(head, np.diff(np.r_[head, len(windows)]))
            head = np.flatnonzero(within % _COUNT == 0)
            count = np.diff(np.r_[head, len(windows)])
            first = windows[head]
            offset = np.where(known[head], anchor[head] - first, -1)
            region = mixed(names_of_spans(t.others, first, first + count + window - 1, 23, family=1) + offset.astype(np.int64).view(np.uint64), 24)
            yield pa.record_batch({
                "symbol": pa.array(signed(key[head])), "region": pa.array(signed(region)), **t.places(first, count)})

    return anchors


def _windows(window: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            batch = batch.filter(pc.is_valid(column(batch, "places")))
            if not batch.num_rows:
                continue
            t = Texts(batch)
            lists = column(batch, "places")
            places = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            count = (count_of(places)).astype(np.int64)
            first = first_of(places).astype(np.int64) + t.firsts[owner]
            at = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            yield pa.record_batch({
                "window": pa.array(signed(names_of_spans(t.names, at, at + window, 25))),
                "check": pa.array(signed(names_of_spans(t.others, at, at + window, 27, family=1))), **t.places(at, np.ones(len(at), np.int64))})

    return windows


def _kept(window: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            totals, removed, sums, texts = [], [], [], []
            for text, places in zip(column(batch, "text").to_pylist(), column(batch, "places").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                stay = remaining(words, places or (), window)
                totals.append(len(words))
                removed.append(len(words) - len(stay))
                texts.append(b" ".join(stay))
                sums.append(hashlib.sha256(texts[-1]).hexdigest())
            out = {"n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string()),
                   "kept": pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())}
            others = {f.name: batch.column(k) for k, f in enumerate(batch.schema) if f.name not in (*_SCRATCH, *out)}
            yield pa.record_batch(others | out)

    return kept


def remaining(words: list, places, window: int) -> list:
    """The words that no repeated window covers."""
    if not places:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    p = np.array(places, np.int64)
    first = first_of(p)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count_of(p) + window - 1, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return [words[k] for k in np.flatnonzero(~covered).tolist()]


def dedup(docs: DataFrame, window: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """`docs` with what is left of each text once repeated windows are gone.

    Words are maximal runs of characters other than space and controls 9 to 13. A window is `window`
    words of one text in a row. A word goes if some window over it also starts in a document with a
    smaller doc_id, in the input.

    Rounds name runs of words and then pairs of symbols over the whole corpus. A name is a 64-bit
    hash of what it stands for, so equal parts get equal names everywhere and no dictionary has to
    travel. A window is represented by the first symbol that its own words settle (with the words
    that settle it), hence by the same one wherever the window stands; neighbouring windows share
    it. One shuffle finds the symbols seen in several documents. Their regions (all words of the
    windows they stand for) are named as well: where a smaller document has the same region, all its
    windows are repeated; where only the symbol is shared, the windows themselves are compared, by
    two names together. All counts and joins are combined before shuffling or can be split by Spark
    where one passage is very common; no group is gathered, except the places of one text. A text
    is known by its doc_id and a 64-bit hash, so unlike texts of one doc_id stay apart.

    Adds n_words, n_removed, kept_sha256, kept (the words left, joined by one space); keeps other
    columns, but for those with these names or those of the scratch columns in `_SCRATCH`. Null or empty text: no words. A null doc_id is not smaller than any and nothing is
    removed from it. Rows with one doc_id do not affect one another. Empty tables give no rows."""
    keyed = docs.drop(*_ADDED, *_SCRATCH).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    light = keyed.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "text_hash")
    anchors = light.mapInArrow(_anchors(window, rounds), _ANCHORS)
    shared = anchors.groupBy("symbol").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("symbol")
    repeated = settled(anchors.join(shared, "symbol"))
    # what joins rows by their own key is written first, so that nothing but a shuffle lies below the join and Spark can split a hot key
    regions = settled(repeated.groupBy("symbol", "region").agg(F.min("doc_id").alias("source")))
    marked = repeated.join(regions, ["symbol", "region"])
    whole = marked.where("doc_id > source").select(*_PLACE)
    several = settled(regions.groupBy("symbol").agg(F.count("*").alias("n")).where("n > 1").select("symbol"))
    partly = marked.where("doc_id = source").join(several, "symbol").select(*_PLACE)
    texts = lambda places: keyed.join(_lists(places), ["doc_id", "text_hash"], "left")
    singles = settled(texts(partly).mapInArrow(_windows(window), _WINDOWS))
    origins = settled(singles.groupBy("window", "check").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last"))
    single = singles.join(origins, ["window", "check"]).where("doc_id > source").select(*_PLACE)
    joined = texts(whole.unionByName(single))
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name not in _SCRATCH)
    return joined.mapInArrow(_kept(window), f"{others}, n_words long, n_removed long, kept_sha256 string, kept string")


_PLACE = ("doc_id", "text_hash", "place")
_SCRATCH = ("places", "text_hash")
_ADDED = ("n_words", "n_removed", "kept_sha256", "kept")


def _lists(places: DataFrame) -> DataFrame:
    """The places of each text; their number is bounded by the text's words."""
    return places.groupBy("doc_id", "text_hash").agg(F.collect_list("place").alias("places"))
