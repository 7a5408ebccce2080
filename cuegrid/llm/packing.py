"""Best-fit packing: documents into sequences of bounded length, planned on a length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cuegrid.llm.arrow_text import column, distinct_spans, slices, text_bytes, word_bounds
from cuegrid.llm.lineage import settled

#: Words whose ids a worker remembers; beyond that it starts afresh.
REMEMBERED = 300_000
#: Unknown words encoded by one call.
TOGETHER = 2_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_UNPLAIN = np.zeros(256, bool)  # bytes of characters that lower case or composition may treat by context
_UNPLAIN[[ord("<"), 0xC2, *range(0xC4, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordCodec:
    """Token ids of texts, each distinct word encoded once.

    The tokenizer drops white space and cuts there before it merges, so a text's ids are those of
    its words in turn. It also cuts between a letter and a mark, so the marks after a word are a
    word of their own here; and it lowers case, so plain words are looked up in lower case."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stop = self.tokenizer.token_to_id("<|endoftext|>")
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a word
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """(bytes to look up, which belong to letters, starts, ends, how many spans precede each text's first)."""
        starts, ends, _ = word_bounds(data, offsets)
        if not len(starts):
            return data, data > 0, starts, ends, np.zeros(len(offsets), np.int64)
        lower = _LOWER[data]
        odd = np.flatnonzero(_UNPLAIN[data])
        for k in np.unique(np.searchsorted(starts, odd, side="right") - 1).tolist():
            lower[starts[k]:ends[k]] = data[starts[k]:ends[k]]
        # cut between a letter (ASCII, or one of the Latin-1 letters in two bytes) and a mark
        letter = _LETTER[data]
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[1:] |= second
        letter[:-1] |= second
        cut = np.flatnonzero(letter[:-1] & _MARK[data[1:]]) + 1
        cut = cut[~np.isin(cut, offsets)]
        begins = np.sort(np.concatenate([starts, cut]))
        finishes = np.sort(np.concatenate([ends, cut]))
        return lower, letter, begins, finishes, np.searchsorted(begins, offsets)

    def learn(self, spelt: list[bytes], simple: np.ndarray) -> None:
        """Encode words not yet known. Simple words (letters only) make one run of merges each, whose
        last token alone ends a word, so many are encoded as one text; others are set apart by a
        separator that is a token of its own, or encoded alone where they hold such a token."""
        words = [w.decode("utf-8", "surrogatepass") for w in spelt]
        counts = np.zeros(len(words), np.int64)
        order: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        for chosen, glue in ((np.flatnonzero(simple), " "), (np.flatnonzero(~simple), "<|endoftext|>")):
            alone = [k for k in chosen.tolist() if glue != " " and "<|" in words[k]]
            together = np.setdiff1d(chosen, alone) if alone else chosen
            for group in np.split(together, range(TOGETHER, len(together), TOGETHER)):
                if not len(group):
                    continue
                ids = np.array(self.tokenizer.encode(glue.join([words[k] for k in group.tolist()]), add_special_tokens=False).ids, np.uint32)
                if glue == " ":
                    last = np.flatnonzero(self.closing[ids]) + 1
                else:
                    gaps = np.flatnonzero(ids == self.stop)
                    last = np.append(gaps, len(ids)) - np.arange(len(gaps) + 1)
                    ids = np.delete(ids, gaps)
                if len(last) != len(group):
                    raise ValueError("words and their tokens do not match")
                counts[group] = np.diff(last, prepend=0)
                order.append(group)
                parts.append(ids)
            for k in alone:
                ids = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint32)
                counts[k] = len(ids)
                order.append(np.array([k]))
                parts.append(ids)
        done = np.concatenate(order)
        base = len(self.bounds) - 1
        self.place.update(zip([spelt[k] for k in done.tolist()], range(base, base + len(done))))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts[done])])
        self.ids = np.concatenate([self.ids, *parts])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids in them)."""
        data, offsets = text_bytes(texts)
        lower, letter, starts, ends, firsts = self.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, first = distinct_spans(lower, starts, ends)
        raw = lower.tobytes()
        spelt = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.place) + len(spelt) > REMEMBERED:
            self.clear()
        new = [k for k, w in enumerate(spelt) if w not in self.place]
        if new:
            at = first[new]
            others = np.concatenate([[0], np.cumsum(~letter)])
            self.learn([spelt[k] for k in new], others[starts[at]] == others[ends[at]])
        place = np.array([self.place[w] for w in spelt], np.int64)[codes]
        begin, n = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        before = np.cumsum(n) - n
        ids = self.ids[np.arange(int(n.sum())) + np.repeat(begin - before, n)]
        return ids, np.append(before, len(ids))[firsts]


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def _pieces(path: str, most: int, closing: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), codec(path)
        seen = np.zeros(most + 1, np.int64)  # pieces of each length that this task has given so far
        for batch in slices(batches, "text"):
            ids, offsets = words.encode(column(batch, "text"))
            sizes = np.diff(offsets) + 1
            per = -(-sizes // most)
            owner = np.repeat(np.arange(len(sizes)), per)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * most
            length = np.minimum(most, sizes[owner] - start)
            end_id, raw = np.array([closing], np.uint32).tobytes(), ids.astype("<u4").tobytes()
            sums = []
            for a, last, n in zip((offsets[owner] + start).tolist(), (offsets[owner + 1]).tolist(), length.tolist()):
                stop = a + n
                sums.append(zlib.crc32(raw[4 * a:4 * stop]) if stop <= last else zlib.crc32(end_id, zlib.crc32(raw[4 * a:4 * last])))
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            fresh = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(fresh, np.diff(np.r_[fresh, len(length)])) + seen[ordered]
            seen += np.bincount(length, minlength=most + 1)
            yield pa.record_batch({
                "doc_id": column(batch, "doc_id").take(pa.array(owner)), "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(sums, pa.int64()),
                "part": pa.array(np.full(len(length), part, np.int32)), "nth": pa.array(nth)})

    return pieces


def plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over how many pieces have each length.

    Rows (length, first rank, sequence, per sequence, offset): pieces of that length from that rank
    on go, so many to a sequence, into sequences numbered on from `sequence`, beginning at `offset`.
    Sequences with the same room left are kept as ranges, so the work depends on `most` only."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, how many)
    levels: list[int] = []
    rows, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                insort(levels, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            k = bisect_left(levels, length)
            if k < len(levels):
                left = levels[k]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], levels[k]
            else:
                left, first, n = most, opened, -(-todo // (most // length))
                opened += n
            per = left // length
            full = min(n, todo // per)
            rest = min(todo - full * per, per) if full < n else 0
            rows.append((length, rank, first, per, most - left))
            put(left - per * length, first, full)
            if rest:
                put(left - rest * length, first + full, 1)
            used = full + (rest > 0)
            put(left, first + used, n - used)
            rank += full * per + rest
            todo -= full * per + rest
    return rows


def _placed(rows: list[tuple[int, int, int, int, int]], most: int):
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 40
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy()
            row = table[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.record_batch({
                **{c: column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": pa.array(row[:, 2] + nth // row[:, 3]), "offset": pa.array(row[:, 4] + nth % row[:, 3] * length)})

    return place


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, closing: int = 0) -> DataFrame:
    """Token pieces of all documents and the sequence and offset each is given.

    A document is the ids of its text (null: none) and `closing`; only longer ones than `most` are
    cut. Pieces are counted by length (at most `most` numbers reach the driver); best fit plans on
    those counts; a piece takes the planned slot of its rank among the pieces of its length. Ranks
    are counted within the reading tasks and offset by the tasks' counts, so the commonest length is
    never gathered in one place. Repeated rows and null doc_ids are packed like any others; an empty
    table gives no rows; extra columns are ignored. `tokenizer` is a file that every executor has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = settled(rows.mapInArrow(_pieces(tokenizer, most, closing), _PIECES))
    tasks = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    return ranked.mapInArrow(
        _placed(plan(counts, most), most), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
