"""SentencePiece encoding and decoding by weighted finite-state transduction."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column, distinct_spans, slices

#: Units, and neighbouring pairs of pieces, that a worker remembers; beyond that it starts afresh.
REMEMBERED, PAIRS = 1_500_000, 800_000
SPACE = "▁"

# ---- fixed values: numbers of the model file's format ----
PIECES, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, KIND = 1, 2, 3
MODEL_TYPE, UNIGRAM, BPE = 3, 1, 2
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
# ---- end of fixed values ----


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        elif kind == 2:
            size, at = _number(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class Transducer:
    """The composition of normaliser, pieces and byte fallback, for one model file.

    A state is the piece read last; an arc reads a piece's characters, writes its id and weighs, in
    the tropical semiring (weights add along a path, the least path wins), minus the piece's score
    for a unigram model. For a BPE model it weighs nothing where the two pieces may stand side by
    side and infinity where merging would have changed them: merging depends on neighbours only, so
    the one path of finite weight is the merged sequence. Such weights are worked out when an arc is
    first met and remembered. A character without a piece reads as its bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        model, rules = UNIGRAM, {DUMMY_PREFIX: 1, REMOVE_EXTRA: 1, ESCAPE: 1, CHARSMAP: b""}
        for number, value in _fields(data):
            if number == PIECES:
                p = dict(_fields(value))
                score = struct.unpack("<f", p.get(SCORE, b"\0\0\0\0"))[0]
                self.pieces.append((p.get(TEXT, b"").decode(), score, p.get(KIND, NORMAL)))
            elif number == TRAINER:
                model = dict(_fields(value)).get(MODEL_TYPE, UNIGRAM)
            elif number == NORMALIZER:
                rules.update(dict(_fields(value)))
        if model not in (UNIGRAM, BPE) or rules[CHARSMAP] or rules[REMOVE_EXTRA] or not rules[ESCAPE]:
            raise ValueError("this transducer reads unigram and BPE models that keep text as it is but for the space mark")
        self.merges, self.prefix = model == BPE, bool(rules[DUMMY_PREFIX])
        self.ids = {t: k for k, (t, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        self.score = {t: self.pieces[k][1] for t, k in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes_of = {int(t[3:5], 16): k for k, (t, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next((k for k, (_, _, kind) in enumerate(self.pieces) if kind == UNK), 0)
        self.worst = min(self.score.values(), default=0.0) - 10.0
        # no path crosses two characters that stand side by side in no piece, so texts may be cut there;
        # for each pair of ASCII bytes (the space stands for its mark) whether some piece holds it
        self.inner = np.zeros((128, 128), bool)
        for t in self.ids:
            b = t.replace(SPACE, " ").encode()
            for x, y in zip(b, b[1:]):
                if x < 128 and y < 128:
                    self.inner[x, y] = True
        self.cuts = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        written = [bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else t.replace(SPACE, " ").encode() for t, _, kind in self.pieces]
        self.output = np.frombuffer(b"".join(written), np.uint8)
        self.output_bounds = np.concatenate([[0], np.cumsum([len(w) for w in written])])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.bounds = np.zeros(1, np.int64)
        self.known = np.zeros(0, np.uint32)

    def merged(self, text: str) -> list[str]:
        """What merging makes of `text`: again and again the pair whose union scores best, the
        leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def weight(self, before: str, piece: str) -> float:
        """Of the arc that reads `piece` in the state `before` ("" at the start)."""
        if not self.merges:
            return -self.score.get(piece, self.worst)
        pair = (before, piece)
        fits = self.pairs.get(pair)
        if fits is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            fits = self.pairs[pair] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return 0.0 if fits else float("inf")

    def shortest(self, text: str) -> list[str]:
        """Pieces along the shortest path of the text's composition with this transducer."""
        if self.merges:
            return self._merged_path(text)
        n, ids = len(text), self.ids
        # for each place and state: (weight so far, where the piece began, the state before)
        reached: list[dict[str, tuple[float, int, str]]] = [{"": (0.0, 0, "")}] + [{} for _ in range(n)]
        for end in range(1, n + 1):
            here = reached[end]
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                if piece not in ids and end - start > 1:
                    continue
                for before, (so_far, _, _) in reached[start].items():
                    total, state = so_far + self.weight(before, piece), "*"
                    if total < here.get(state, (float("inf"),))[0]:
                        here[state] = (total, start, before)
        out, end = [], n
        state = min(reached[n], key=lambda s: reached[n][s][0])
        while end:
            _, start, before = reached[end][state]
            out.append(text[start:end])
            end, state = start, before
        return out[::-1]

    def _merged_path(self, text: str) -> list[str]:
        """The same for a BPE model: at each place one state is reached with finite weight, so its
        search ends with the first arc found."""
        n, ids, pairs, longest = len(text), self.ids, self.pairs, self.longest
        state, begin = [""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                piece = text[start:end]
                if piece in ids or start == end - 1:
                    before = state[start]
                    fits = pairs.get((before, piece))
                    if fits or fits is None and self.weight(before, piece) == 0.0:
                        state[end], begin[end] = piece, start
                        break
        out, end = [], n
        while end:
            out.append(state[end])
            end = begin[end]
        return out[::-1]

    def ids_of(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.shortest(text):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes_of:
                out += [self.bytes_of[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids in them). Texts are cut into units
        where no piece can reach over the cut; each distinct unit is transduced once."""
        head = " " if self.prefix else ""
        raw = [(head + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True
        if self.cuts:  # before a space mark, whatever stands there
            space = data == 0x20
            fresh[1:-1] |= space[1:] & ~space[:-1]
        plain = data < 128
        fresh[1:-1] |= plain[:-1] & plain[1:] & ~self.inner[data[:-1] & 127, data[1:] & 127]
        starts = np.flatnonzero(fresh[:-1])
        ends = np.append(starts[1:], len(data))
        codes, first = distinct_spans(data, starts, ends)
        spelt = [joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.place) + len(spelt) > REMEMBERED:
            self.clear()
        new = [w for w in spelt if w not in self.place]
        if new:
            found = [self.ids_of(w.decode("utf-8", "surrogatepass").replace(" ", SPACE)) for w in new]
            base = len(self.bounds) - 1
            self.place.update(zip(new, range(base, base + len(new))))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in found])])
            self.known = np.concatenate([self.known, np.array([i for x in found for i in x], np.uint32)])
        place = np.array([self.place[w] for w in spelt], np.int64)[codes]
        begin, n = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        before = np.cumsum(n) - n
        ids = self.known[np.arange(int(n.sum())) + np.repeat(begin - before, n)]
        return ids, np.append(before, len(ids))[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id sequences: the inverse transduction, without the leading space mark. Bytes that
        make no character read as U+FFFD."""
        begin, n = self.output_bounds[ids], self.output_bounds[ids.astype(np.int64) + 1] - self.output_bounds[ids]
        before = np.cumsum(n) - n
        data = self.output[np.arange(int(n.sum())) + np.repeat(begin - before, n)].tobytes()
        edges = np.append(before, len(data))[offsets].tolist()
        skip = self.prefix
        return [data[a + (skip and data[a:a + 1] == b" "):b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _others(batch: pa.RecordBatch, *names: str) -> dict[str, pa.Array]:
    return {f.name: batch.column(k) for k, f in enumerate(batch.schema) if f.name not in names}


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with ids (array of int): the SentencePiece ids of the whole text, as the model file's
    own library gives them. Null and empty texts have none. One narrow pass; other columns are kept
    (an `ids` column is replaced), repeated rows and null ids are kept, empty tables stay empty.
    `path` is a model file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, offsets = transducer(path).encode(column(batch, "text").to_pylist())
            yield pa.record_batch(_others(batch) | {"ids": pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.astype(np.int32)))})

    rows = docs.drop("ids")
    return rows.mapInArrow(run, _schema(rows, "ids array<int>"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """`rows` with text from ids. Null or empty ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in column(batch, "ids").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            ids = np.array([i for x in lists for i in x], np.int64)
            yield pa.record_batch(_others(batch) | {"text": pa.array(transducer(path).decode(ids, offsets), pa.string())})

    kept = rows.drop("text")
    return kept.mapInArrow(run, _schema(kept, "text string"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """For each document the number of its ids, their CRC-32 (little-endian unsigned 32-bit) and
    whether decoding them gives the text again (a literal space mark reads as a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, machine = column(batch, "text").to_pylist(), transducer(path)
            ids, offsets = machine.encode(texts)
            raw, edges = ids.astype("<u4").tobytes(), offsets.tolist()
            back = machine.decode(ids, offsets)
            yield pa.record_batch({
                "doc_id": column(batch, "doc_id"), "n_tokens": pa.array(np.diff(offsets)),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edges, edges[1:])], pa.int64()),
                "round_trip": pa.array([b == (t or "").replace(SPACE, " ") for b, t in zip(back, texts)])})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
