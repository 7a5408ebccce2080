"""Vectorised access to the texts of Arrow batches: bounded slices, word bounds, word names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once. A longer text makes a slice of its own.
SLICE_BYTES = 1 << 19

_MASK = (1 << 64) - 1
#: Names of spans are polynomials modulo two primes, with a base for each; two families of them
#: have nothing in common. Modulo a power of two, whole families of texts would share a name.
_FAMILIES = (((2147483647, 1103515245), (2147483629, 1664525019)), ((2147483587, 1812433253), (2147483579, 1597334677)))
#: Words longer than this are named by BLAKE2, shorter ones eight bytes at a time.
_LONG = 256

#: White space between words: space and the controls 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = np.asarray(x, dtype=np.uint64) + np.uint64((salt * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 4096


class _Powers:
    """Powers of a base modulo a prime, from two small tables however far they go."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime = base, prime
        self.near = self._table(base, _STEP)
        self.far = np.ones(1, np.uint64)

    def _table(self, base: int, n: int) -> np.ndarray:
        out, now = np.empty(n, np.uint64), 1
        for k in range(n):
            out[k] = now
            now = now * base % self.prime
        return out

    def __call__(self, k: np.ndarray) -> np.ndarray:
        last = int(k.max(initial=0)) // _STEP
        if len(self.far) <= last:
            self.far = self._table(pow(self.base, _STEP, self.prime), 2 * last + 1)
        return self.near[k % _STEP] * self.far[k // _STEP] % np.uint64(self.prime)


_POWERS = [[(_Powers(b, p), _Powers(pow(b, -1, p), p), np.uint64(p)) for p, b in family] for family in _FAMILIES]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that none holds much more than `most` bytes of column `name`."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(parts)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text in them); a null text is empty."""
    plain = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    if not len(plain):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset:plain.offset + len(plain) + 1]
    raw = plain.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds [start, end) of the words of all texts, and how many words precede each text's
    first (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    fresh = np.ones(len(data) + 1, dtype=bool)  # no word reaches over this byte's left edge
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets[(offsets > 0) & (offsets < len(data))]] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    last = np.ones(len(data), dtype=bool)
    last[:-1] = fresh[1:-1] | ~inside[1:]
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def names_of_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int, family: int = 0) -> np.ndarray:
    """A 64-bit name for each span of `values` (uint64, well mixed): equal spans have equal names.
    Each half of the values goes into the polynomial of one prime; the families' names do not
    follow from one another."""
    at, length = np.arange(len(values)), (ends - starts).astype(np.uint64)
    parts = []
    for half, (up, down, prime) in zip((values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)), _POWERS[family]):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(half % prime * up(at) % prime, out=sums[1:], dtype=np.uint64)
        parts.append((sums[ends] - sums[starts]) % prime * down(starts) % prime)
    return mixed((parts[0] << np.uint64(31) | parts[1]) ^ mixed(length, salt + 64), salt)


class Eights:
    """The bytes of spans, eight at a time."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[:len(data)] = data
        self.view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        self.starts, self.length = starts, ends - starts

    def at(self, spans: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 8 of the given spans, zeros behind their ends."""
        left = np.minimum(self.length[spans] - 8 * k, 8)
        return self.view[self.starts[spans] + 8 * k].astype(np.uint64) & _FIRST_BYTES[left]


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 1) -> np.ndarray:
    """A 64-bit name for each short span of bytes. Eight bytes at a time go through a scrambling that
    is no polynomial, so no family of words shares a name."""
    length = (ends - starts).astype(np.int64)
    names = mixed(length.astype(np.uint64), salt)
    eights = Eights(data, starts, ends)
    on, k = np.flatnonzero((length > 0) & (length <= _LONG)), 0
    while len(on):
        names[on] = mixed(names[on] ^ eights.at(on, k), salt + 32)
        k += 1
        on = on[length[on] > 8 * k]
    for w in np.flatnonzero(length > _LONG).tolist():
        told = hashlib.blake2b(data[starts[w]:ends[w]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little"))
        names[w] = int.from_bytes(told.digest(), "little")
    return names


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's bytes, the first span with each number). Spans are grouped by name and
    then compared byte by byte with their group's first."""
    codes, names = pd.factorize(word_names(data, starts, ends))
    first = np.empty(len(names), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]  # the earliest span is written last
    like = first[codes]
    own, other = Eights(data, starts, ends), Eights(data, starts[like], ends[like])
    same, on, k = np.array_equal(own.length, other.length), np.flatnonzero(np.arange(len(like)) != like), 0
    while same and len(on):
        same = np.array_equal(own.at(on, k), other.at(on, k))
        k += 1
        on = on[own.length[on] > 8 * k]
    if not same:  # two unlike spans of one name: group by the bytes themselves
        codes, _ = pd.factorize(np.array([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], object))
        first = np.empty(codes.max() + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first
