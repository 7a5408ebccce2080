"""SHA-256 over many messages at once, with states that can be kept between blocks and resumed.

A message here is a run of digests as hex text. Each is 64 bytes, exactly one block, so the
state before a child's slot is eight words and nothing is pending."""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** 3 <= x else (low, middle - 1)
    return low


#: The standard's constants: fractions of the square and cube roots of the first primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
#: A byte as the two characters of its hex text.
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint16)
#: Runs hold at most this many digests.
FAN_OUT = 8


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorbed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) each."""
    w = list(block)
    for t in range(16, 64):
        s0 = _turned(w[t - 15], 7) ^ _turned(w[t - 15], 18) ^ (w[t - 15] >> np.uint32(3))
        s1 = _turned(w[t - 2], 17) ^ _turned(w[t - 2], 19) ^ (w[t - 2] >> np.uint32(10))
        w.append(w[t - 16] + s0 + w[t - 7] + s1)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        first = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def words(digests: bytes | np.ndarray) -> np.ndarray:
    """Digests of 32 bytes in a row as words (8, n)."""
    return np.ascontiguousarray(np.frombuffer(digests, ">u4").astype(np.uint32).reshape(-1, 8).T)


def packed(digests: np.ndarray) -> bytes:
    """Words (8, n) as digests of 32 bytes in a row."""
    return digests.T.astype(">u4").tobytes()


def hex_text(digests: np.ndarray) -> list[bytes]:
    """The hex text of each digest (8, n)."""
    text = _HEX[np.frombuffer(packed(digests), np.uint8)].tobytes()
    return [text[k:k + 64] for k in range(0, len(text), 64)]


def blocks(digests: np.ndarray) -> np.ndarray:
    """The hex text of each digest (8, n) as a block (16, n)."""
    text = _HEX[np.frombuffer(packed(digests), np.uint8)]
    return np.ascontiguousarray(text.view(">u4").astype(np.uint32).reshape(-1, 16).T)


def closed(states: np.ndarray, n_digests: np.ndarray) -> np.ndarray:
    """The hashes of messages of so many digests, from the states after the last of them."""
    last = np.zeros((16, states.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[15] = n_digests.astype(np.uint32) * np.uint32(512)
    return absorbed(states, last)


class Level:
    """The nodes of one level, in runs of eight, and for each its parent's state before its slot."""

    def __init__(self, nodes: np.ndarray):
        n = nodes.shape[1]
        self.nodes, self.blocks = nodes, blocks(nodes)
        self.slots = np.arange(n) % FAN_OUT
        self.sizes = np.minimum(FAN_OUT, n - np.arange(0, n, FAN_OUT))  # of each run
        self.before = np.zeros((8, n), np.uint32)
        state = np.repeat(START[:, None], len(self.sizes), axis=1)
        for slot in range(FAN_OUT):
            at = np.flatnonzero(self.sizes > slot)
            children = at * FAN_OUT + slot
            self.before[:, children] = state[:, at]
            state[:, at] = absorbed(state[:, at], self.blocks[:, children])
        self.parents = closed(state, self.sizes)

    def folded(self, own: np.ndarray, replacement: np.ndarray) -> np.ndarray:
        """The parents' hashes where node own[i] is replacement[:, i]: each resumes the state
        before its slot, and takes the replacement and the siblings to its right."""
        run, slot = own // FAN_OUT, self.slots[own]
        size = self.sizes[run]
        state = absorbed(self.before[:, own], blocks(replacement))
        for s in range(1, FAN_OUT):
            at = np.flatnonzero((slot < s) & (size > s))
            if len(at):
                state[:, at] = absorbed(state[:, at], self.blocks[:, run[at] * FAN_OUT + s])
        return closed(state, size)

    def step(self, node: int) -> bytes:
        """What a fold through this node needs: slot, size of the run, the state before the
        slot, the run's digests. `Step` reads it."""
        run = node // FAN_OUT
        digests = self.nodes[:, run * FAN_OUT:run * FAN_OUT + self.sizes[run]]
        return bytes([self.slots[node], self.sizes[run]]) + packed(self.before[:, [node]]) + packed(digests)


class Step:
    """One level of a path above a tile, the same for all that lies in the tile."""

    def __init__(self, slot: int, before: np.ndarray, run: np.ndarray):
        self.slot, self.before, self.run = slot, before, run
        text = hex_text(run)
        self.siblings = b"".join(text[:slot] + text[slot + 1:])

    def folded(self, replacement: np.ndarray) -> np.ndarray:
        n, size = replacement.shape[1], self.run.shape[1]
        state = absorbed(np.repeat(self.before, n, axis=1), blocks(replacement))
        for block in blocks(self.run[:, self.slot + 1:]).T:
            state = absorbed(state, np.repeat(block[:, None], n, axis=1))
        return closed(state, np.full(n, size))


def steps(path: bytes) -> list[Step]:
    """The levels of a path, lowest first."""
    out, at = [], 0
    while at < len(path):
        slot, size = path[at], path[at + 1]
        end = at + 34 + 32 * size
        out.append(Step(slot, words(path[at + 2:at + 34]), words(path[at + 34:end])))
        at = end
    return out
