"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from cuegrid.llm import recompress
from cuegrid.llm.arrow_text import mixed


def brute(rows, window):
    """(doc_id, words, removed, sha) of rows (doc_id, text)."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    source = {}
    for d, w in split:
        if d is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                source[key] = min(d, source.get(key, d))
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for k in range(len(w) - window + 1):
                if source[tuple(w[k:k + window])] < d:
                    gone |= set(range(k, k + window))
        stay = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(w) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
    return sorted(out, key=str)


def check(documents, rows, window=50, **options):
    got = recompress.dedup(documents(rows).repartition(3), window, **options)
    assert set(got.columns) >= {"doc_id", "kept", "source", "place", "part", "score"}
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute(rows, window)


def test_planted_passages(documents):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 60, 75, 130)]
    rows = []
    for d in range(60):
        parts = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = rng.choice(passages)
        rows.append((d, rng.choice([" ", "\n", "\t  "]).join(parts)))
    rows += [(70, rows[5][1]), (71, rows[5][1]), (72, rows[5][1] + " tail"), (73, "head " + rows[5][1])]
    check(documents, rows)


def test_runs_and_periods(documents):
    """Windows inside repetitions settle no symbol and stand for themselves."""
    rows = [(1, "a " * 300), (2, "a " * 120 + "b"), (3, "a b " * 90), (4, "b a " * 60 + "c"), (5, "x " + "a " * 50), (6, "a b c d e f g " * 30), (7, "q " + "a b c d e f g " * 8),
            (8, "a " * 49), (9, "z " * 70), (10, "y " * 400 + "z " * 50)]
    check(documents, rows)


def test_edges(documents, spark):
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, shared), (4, shared), (4, "other " + shared + " text"), (None, shared), (5, shared), (5, "é " + shared),
            (6, " ".join(f"long{k % 997}" for k in range(60_000))), (7, " ".join(f"long{k % 997}" for k in range(500, 5_000))), (8, shared.replace(" ", " ")), (9, shared.replace(" ", "\n"))]
    check(documents, rows)
    assert recompress.dedup(documents(rows).limit(0)).count() == 0


def test_one_very_common_passage(documents):
    shared = " ".join(f"s{k}" for k in range(52))
    check(documents, [(k, f"head{k} {shared} tail{k % 7}") for k in range(400)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=20, max_size=60), st.integers(0, 20), st.lists(st.integers(0, 3), max_size=20))
def test_settled_symbols_stand_wherever_their_words_stand(core, before, after):
    """A symbol whose settling words lie inside the shared part is in both texts, at the same place."""
    names = mixed(np.array(core, np.uint64), 3)
    other = mixed(np.array([before % 4] * before + core + after, np.uint64), 3)
    for a, b in zip(recompress.levels(names, np.zeros(len(names), int), 5), recompress.levels(other, np.zeros(len(other), int), 5)):
        there = {(f, x, n) for f, x, n in zip((b.first - before).tolist(), (b.last - before).tolist(), b.name.tolist())}
        for k in np.flatnonzero((a.low >= 0) & (a.high <= len(core))):
            assert (int(a.first[k]), int(a.last[k]), int(a.name[k])) in there
