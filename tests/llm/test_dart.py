"""DartMinHash against weighted Jaccard similarity, and classes against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cuegrid.llm import dart


def shingles(text):
    w = (text or "").encode().split()
    n = min(len(w), 5)
    return Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(rows):
    nodes = {}
    for d, t in rows:
        if d is not None:
            nodes.setdefault(d, []).append(shingles(t))
    root = {d: d for d in nodes}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(nodes)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if any(s and u and 5 * sum((s & u).values()) >= 4 * sum((s | u).values()) for s in nodes[a] for u in nodes[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("scale", [1.0, 0.3, 6.5])
def test_signatures_estimate_weighted_similarity(scale):
    rng = np.random.default_rng(4)
    k, n = 4000, 60
    a = rng.integers(1, 6, n) * scale
    b = np.where(rng.random(n) < 0.5, a, rng.integers(1, 6, n) * scale)
    names = np.arange(1, n + 1, dtype=np.uint64)
    owner = np.repeat([0, 1, 2], [n, n, 1])
    sig = dart.dart_signatures(owner, np.concatenate([names, names, names[:1]]), np.concatenate([a, b, [scale]]), 4, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / k)
    assert (sig[:3] != 0).all() and not sig[3].any()


def test_similarity_is_exact():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 25))) for _ in range(60)]
    got = dart.similarity(pa.array(texts[:30]), pa.array(texts[30:]))
    assert np.allclose(got, [jaccard(shingles(x), shingles(y)) for x, y in zip(texts[:30], texts[30:])])


def test_classes_of_near_copies(documents):
    """A group whose copies are chained, a bucket with outsiders, exact copies, short texts."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(2000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for d in range(140):  # near copies at all distances around the threshold
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((d, " ".join(copy)))
    drift = list(base[::-1])
    for d in range(200, 230):  # a chain: neighbours are near, ends are not
        drift[(d * 7) % len(drift)] = f"new{d}"
        rows.append((d, " ".join(drift)))
    rows += [(300 + k, " ".join(rng.choice(words) for _ in range(40))) for k in range(30)]
    rows += [(400 + k, rows[3][1]) for k in range(20)] + [(500, "a b"), (501, "a  b"), (502, "a c"), (503, "one"), (504, "one\n"), (505, "b a")]
    rng.shuffle(rows)
    out = dart.near_duplicates(documents(rows).repartition(4)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == classes(rows) and len(out) == len(rows)


def test_edges(documents):
    long = " ".join(f"l{k % 5000}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x " * 400), (5, "x " * 401), (6, long), (7, long + " end"), (8, "same row"), (8, "same row"), (None, "same row"), (9, "p q r s t u"),
            (9, "k l m n o"), (10, "k l m n o"), (11, "p q r s t u")]
    out = dart.near_duplicates(documents(rows)).collect()
    assert len(out) == len(rows) and all(r["class_id"] is None for r in out if r["doc_id"] is None)
    want = classes(rows)
    assert all(r["class_id"] == want[r["doc_id"]] for r in out if r["doc_id"] is not None)
    assert dart.near_duplicates(documents(rows).limit(0)).count() == 0


def test_documents_with_several_texts(spark, documents):
    """Every text of a doc_id finds its near copies, and none vanishes from the corpus."""
    import corpus_pipeline

    rng = random.Random(3)
    texts = [" ".join(f"{c}{rng.randrange(900)}" for _ in range(60)) for c in "abcd"]
    rows = [(9, t) for t in texts] + [(20 + k, t + " end") for k, t in enumerate(texts)] + [(30, "alone here"), (10, texts[0]), (None, texts[1])]
    docs = documents(rows)
    out = dart.near_duplicates(docs).collect()
    want = classes(rows)
    assert len(out) == len(rows) and all(r["class_id"] == want.get(r["doc_id"]) for r in out)
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(9, t) for t in texts] + [(30, "alone here"), (None, texts[1])], key=str)
