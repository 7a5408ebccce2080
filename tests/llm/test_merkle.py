"""The manifest against hashes worked out plainly, and the resumable states against hashlib."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrid.llm import merkle, midstate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(parts):
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(row):
    values = [None if v is None else str(v).encode() for v in row]
    return joined([b"-" if v is None else str(len(v)).encode() + b":" + v for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {name: levels([leaf(r) for r in trees[name]]) for name in names}
    top = levels([built[name][-1][0] for name in names])
    for place, name in enumerate(names):
        for at, r in enumerate(trees[name]):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(LOWER)
            fold, siblings = leaf((*r[:4], text)), []
            for tree, k in ((built[name], at), (top, place)):
                for nodes in tree[:-1]:
                    run, slot = nodes[k // 8 * 8:k // 8 * 8 + 8], k % 8
                    siblings += run[:slot] + run[slot + 1:]
                    fold = joined([*run[:slot], fold, *run[slot + 1:]])
                    k //= 8
            root = top[-1][0]
            out.append((r[0], leaf(r).decode(), built[name][-1][0].decode(), root.decode(), joined(siblings).decode(), fold.decode(), fold == root))
    return sorted(out, key=str)


SCHEMA = "n_chars long, node string, text string, tree string, doc_id long, rank int, lang string, source string, id string"


def table(spark, rows):
    """With further columns whose names the operator uses inside."""
    return spark.createDataFrame([(r[3], "n", r[4], "t", r[0], 5, r[2], r[1], "i") for r in rows], SCHEMA).repartition(6)


def found(docs, span=4):
    return sorted((tuple(r) for r in merkle.manifest(docs, merkle.tampered(F.col("doc_id"), F.col("text")), span).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 600])
def test_sizes(spark, n):
    rows = [(k, "s", ["en", "de", "en"][k % 3] if n > 2 else "en", k, f"Text {k}") for k in range(n)]
    assert found(table(spark, rows)) == plain(rows)


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (None, "s", "en", 3, "ABC"), (None, "s", "en", 3, "ABD"), (5, "s", "en", 3, "ÄBC" * 30000),
            (5, "s", "en", 3, "Again"), (5, "s", "en", 3, "Again"), (-7, "s", "\U0001F600", 1, "x"), (8, "s", "￮", 1, "Y"), (9, "s", "-", 2, "-")]
    assert found(table(spark, rows)) == plain(rows)
    assert found(table(spark, rows[:1])) == plain(rows[:1])
    assert merkle.manifest(table(spark, rows).limit(0)).count() == 0


def test_many_langs_and_tiles(spark):
    chosen = random.Random(4)
    rows = [(k, "s", f"l{chosen.randrange(70)}" if k % 3 else "hot", k, f"Text {k}") for k in range(300)]
    assert found(table(spark, rows), 1) == found(table(spark, rows), 2) == plain(rows)


def test_more_than_a_tile(spark):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(4100)]
    assert found(table(spark, rows)) == plain(rows)


def test_untouched_rows_verify(spark):
    rows = [(k, "s", "en", k, f"Text {k}") for k in range(30)]
    assert all(r["verified"] for r in merkle.manifest(table(spark, rows)).collect())
    touched = merkle.manifest(table(spark, rows), F.concat("text", F.lit("!"))).collect()
    assert not any(r["verified"] for r in touched)


def test_states_resume(spark):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(21)]
    level = midstate.Level(midstate.words(b"".join(digests)))
    other = [hashlib.sha256(d).digest() for d in digests]
    folds = midstate.hex_text(level.folded(np.arange(21), midstate.words(b"".join(other))))
    for k in range(21):
        run = [d.hex().encode() for d in digests[k // 8 * 8:k // 8 * 8 + 8]]
        assert midstate.hex_text(level.parents)[k // 8] == joined(run)
        run[k % 8] = other[k].hex().encode()
        assert folds[k] == joined(run)
        step, = midstate.steps(level.step(k))
        assert midstate.hex_text(step.folded(midstate.words(other[k]))) == [joined(run)]
