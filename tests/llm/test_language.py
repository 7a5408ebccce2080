"""The conditional random field: inference against enumeration, accuracy on what it never saw."""

import itertools
import zlib

import numpy as np

from cuegrid.llm import language


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(2)
    chain = np.array([0, 0, 0, 1, 2, 2])
    potentials, move = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    marginal, crossed = language.forward_backward(potentials, chain, move)
    want_cross = np.zeros((3, 3))
    for c in range(3):
        at = np.flatnonzero(chain == c)
        mass, cross, total = np.zeros((len(at), 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=len(at)):
            w = np.exp(sum(potentials[a, y] for a, y in zip(at, path)) + sum(move[x, y] for x, y in zip(path, path[1:])))
            total += w
            for j, y in enumerate(path):
                mass[j, y] += w
            for x, y in zip(path, path[1:]):
                cross[x, y] += w
        assert np.allclose(marginal[at], mass / total)
        want_cross += cross / total
    assert np.allclose(crossed, want_cross)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    seen = language.predict(docs.withColumn("held_out", language.held_out(docs.doc_id)), model).toPandas()
    assert (seen.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in seen.doc_id]).all()
    out = seen[seen.held_out]
    assert (out.lang == out.lang_pred).mean() >= 0.98 and seen.score.between(0, 1).all()


def test_held_out_rows_and_other_columns_do_not_matter(documents, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = language.train(docs)
    b = language.train(docs.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'xx' ELSE lang END AS lang", "text", "'q' AS source"))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_switches_inside_a_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    labels = language.word_labels("the and with that this from elle avec dans pour que les", model)
    assert labels[0][2] == "en" and labels[-1][2] == "fr" and labels[0][:2] == (0, 3)


def test_edges(documents, spark):
    docs = documents([(1, None), (2, ""), (3, "12 34 !!"), (4, "the cat sat\n\non the mat"), (4, "the cat sat\n\non the mat"), (None, "el gato", "es"),
                      (5, "the " * 40_000), (6, "́́"), (7, "İstanbul ẞ 𝔘"), (8, "la casa", None)])
    out = language.predict(docs, language.train(docs)).collect()
    assert len(out) == 10 and {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3, 6)} == {"und"}
    assert all(r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 3, 6))
    assert next(r for r in out if r["doc_id"] == 5)["n_words"] == 40_000
    nothing = language.train(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), nothing).count() == 0


def test_training_rows_are_bounded(documents, monkeypatch):
    """Stretches, not texts, reach the driver."""
    reached = []
    monkeypatch.setattr(language, "fit", lambda texts, labels: reached.extend(zip(texts, labels)))
    language.train(documents([(1, "the 12 cat\n" * 40_000, "en"), (3, "el " * 20 + "g" * 50_000, "es"), (4, "la casa", "es")]))
    assert [(x, len(t.split())) for t, x in reached] == [("en", language.TRAINING_WORDS), ("es", 21), ("es", 2)] or [
        (x, len(t.split())) for t, x in reached] == [("en", language.TRAINING_WORDS), ("es", 2), ("es", 21)]
    assert max(len(t) for t, _ in reached) <= language.TRAINING_WORDS * (language.TRAINING_LETTERS + 1) and set(" ".join(t for t, x in reached if x == "en").split()) == {"the", "cat"}
