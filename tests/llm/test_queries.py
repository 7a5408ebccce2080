"""Numbered queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from cuegrid.catalog import check
from cuegrid.llm import queries
from cuegrid.session import prepared

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    out = prepared(queries.queries()[name])(spark, FOLDER)
    cur = check.connect(FOLDER).execute(queries.oracle_sql()[name])
    assert check.compare([tuple(r) for r in out.collect()], out.columns, cur.fetchall(), [d[0] for d in cur.description]) == ""


def test_names():
    assert [n.partition("_")[0] for n in sorted(queries.queries(), key=lambda x: int(x[2:].partition("_")[0]))] == [f"op{k}" for k in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]


def test_pipeline_is_its_parts(spark, documents):
    """Each stage on what the one before kept, worked out by the brute-force versions of the other tests."""
    import hashlib

    from tests.llm.test_dart import classes
    from tests.llm.test_recompress import brute
    from cuegrid.llm import language, packing, secrets

    raw = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120).collect()
    passage = " ".join(f"shared{k}" for k in range(55))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in raw] + [
        (1000, raw[0]["text"], "en"), (1001, f"the thing {passage}", "en"), (1002, f"of that {passage} token = \"0123456789abcdef0123456789abcdef01234567\"", "en"), (1003, "123", "en"),
        (1004, None, None), (1005, raw[1]["text"] + " " + passage + " token = \"abcdef0123456789abcdef\" " + raw[1]["text"], "en"), (None, f"the of {passage}", "en")]
    docs = documents(rows)
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, FOLDER).cache()
        old = [(r["doc_id"], r["text"]) for r in before.collect()]
        new = kept.collect()
        if name == "language_id":
            seen = language.predict(docs, language.train(docs)).collect()
            want = sorted(str((r["doc_id"], r["text"])) for r in seen if r["lang_pred"] != "und" and r["score"] >= 0.5)
        elif name == "minhash_near_dedup":
            group = classes(old)
            want = sorted({str((d, t)) for d, t in old if d is None or group[d] == d})
        elif name == "substring_dedup":
            want = [x[3] for x in brute(old, 50) if x[2] == 0 or x[2] < x[1]]
            assert sorted(want) == sorted(hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() for r in new)
            same = {x[0] for x in brute(old, 50) if x[2] == 0}
            assert {(d, t) for d, t in old if d in same} <= {(r["doc_id"], r["text"]) for r in new}
            continue
        elif name == "secret_scan":
            want = sorted(str((d, t and secrets.without(t, secrets.spans_of(t)))) for d, t in old)
            assert any("<assign>" in (r["text"] or "") for r in new)
        else:
            codec = packing.codec(packing_file()).tokenizer
            assert sum(r["length"] for r in new) == sum(len(codec.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in old)
            continue
        assert kept.columns == list(corpus_pipeline.DOCUMENT) and sorted(str((r["doc_id"], r["text"])) for r in new) == want


def packing_file():
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and {"sequence_id", "offset"} <= set(out.columns)
