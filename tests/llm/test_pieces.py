"""The transducer against the model file's own library."""

import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from public_tokenizers import path

from cuegrid.llm import transducer

FILE = path("piece_bpe_32k.model")
TEXTS = ["Hello  world", " lead", "trail  ", "   ", "tabs\t\nlines\n\n", "▁marks ▁▁b", "<s> </s> <0x41> <unk>", "aaaaaaaaaaa aaaa", "日本語のテキスト。", "𐍈☃ x́ é", "l'été naïve", "it's 1234,56", "a" * 3000, ""]


@pytest.fixture(scope="module")
def own():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def test_ids_and_round_trip(own):
    machine = transducer.transducer(FILE)
    ids, at = machine.encode([*TEXTS, None])
    for k, text in enumerate(TEXTS):
        assert ids[at[k]:at[k + 1]].tolist() == own.encode(text), text
    assert machine.decode(ids, at) == [t.replace("▁", " ") for t in TEXTS] + [""]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abeinrst AE.,é▁\n1☃")), max_size=40))
def test_any_text(text):
    machine = transducer.transducer(FILE)
    ids, _ = machine.encode([text])
    assert ids.tolist() == sentencepiece_of().encode(text)


def sentencepiece_of(kept=[]):  # noqa: B006 - one processor for all examples
    if not kept:
        kept.append(sentencepiece.SentencePieceProcessor(model_file=FILE))
    return kept[0]


def test_unigram_path_is_the_best_of_all():
    """With unigram weights the path is the least of all cuttings."""
    machine = transducer.Transducer.__new__(transducer.Transducer)
    machine.merges, machine.score, machine.worst, machine.longest = False, {"a": -3.0, "b": -3.5, "ab": -5.0, "ba": -4.0, "aba": -9.0}, -20.0, 3
    machine.ids = {t: k for k, t in enumerate(machine.score)}

    def cuttings(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if s[:k] in machine.score for rest in cuttings(s[k:])]

    for text in ("abab", "baba", "aabba", "abaab"):
        got = machine.shortest(text)
        assert "".join(got) == text and sum(machine.score[p] for p in got) == max(sum(machine.score[p] for p in c) for c in cuttings(text))


def test_tables(documents, spark, own):
    rows = [*enumerate(TEXTS), (99, None), (99, None), (None, "x")]
    docs = documents(rows)
    coded = transducer.encode(docs, FILE)
    assert all(r["ids"] == own.encode(r["text"] or "") for r in coded.select("text", "ids").collect())
    back = {(r["doc_id"]): r["text"] for r in transducer.decode(coded, FILE).select("doc_id", "text").collect()}
    assert all(back[k] == t.replace("▁", " ") for k, t in enumerate(TEXTS))
    out = transducer.digest(docs, FILE).collect()
    assert len(out) == len(rows) and all(r["round_trip"] for r in out)
    for r in out:
        ids = own.encode(dict(rows)[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert transducer.digest(docs.limit(0), FILE).count() == 0


def test_a_worker_may_forget(own, monkeypatch):
    monkeypatch.setattr(transducer, "REMEMBERED", 3)
    monkeypatch.setattr(transducer, "PAIRS", 5)
    machine = transducer.Transducer(FILE)
    for text in TEXTS[:8]:
        ids, _ = machine.encode([text])
        assert ids.tolist() == own.encode(text)
