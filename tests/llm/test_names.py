"""Texts made so that polynomial names modulo a power of two are equal: the words of Thue and Morse."""

import numpy as np
import pyarrow as pa
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from cuegrid.llm import arrow_text, dart, packing, recompress, transducer
from tests.llm.test_recompress import check

ONE = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
OTHER = ONE.translate(str.maketrans("ab", "ba"))
BOTH = [ONE[:1024], OTHER[:1024], ONE, OTHER]


def spans(texts):
    data, offsets = arrow_text.text_bytes(pa.array(texts))
    return data, offsets[:-1], offsets[1:]


def test_names_tell_them_apart():
    data, starts, ends = spans(BOTH)
    for salt in (1, 2):
        assert len(set(arrow_text.word_names(data, starts, ends, salt).tolist())) == 4
    values = arrow_text.mixed(np.frombuffer("".join(BOTH).encode(), np.uint8).astype(np.uint64))
    for family in (0, 1):
        assert len(set(arrow_text.names_of_spans(values, starts, ends, 5, family).tolist())) == 4


def test_equal_spans_have_equal_names():
    made = np.random.default_rng(2)
    data = made.integers(0, 3, 60000).astype(np.uint8)
    for length in (0, 1, 7, 8, 9, 16, 255, 256, 257, 700):
        data[40000:40000 + length] = data[100:100 + length]
        starts, ends = np.array([100, 40000]), np.array([100 + length, 40000 + length])
        a, b = arrow_text.word_names(data, starts, ends).tolist()
        assert a == b
        for family in (0, 1):
            a, b = arrow_text.names_of_spans(arrow_text.mixed(data.astype(np.uint64)), starts, ends, 3, family).tolist()
            assert a == b


def test_distinct_spans(monkeypatch):
    words = ["", "a", "a" * 8, "a" * 9, "b", "a", "ab", *BOTH, ONE, "a" * 8, ""]
    data, starts, ends = spans(words)
    for name in (arrow_text.word_names, lambda data, starts, ends: np.zeros(len(starts), np.uint64), lambda data, starts, ends: (ends - starts).astype(np.uint64)):
        monkeypatch.setattr(arrow_text, "word_names", name)  # also where names clash
        codes, first = arrow_text.distinct_spans(data, starts, ends)
        assert [words[f] for f in first[codes]] == words and len(first) == len(set(words))


def test_ids(spark):
    word, piece = path("word_bpe_49k.json"), path("piece_bpe_32k.model")
    own, tokenizer = sentencepiece.SentencePieceProcessor(model_file=piece), Tokenizer.from_file(word)
    texts = [*BOTH, " ".join(BOTH)]
    ids, at = packing.codec(word).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    ids, at = transducer.transducer(piece).encode(texts)
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == own.encode(text)


def test_windows(documents):
    head = " ".join(f"w{k}" for k in range(49))
    check(documents, [(1, f"{head} {ONE}"), (2, f"{head} {OTHER}"), (3, f"{head} {OTHER} x")])
    bits = lambda word: " ".join(word)
    check(documents, [(1, bits(ONE)), (2, bits(OTHER))], 1024)


def test_near_duplicates(documents):
    got = {r["doc_id"]: r["class_id"] for r in dart.near_duplicates(documents([(1, ONE), (2, OTHER), (3, ONE)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_many_texts_of_one_document(documents):
    shared = " ".join(f"s{k}" for k in range(55))
    rows = [(2, f"{shared} t{k}" if k % 2 else f"t{k} of its own") for k in range(20000)] + [(1, shared)]
    got = recompress.dedup(documents(rows)).groupBy("n_words", "n_removed").count().collect()
    assert sorted(tuple(r) for r in got) == [(4, 0, 10000), (55, 0, 1), (56, 55, 10000)]
