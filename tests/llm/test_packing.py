"""Packing: ids against the tokenizer, plans against plain best fit, slots without gap or overlap."""

import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from cuegrid.llm import packing

FILE = path("word_bpe_49k.json")
ODD = ["It's <|endoftext|>. ok's. A.B Éa. É… ×. à.  x y. <|STARTOFTEXT|> İ. ΣΑΣ. x́.,", "", "'s", "don't. 'RE.", "a!?b", "<|endoftext|><|endoftext|>",
       "naïve Straße, 12.5% (ok) <b>x</b>", "日本語。テスト", " a　b", "á é. KK", "\x00\x1f ok", "ß. ẞ. ǅ."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def test_ids_are_the_tokenizers(tokenizer):
    ids, at = packing.codec(FILE).encode(pa.array(ODD + [None] + ODD))
    for k, text in enumerate(ODD + [""] + ODD):
        assert ids[at[k]:at[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB<|>.,'s é́KÉ×ßendoftxt \n\t12-İ…")), max_size=24), min_size=1, max_size=4))
def test_ids_of_any_text(texts):
    ids, at = packing.codec(FILE).encode(pa.array(texts))
    plain = packing.codec(FILE).tokenizer
    for k, text in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


def best_fit(lengths, most):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(most - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 45))
def test_plan_is_best_fit(lengths, most):
    used = {}
    for length, rank, first, per, offset in (rows := packing.plan(dict(Counter(lengths)), most)):
        used.setdefault(length, []).append((rank, first, per, offset))
    places, held = set(), Counter()
    for length, n in Counter(lengths).items():
        table = sorted(used[length])
        for rank in range(n):
            r, first, per, offset = [x for x in table if x[0] <= rank][-1]
            sequence, begin = first + (rank - r) // per, offset + (rank - r) % per * length
            span = {(sequence, k) for k in range(begin, begin + length)}
            assert not span & places and begin + length <= most
            places |= span
            held[sequence] += length
    for sequence, total in held.items():  # no gap
        assert {k for s, k in places if s == sequence} == set(range(total))
    assert len(held) == best_fit(lengths, most) and (not lengths or rows)


def test_pieces_of_documents(documents, tokenizer):
    texts = ["one two", "", None, "a b c d e f g h i j " * 9, "one two", "x " * 3000]
    docs = documents([*enumerate(texts), (None, "null id"), (0, "one two")])
    out = packing.pack(docs, FILE, most=64).collect()
    want = Counter()
    for k, text in [*enumerate(texts), (None, "null id"), (0, "one two")]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            own = ids[start:start + 64]
            want[(k, piece, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64
    assert len(by) == best_fit([r["length"] for r in out], 64)
    assert packing.pack(docs.limit(0), FILE).count() == 0


def test_a_worker_may_forget(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 4)
    machine = packing.WordCodec(FILE)
    for text in ("aa bb cc dd", "aa ee ff gg", "hh aa bb"):
        ids, at = machine.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and np.diff(at) == len(ids)
