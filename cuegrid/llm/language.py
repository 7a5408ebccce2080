"""Language ID: a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

import base64
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column, mixed, slices, word_names

#: Documents the model is fitted on at most, chosen by a hash of doc_id.
TRAINING_DOCS = 1_600
#: Weights of hashed features, a vector of one number per language each.
FEATURE_BITS = 17
#: Words a document gives to training at most: a stretch that begins at a hashed place.
TRAINING_WORDS = 100
#: Letters that training looks at in a word at most; only what is no word is longer.
TRAINING_LETTERS = 100
#: Words held in the lexicon at most, the commonest of the training sample.
LEXICON = 20_000
#: Values of lang that can be learned at most.
LANGUAGES = 200
UNKNOWN = "und"

_RESULT = "lang_pred string, score double, n_words long, n_switches long"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark that combines with letters, else 0."""
    import unicodedata

    table = np.zeros(0x110000, np.int8)
    worth = {"L": 2, "M": 1}
    table[:0x32400] = [worth.get(unicodedata.category(chr(c))[0], 0) for c in range(0x32400)]
    return table


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case code points of all texts, word starts, word ends, text of each word, chain of each
    word). Words are runs of letters; a chain is the words of one line of one text."""
    listed = [_lower(t or "") for t in texts.to_pylist()]
    points = np.frombuffer("\n".join([*listed, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    worth = _letters()[np.minimum(points, 0x10FFFF)]
    edge = np.diff((worth > 0).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.concatenate([[0], np.cumsum(worth == 2)])
    real = letters[ends] > letters[starts]  # marks alone make no word
    starts, ends = starts[real], ends[real]
    text_ends = np.cumsum([len(t) + 1 for t in listed]) if listed else np.zeros(0, np.int64)
    chain = np.searchsorted(np.flatnonzero(points == 10), starts)
    return points, starts, ends, np.searchsorted(text_ends, starts, side="right"), chain


def features(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, word it belongs to): prefixes and suffixes of one to four letters, n-grams of
    two to four characters with the word's edges, the word itself if the lexicon has it, and a
    constant. Words are `points[starts:ends]`."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n + 2)
    first = np.cumsum(n + 2) - (n + 2)
    padded = np.full(int((n + 2).sum()), 1, np.uint64)  # 1 marks an edge
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    padded[np.repeat(first, n) + inner + 1] = points[np.repeat(starts, n) + inner]
    found, whose = [], []

    def add(kind: int, key: np.ndarray, word: np.ndarray) -> None:
        found.append(mixed(key, 50 + kind))
        whose.append(word)

    gram = padded.copy()
    for size in (2, 3, 4):
        if len(padded) < size:
            break
        gram = gram[:len(padded) - size + 1] * np.uint64(0x100000001B3) + padded[size - 1:]
        add(size, gram, owner[:len(gram)])
        whole = owner[:len(gram)] == owner[size - 1:]
        found[-1], whose[-1] = found[-1][whole], whose[-1][whole]
    at = np.arange(len(n))
    head, tail = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    for size in (1, 2, 3, 4):
        on = n >= size
        head[on] = head[on] * np.uint64(0x100000001B3) + points[starts[on] + size - 1]
        tail[on] = tail[on] * np.uint64(0x100000001B3) + points[ends[on] - size]
        add(10 + size, head[on], at[on])
        add(20 + size, tail[on], at[on])
    names = word_keys(points, starts, ends)
    known = np.isin(names, lexicon)
    add(30, names[known], at[known])
    add(31, np.zeros(len(n), np.uint64), at)
    return (np.concatenate(found) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), np.concatenate(whose)


def word_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_names(points.astype("<u4").view(np.uint8), 4 * starts, 4 * ends, 48)


@dataclass
class Model:
    """Weights of features and of transitions between neighbouring words' languages."""

    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # languages x languages
    lexicon: np.ndarray  # sorted word keys

    def potentials(self, points, starts, ends) -> np.ndarray:
        """Log potential of each language for each word; distinct words are scored once."""
        if not len(starts):
            return np.zeros((0, len(self.languages)))
        codes, _ = pd.factorize(word_keys(points, starts, ends))
        first = np.empty(codes.max() + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        feature, whose = features(points, starts[first], ends[first], self.lexicon)
        scored = np.stack([np.bincount(whose, self.weights[feature, k], minlength=len(first)) for k in range(len(self.languages))], axis=1)
        return scored[codes]

    def __reduce__(self):
        used = np.flatnonzero(self.weights.any(axis=1))
        return _unpacked, (self.languages, len(self.weights), used.astype(np.int32), self.weights[used].astype(np.float32), self.transitions, self.lexicon)


def _unpacked(languages, size, used, values, transitions, lexicon):
    weights = np.zeros((size, len(languages)))
    weights[used] = values
    return Model(languages, weights, transitions, lexicon)


def forward_backward(potentials: np.ndarray, chain: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of each language for each word, expected transitions over all chains). Words of a
    chain stand together. All chains advance together, the longest first, so a step is one array
    operation over the chains that are still running."""
    total, k = potentials.shape
    if not total:
        return np.zeros((0, k)), np.zeros((k, k))
    heads = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    sizes = np.diff(np.r_[heads, total])
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[order], sizes[order]
    running = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # chains with a word at each step
    local = np.exp(potentials - potentials.max(axis=1, keepdims=True))
    move = np.exp(transitions)
    alpha = np.empty((total, k))
    now = local[heads]
    now /= now.sum(axis=1, keepdims=True)
    alpha[heads] = now
    for step in range(1, len(running)):
        at = heads[:running[step]] + step
        now = (now[:running[step]] @ move) * local[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    gamma = np.empty((total, k))
    crossed = np.zeros((k, k))
    beta = np.ones((running[-1], k))
    at = heads[:running[-1]] + len(running) - 1
    gamma[at] = alpha[at]
    for step in range(len(running) - 2, -1, -1):
        ahead = local[at] * beta
        before = heads[:running[step + 1]] + step
        pair = alpha[before][:, :, None] * move[None] * ahead[:, None, :]
        norm = pair.sum(axis=(1, 2))
        crossed += (pair / norm[:, None, None]).sum(axis=0)
        fresh = np.ones((running[step], k))
        back = ahead @ move.T
        fresh[:len(back)] = back / back.sum(axis=1, keepdims=True)
        beta, at = fresh, heads[:running[step]] + step
        mass = alpha[at] * beta
        gamma[at] = mass / mass.sum(axis=1, keepdims=True)
    return gamma, crossed


def _stretches(texts: list[str]) -> list[str]:
    """Of each text TRAINING_WORDS words in a row, from a place that a hash of the text chooses."""
    points, starts, ends, owner, _ = words(pa.array(texts, pa.string()))
    ends = np.minimum(ends, starts + TRAINING_LETTERS)
    bounds, out = np.searchsorted(owner, np.arange(len(texts) + 1)), []
    for text, a, b in zip(texts, bounds.tolist(), bounds[1:].tolist()):
        a += zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, b - a - TRAINING_WORDS + 1)
        taken = zip(starts[a:min(b, a + TRAINING_WORDS)].tolist(), ends[a:min(b, a + TRAINING_WORDS)].tolist())
        out.append(" ".join(points[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in taken))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the stretch of each text in its place."""
    for batch in slices(batches, "text"):
        place = batch.schema.get_field_index("text")
        yield batch.set_column(place, "text", pa.array(_stretches(batch.column(place).to_pylist()), pa.string()))


def fit(texts: list[str], labels: list[str], rounds: int = 6, seed: int = 11) -> Model:
    """Maximise the conditional likelihood of the words' languages (each word has its text's) by
    stochastic gradient steps with per-feature step sizes, over chunks of texts. A text is one chain
    of words: what training takes of a document."""
    languages = sorted(set(labels))
    lookup = {name: k for k, name in enumerate(languages)}
    points, starts, ends, owner, _ = words(pa.array(texts, pa.string()))
    keys = word_keys(points, starts, ends)
    seen, counts = np.unique(keys, return_counts=True)
    lexicon = np.sort(seen[np.argsort(-counts, kind="stable")[:LEXICON]])
    k = len(languages)
    model = Model(languages, np.zeros((1 << FEATURE_BITS, k)), np.zeros((k, k)), lexicon)
    if not len(starts) or k < 2:
        return model
    target = np.array([lookup[x] for x in labels])[owner]
    # the words of one stretch make one chain
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    stretches = [(a, b) for a, b in zip(bounds.tolist(), bounds[1:].tolist()) if b > a]
    at = np.concatenate([np.arange(*x) for x in stretches])
    chain = np.repeat(np.arange(len(stretches)), [b - a for a, b in stretches])
    found, counted = [], []
    for x in range(0, len(at), 5_000):  # all words at once take several times the memory
        feature, whose = features(points, starts[at[x:x + 5_000]], ends[at[x:x + 5_000]], lexicon)
        found.append(feature[np.argsort(whose, kind="stable")].astype(np.int32))
        counted.append(np.bincount(whose, minlength=len(at[x:x + 5_000])))
    feature = np.concatenate(found)
    del found
    used = np.flatnonzero(np.bincount(feature, minlength=1 << FEATURE_BITS))
    number = np.zeros(1 << FEATURE_BITS, np.int32)
    number[used] = np.arange(len(used))
    feature = number[feature]
    edge = np.concatenate([[0], np.cumsum(np.concatenate(counted))])  # features of each word
    ends_of = np.searchsorted(chain, np.arange(len(stretches) + 1))
    weights, squared, moved = np.zeros((len(used), k)), np.full((len(used), k), 1e-6), np.full((k, k), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(stretches)), max(1, len(stretches) // 50)):
            word = np.concatenate([np.arange(ends_of[j], ends_of[j + 1]) for j in part])
            links = np.repeat(np.arange(len(part)), ends_of[part + 1] - ends_of[part])
            count = edge[word + 1] - edge[word]
            own = np.repeat(np.arange(len(word)), count)
            mine = feature[np.arange(len(own)) + np.repeat(edge[word] - np.cumsum(count) + count, count)]
            potentials = np.stack([np.bincount(own, weights[mine, c], minlength=len(word)) for c in range(k)], axis=1)
            marginal, crossed = forward_backward(potentials, links, model.transitions)
            truth = target[at[word]]
            error = -marginal
            error[np.arange(len(word)), truth] += 1
            slope = np.stack([np.bincount(mine, error[own, c], minlength=len(used)) for c in range(k)], axis=1) - 1e-3 * weights
            squared += slope ** 2
            weights += 0.2 * slope / np.sqrt(squared)
            inside = links[1:] == links[:-1]
            turn = np.zeros((k, k))
            np.add.at(turn, (truth[:-1][inside], truth[1:][inside]), 1)
            turn = turn - crossed - 0.5 * model.transitions
            moved += turn ** 2
            model.transitions += 0.1 * turn / np.sqrt(moved)
    model.weights[used] = weights
    return model


def held_out(doc_id):
    """Documents that are never learned from: CRC-32 of the id's decimal digits, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, most: int = TRAINING_DOCS) -> Model:
    """A model fitted on about `most` documents with text and lang that are not held out.

    Each of the at most LANGUAGES commonest values of lang gives an equal share, or all it has: the
    documents with the smallest hashes of doc_id. A hash bound for each language, from its count,
    keeps what reaches the driver within twice `most` rows, however large the corpus is, each with
    the stretch of its text that training takes, however long the text is."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select(
        "doc_id", "lang", "text", ((F.xxhash64("doc_id") / F.lit(2.0 ** 64)) + F.lit(0.5)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0, np.uint64))
    share = max(1, most // len(counts))
    bounds = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(2.0, 1.5 * share / n + 5 / n))])
    picked = rows.where(F.col("h") < bounds[F.col("lang")])
    cut = picked.mapInArrow(_cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema))
    got = sorted(cut.collect(), key=lambda r: (r["lang"], r["h"], str(r["doc_id"]), r["text"]))
    taken, used = [], dict.fromkeys(counts, 0)
    for r in got:
        if used[r["lang"]] < share:
            used[r["lang"]] += 1
            taken.append(r)
    return fit([r["text"] for r in taken], [r["lang"] for r in taken])


def _label(packed: bytes, shares: bool):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(packed)
        k, names = len(model.languages), model.languages
        for batch in slices(batches, "text"):
            n = batch.num_rows
            points, starts, ends, owner, chain = words(column(batch, "text"))
            gamma, _ = forward_backward(model.potentials(points, starts, ends), chain, model.transitions) if k else (np.zeros((len(starts), 0)), None)
            mass = np.stack([np.bincount(owner, gamma[:, c], minlength=n) for c in range(k)], axis=1) if k else np.zeros((n, 0))
            count = np.bincount(owner, minlength=n)
            share = mass / np.maximum(count, 1)[:, None]
            known = (count > 0) & (k > 0)
            best = share.argmax(axis=1) if k else np.zeros(n, int)
            word = gamma.argmax(axis=1) if k else np.zeros(len(starts), int)
            turned = (word[1:] != word[:-1]) & (owner[1:] == owner[:-1])
            told = {"shares": pa.array([list(zip(names, row)) if y else [] for row, y in zip(share.tolist(), known.tolist())], pa.map_(pa.string(), pa.float64()))} if shares else {}
            yield pa.record_batch({
                **{f.name: batch.column(j) for j, f in enumerate(batch.schema) if f.name not in ("lang_pred", "score", "n_words", "n_switches", "shares")},
                "lang_pred": pa.array([names[b] if y else UNKNOWN for b, y in zip(best.tolist(), known.tolist())], pa.string()),
                "score": pa.array(np.clip(np.where(known, share[np.arange(n), best] if k else 0.0, 0.0), 0.0, 1.0)),
                "n_words": pa.array(count.astype(np.int64)),
                "n_switches": pa.array(np.bincount(owner[1:][turned], minlength=n).astype(np.int64)), **told})

    return label


@lru_cache(maxsize=2)
def _model(packed: bytes) -> Model:
    return pickle.loads(base64.b64decode(packed))


def predict(docs: DataFrame, model: Model, shares: bool = True) -> DataFrame:
    """`docs` with lang_pred, score, n_words, n_switches and, if wanted, shares.

    Each line of a text is a chain of words; forward-backward gives every word its posterior over the
    languages, so a text that switches is labelled word by word. shares are the mean posteriors;
    lang_pred is the largest share (ties: first in alphabetical order), score that share. A text
    that is null or has no letter is `und` with score 0, and so is every text if nothing was
    learned. n_switches counts neighbouring words with different best languages."""
    packed = base64.b64encode(pickle.dumps(model))
    names = ("lang_pred", "score", "n_words", "n_switches", "shares")
    kept = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_label(packed, shares), f"{schema}, {_RESULT}" + (", shares map<string,double>" if shares else ""))


def word_labels(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """(start, end, language, posterior) of each word of one text."""
    points, starts, ends, _, chain = words(pa.array([text], pa.string()))
    gamma, _ = forward_backward(model.potentials(points, starts, ends), chain, model.transitions)
    best = gamma.argmax(axis=1)
    return [(a, b, model.languages[c], float(g[c])) for a, b, c, g in zip(starts.tolist(), ends.tolist(), best.tolist(), gamma)]
