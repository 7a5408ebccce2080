"""Retiming a clip to an untouched narration, and aligning word sequences."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuegrid import params as P
from cuegrid.functions.rounding import round_exact
from cuegrid.functions.text import bound, matching_words, words_of
from cuegrid.operators.fit import apart_seconds, cheapest, span
from cuegrid.operators.rows import keep_parallel, settled
from cuegrid.operators.scan import scan

TINY = 1e-3


def factor(piece: Column) -> Column:
    return F.try_divide(piece["t1"] - piece["t0"], piece["c1"] - piece["c0"])


def anchor_pieces(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, ix, ts, te, cs, ce) -> pieces between neighbouring anchors: each phrase
    itself (speaking) and the pause up to the next one."""
    nxt = scan(pairs, [key], ["ix"], F.floor(F.col("ix") / 4096),
               leads={"_t": F.col("ts"), "_c": F.col("cs")})
    both = F.array(
        F.struct(F.lit(True).alias("speaking"), F.col("cs").alias("c0"), F.col("ce").alias("c1"),
                 F.col("ts").alias("t0"), F.col("te").alias("t1")),
        F.struct(F.lit(False).alias("speaking"), F.col("ce").alias("c0"), F.col("_c").alias("c1"),
                 F.col("te").alias("t0"), F.col("_t").alias("t1")))
    return nxt.select(key, "ix", F.explode(F.filter(both, lambda p: p["c1"].isNotNull())).alias("p")
                      ).select(key, "ix", "p.*")


def time_map(phrases: Column, target: Column, clip_len: Column) -> Column:
    """STRUCT<pieces, pre_hold, post_hold> through paired phrases ARRAY<STRUCT<ns,ne,cs,ce>>
    (narration time is output time), or null when a piece would play implausibly fast or
    slow. Lead-in and tail play at normal speed; what the clip lacks is held."""
    n = F.size(phrases)

    def piece(c0: Column, c1: Column, t0: Column, t1: Column) -> Column:
        return F.struct(c0.alias("c0"), c1.alias("c1"), t0.alias("t0"), t1.alias("t1"))

    speech = F.transform(phrases, lambda p: piece(p["cs"], p["ce"], p["ns"], p["ne"]))
    pauses = F.transform(F.slice(phrases, F.lit(1), n - 1), lambda p, k: piece(
        p["ce"], F.get(phrases, k + 1)["cs"], p["ne"], F.get(phrases, k + 1)["ns"]))

    def plausible(pieces: Column, low: float, high: float) -> Column:
        return F.forall(pieces, lambda p: (p["t1"] - p["t0"] >= TINY) & (p["c1"] - p["c0"] >= TINY)
                        & factor(p).between(low, high))

    first, last = F.get(phrases, F.lit(0)), F.element_at(phrases, -1)
    pre_c = first["cs"] - first["ns"]
    pre_hold = F.greatest(F.lit(0.0), -pre_c)
    head = F.when(first["ns"] > 0, F.array(piece(F.greatest(F.lit(0.0), pre_c), first["cs"],
                                                 pre_hold, first["ns"])))
    tail_s = target - last["ne"]
    end_c = F.least(clip_len, last["ce"] + tail_s)
    tail = F.when((tail_s > 0) & (end_c - last["ce"] > TINY), F.array(
        piece(last["ce"], end_c, last["ne"], last["ne"] + (end_c - last["ce"]))))
    none = F.array().cast("array<struct<c0:double,c1:double,t0:double,t1:double>>")
    body = F.concat(F.coalesce(head, none), speech, pauses, F.coalesce(tail, none))
    kept = F.sort_array(F.filter(body, lambda p: (p["c1"] - p["c0"] > TINY)
                                 & (p["t1"] - p["t0"] > TINY)))
    post = F.when(tail_s > 0, F.greatest(F.lit(0.0), tail_s - (end_c - last["ce"]))).otherwise(
        F.lit(0.0))
    return F.when(plausible(speech, *P.SPEECH_RANGE) & plausible(pauses, *P.PAUSE_RANGE),
                  F.struct(kept.alias("pieces"), pre_hold.alias("pre_hold"),
                           post.alias("post_hold")))


def mapped_lips(pieces: Column, clip: Column) -> Column:
    """The clip's speech on the output axis, through the pieces of a time map."""

    def one(p: Column) -> Column:
        hit = F.filter(clip, lambda s: F.least(s["t1"], p["c1"]) > F.greatest(s["t0"], p["c0"]))
        return F.transform(hit, lambda s: span(
            p["t0"] + (F.greatest(s["t0"], p["c0"]) - p["c0"]) * factor(p),
            p["t0"] + (F.least(s["t1"], p["c1"]) - p["c0"]) * factor(p)))

    return F.flatten(F.transform(pieces, one))


def map_mismatch(pieces: Column, narr: Column, clip: Column, target: Column) -> Column:
    return apart_seconds(mapped_lips(pieces, clip), narr, target)


def alignment_cost(mapped: Column, mismatch: Column) -> Column:
    return round_exact(mismatch + 0.5 * (mapped["pre_hold"] + mapped["post_hold"]), 3)


def search_alignment(rows: DataFrame, key: str, target: str = "target",
                     clip_len: str = "clip_len") -> DataFrame:
    """Best time map per scene over the same candidates the fit uses; scenes without a
    plausible one are absent. `scored`: candidates mapped for it. What a selection makes the picture
    hold does not depend on the pairing, so it bounds the cost of all its maps."""
    goal, length = F.col(target), F.col(clip_len)

    def plan(phrases: Column) -> Column:
        return bound(time_map(phrases, goal, length), lambda m: F.when(m.isNotNull(), bound(
            map_mismatch(m["pieces"], F.col("narr"), F.col("clip"), goal), lambda miss: F.struct(
                alignment_cost(m, miss).alias("cost"), F.struct(
                    m["pieces"].alias("pieces"), m["pre_hold"].alias("pre_hold"), m["post_hold"].alias("post_hold"),
                    miss.alias("mismatch")).alias("body")))))

    def least(sel: Column) -> Column:
        said_last, seen_last = F.element_at("narr", -1)["t1"], F.element_at(sel, -1)["t1"]
        before = F.greatest(F.lit(0.0), F.get("narr", F.lit(0))["t0"] - F.get(sel, F.lit(0))["t0"])
        tail = goal - said_last
        after = F.greatest(F.lit(0.0), tail - (F.least(length, seen_last + tail) - seen_last))
        return 0.5 * (before + F.when(tail > 0, after).otherwise(0.0)) - 0.002

    found = cheapest(keep_parallel(rows, key), length, plan, least).where("best is not null")
    n = F.size("best.phrases")
    return found.select(key, "best.body.*", n.alias("n_phrases"),
                        F.when(n > 1, "phrases").otherwise("span").alias("mode"), "scored")


# ------------------------------------------------------------------ simple pairing --------
def islands_in_row(segs: Column, gap: float = P.UTTERANCE_GAP_S) -> Column:
    """ARRAY<ARRAY<segment>>: groups separated by more than `gap` of silence."""
    breaks = F.filter(F.sequence(F.lit(0), F.size(segs) - 1), lambda i: (i == 0) | (
        F.get(segs, i)["t0"] - F.get(segs, i - 1)["t1"] > gap))
    return bound(breaks, lambda b: F.transform(b, lambda start, k: F.slice(
        segs, start + 1, F.coalesce(F.get(b, k + 1), F.size(segs)) - start)))


def pick_utterance_in_row(segs: Column, narration: Column) -> Column:
    def rate(groups: Column) -> Column:
        scored = F.transform(groups, lambda g, k: F.struct(
            F.abs((F.element_at(g, -1)["t1"] - F.get(g, F.lit(0))["t0"]) - narration).alias("d"),
            k.alias("k"), g.alias("g")))
        return F.array_min(scored)["g"]

    return bound(islands_in_row(segs), rate)


def merge_to_in_row(segs: Column, wanted: Column) -> Column:
    """The array form of joining segments across their shortest gaps."""
    gaps = F.transform(F.slice(segs, F.lit(2), F.size(segs)), lambda s, k: F.struct(
        (s["t0"] - F.get(segs, k)["t1"]).alias("gap"), (k + 1).alias("k")))
    closed = F.transform(F.slice(F.array_sort(gaps), F.lit(1), F.greatest(
        F.size(segs) - wanted, F.lit(0))), lambda g: g["k"])

    def join(shut: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(segs) - 1),
                         lambda i: ~F.array_contains(shut, i))
        return bound(opens, lambda o: F.transform(o, lambda a, k: span(
            F.get(segs, a)["t0"], F.get(segs, F.coalesce(F.get(o, k + 1), F.size(segs)) - 1)["t1"])))

    return bound(closed, join)


def plan_alignment(narr: Column, clip: Column, target: Column, clip_len: Column) -> Column:
    """STRUCT<mode, phrases, map> by the simple pairing: equal counts of segments, else one
    span, else null."""

    def pair(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.struct(
            x["t0"].alias("ns"), x["t1"].alias("ne"), y["t0"].alias("cs"), y["t1"].alias("ce")))

    def attempt(picked: Column, mode: str, n: Column) -> Column:
        pairs = pair(merge_to_in_row(narr, n), merge_to_in_row(picked, n))
        return bound(pairs, lambda p: bound(time_map(p, target, clip_len), lambda m: F.when(
            m.isNotNull(), F.struct(F.lit(mode).alias("mode"), F.size(p).alias("phrases"),
                                    m.alias("map")))))

    def choose(picked: Column) -> Column:
        n = F.least(F.size(narr), F.size(picked))
        return F.coalesce(attempt(picked, "phrases", n),
                          F.when(n > 1, attempt(picked, "span", F.lit(1))))

    said = F.element_at(narr, -1)["t1"] - F.get(narr, F.lit(0))["t0"]
    return F.when((F.size(narr) > 0) & (F.size(clip) > 0),
                  bound(pick_utterance_in_row(clip, said), choose))


# ------------------------------------------------------------------ words -----------------
def matching_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of equal words, rising on both sides: the longest run that both lists share
    (the earliest in `a`, then in `b`), and the same again left and right of it. Words of `b` are
    listed by value once; a run is found by extending the runs that end one word earlier."""
    where: dict[str, list[int]] = {}
    for j, word in enumerate(b):
        where.setdefault(word, []).append(j)
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        best, ending = (0, 0, 0), {}
        for i in range(a0, a1):
            here = {}
            for j in where.get(a[i], ()):
                if b0 <= j < b1:
                    n = here[j] = ending.get(j - 1, 0) + 1
                    if n > best[0]:
                        best = (n, i - n + 1, j - n + 1)
            ending = here
        n, i, j = best
        if n:
            found += [(i + k, j + k) for k in range(n)]
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return sorted(found)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()),
                                         T.StructField("j", T.IntegerType())])))
def matched_words(script: pa.Array, heard: pa.Array) -> pa.Array:
    """Index pairs of words matched in order, by recursive longest matching block."""
    found = [matching_pairs(a, b) for a, b in zip(script.to_pylist(), heard.to_pylist())]
    sides = [pa.array([p[side] for pairs in found for p in pairs], pa.int32()) for side in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                                    pa.StructArray.from_arrays(sides, ["i", "j"]))


matched_words = matched_words.asNondeterministic()  # keeps filters from re-running it


def align_words(rows: DataFrame, text: str = "text", heard: str = "heard") -> DataFrame:
    """rows(text STRING, heard ARRAY<STRING>) -> adds script_words, pairs, coverage, extra,
    trailing_extra, usable."""
    base = settled(rows, **{"script_words": words_of(F.col(text)), heard: F.col(heard)}).select(*rows.columns, "script_words")
    pairs = base.withColumn("pairs", matched_words(
        matching_words(F.col("script_words")), matching_words(F.col(heard))))
    n = F.size("pairs")
    first_j, last_j = F.get("pairs", F.lit(0))["j"], F.element_at("pairs", -1)["j"]
    extra = F.when(n == 0, F.size(heard)).otherwise((last_j - first_j + 1) - n + first_j)
    trailing = F.when(n == 0, F.lit(0)).otherwise(F.size(heard) - 1 - last_j)
    out = pairs.withColumn("coverage", F.when(n == 0, F.lit(0.0)).otherwise(
        round_exact(n / F.greatest(F.lit(1), F.size("script_words")), 3))).withColumn(
        "extra", extra).withColumn("trailing_extra", trailing)
    return out.withColumn("usable", transcript_usable(F.col("coverage"), F.col("extra"),
                                                      F.size("script_words")))


def transcript_usable(coverage: Column, extra: Column, n_words: Column) -> Column:
    return (coverage >= 0.85) & (extra <= F.greatest(F.lit(2), F.floor(n_words / 8)))
