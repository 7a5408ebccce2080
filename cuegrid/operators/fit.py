"""Placing narration phrases on a clip's spoken phrases (the clip is the master).

A scene's speech segments are two small arrays in one row, limited by the clip's length.
Only two steps need a kernel (which run of segments is the line; which pauses pair up);
everything built on their answers is array columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuegrid import params as P
from cuegrid.functions.rounding import round_exact
from cuegrid.functions.scalars import clamp, frame_aligned
from cuegrid.functions.text import bound
from cuegrid.operators.intervals import overlap_join
from cuegrid.operators.rows import keep_parallel, settled, unfold

SPAN = "array<struct<t0:double,t1:double>>"


def field(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda s: s[name])


def add_up(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def span(a: Column, b: Column) -> Column:
    return F.struct(a.alias("t0"), b.alias("t1"))


# ------------------------------------------------------------------ segment filters -------
def long_segments(segs: Column, least: float = P.MIN_SPEECH_S) -> Column:
    """Segments of at least `least` seconds, or all when none is that long."""
    return bound(F.filter(segs, lambda s: s["t1"] - s["t0"] >= least),
                 lambda kept: F.when(F.size(kept) > 0, kept).otherwise(segs))


def without_end_touch(segs: Column, clip_len: Column) -> Column:
    """Without the last segment if it runs into the end of the clip."""
    touches = (F.size(segs) > 1) & (clip_len - F.element_at(segs, -1)["t1"] < P.END_TOUCH_S)
    return F.when(touches, F.slice(segs, F.lit(1), F.size(segs) - 1)).otherwise(segs)


def prune_edges(segs: Column) -> Column:
    """Without stray short sounds at either end: dropping stops at the first segment from
    the end (then from the start) that is long or close to its neighbour."""

    def stray(i: Column, j: Column) -> Column:
        s, n = F.get(segs, i), F.get(segs, j)
        apart = F.greatest(s["t0"] - n["t1"], n["t0"] - s["t1"])
        return (s["t1"] - s["t0"] < P.MIN_SPEECH_S) & (apart > P.EDGE_GAP_S)

    places = F.sequence(F.lit(0), F.size(segs) - 1)
    last = F.array_max(F.filter(places, lambda i: (i == 0) | ~stray(i, i - 1)))

    def from_start(stop: Column) -> Column:
        first = F.array_min(F.filter(places, lambda i: (i == stop) | (
            (i < stop) & ~stray(i, i + 1))))
        return bound(first, lambda a: F.slice(segs, a + 1, stop - a + 1))

    return F.when(F.size(segs) > 1, bound(last, from_start)).otherwise(segs)


# ------------------------------------------------------------------ kernels ---------------
def best_run(starts: np.ndarray, ends: np.ndarray, speech: float, clip_len: float,
             tolerance: float = P.RUN_TOLERANCE) -> tuple[int, int, float]:
    """First and last index of the run of segments that is the line, and the best score: the longest among the
    runs whose speaking time is within `tolerance` of the best match with `speech`.

    Speaking time grows with the run, so for each start both the closest run and the longest
    acceptable one are found by bisection; a run reaching the clip's end costs extra."""
    n = len(starts)
    total = np.concatenate([[0.0], np.cumsum(ends - starts)])
    touch = int(np.searchsorted(ends, clip_len - P.END_TOUCH_S, side="right"))
    fee = P.END_TOUCH_PENALTY

    def score(i: int, j: int) -> float:
        base = abs(math.log(speech / max(total[j + 1] - total[i], 1e-3)))
        return base + (fee if j > i and j >= touch else 0.0)

    def zones(i: int):
        free = max(i, touch - 1)
        yield i, min(free, n - 1), 0.0
        if max(i + 1, touch) <= n - 1:
            yield max(i + 1, touch), n - 1, fee

    best = math.inf
    for i in range(n):
        for low, high, _ in zones(i):
            k = int(np.searchsorted(total, total[i] + speech)) - 1
            for j in {min(max(k, low), high), min(max(k - 1, low), high)}:
                best = min(best, score(i, j))
    found = None
    for i in range(n):
        for low, high, extra in zones(i):
            room = best + tolerance - extra
            if room < 0:
                continue
            j = int(np.searchsorted(total, total[i] + speech * math.exp(room) + 1e-12,
                                    side="right")) - 2
            j = min(max(j, low), high)
            while j > low and score(i, j) > best + tolerance:
                j -= 1
            s = score(i, j)
            rank = (j - i, -round(s, 9))
            if s <= best + tolerance and (found is None or rank > found[0]):
                found = (rank, i, j)
    return found[1], found[2], best


@F.pandas_udf(T.StructType([T.StructField("i", T.IntegerType()),
                            T.StructField("j", T.IntegerType()),
                            T.StructField("score", T.DoubleType())]))
def _run_udf(starts: pd.Series, ends: pd.Series, speech: pd.Series,
             clip_len: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_run(a, b, s or 1e-3, c) if len(a) else (-1, -1, math.nan)
                         for a, b, s, c in zip(starts, ends, speech, clip_len)],
                        columns=["i", "j", "score"])


# Marked nondeterministic so that filters on their results are not pushed below them, which
# would evaluate them twice (or inside a lambda, where Python cannot run).
_run_udf = _run_udf.asNondeterministic()


def pairings(narr: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[list[int]]:
    """For every (bonus, ratio bounds) of the search grid: how the two sides pair up, as the
    flat list n1, c1, n2, c2, ... of how many segments of each side are used up after each
    phrase. No consistent pairing gives one phrase. The phrase costs do not depend on the
    grid, so they are computed once."""
    n, m = len(narr), len(clip)
    moves = []
    for stop_n in range(1, n + 1):
        for stop_c in range(1, m + 1):
            into = []
            for i in range(max(0, stop_n - P.MAX_GROUP), stop_n):
                spoken = narr[stop_n - 1][1] - narr[i][0]
                for p in range(max(0, stop_c - P.MAX_GROUP), stop_c):
                    seen = clip[stop_c - 1][1] - clip[p][0]
                    rate = spoken / max(seen, 1e-3)
                    if rate > 0:
                        into.append((i, p, rate, math.log(rate) ** 2 * (spoken + seen)))
            moves.append((stop_n, stop_c, into))
    out = []
    for bonus in P.SEARCH_BONUS:
        for low, high in P.SEARCH_RATIO:
            cost = {(0, 0): (0.0, None)}
            for stop_n, stop_c, into in moves:
                top = None
                for i, p, rate, price in into:
                    if low <= rate <= high and (i, p) in cost:
                        c = cost[i, p][0] + price - bonus
                        if top is None or c < top[0]:
                            top = (c, (i, p))
                if top is not None:
                    cost[stop_n, stop_c] = top
            path, at = [], (n, m)
            if at not in cost:
                path = [n, m]
            while at in cost and at != (0, 0):
                path = [*at, *path]
                at = cost[at][1]
            out.append(path)
    return out


#: Pairs of sides whose pairings are computed together, at most, and from how many on that pays.
TOGETHER, FEW = 1024, 8


def pairings_of_many(sides: list[tuple]) -> list[list[list[int]]]:
    """`pairings` of every (narration, clip) of a list: those of the same two sizes go through the
    search together, as columns, with the same operations in the same order."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (narr, clip) in enumerate(sides):
        shapes.setdefault((len(narr), len(clip)), []).append(k)
    out: list = [None] * len(sides)
    for (n, m), places in shapes.items():
        for at in range(0, len(places), TOGETHER):
            part = places[at:at + TOGETHER]
            if len(part) < FEW or not n or not m:
                found = [pairings(*sides[k]) for k in part]
            else:
                found = _pairings_alike(np.array([sides[k][0] for k in part], float), np.array([sides[k][1] for k in part], float))
            for k, paths in zip(part, found):
                out[k] = paths
    return out


def _pairings_alike(narr: np.ndarray, clip: np.ndarray) -> list[list[list[int]]]:
    """`pairings` of sides of one shape: narr[pair, segment, (start, end)], clip likewise."""
    grid = [(bonus, low, high) for bonus in P.SEARCH_BONUS for low, high in P.SEARCH_RATIO]
    bonus, low, high = (np.array(x) for x in zip(*grid))
    count, n, m = len(narr), narr.shape[1], clip.shape[1]
    cost = {(0, 0): np.zeros((count, len(grid)))}  # infinite where nothing leads to
    came: dict[tuple[int, int], np.ndarray] = {}
    for stop_n in range(1, n + 1):
        for stop_c in range(1, m + 1):
            top, back = np.full((count, len(grid)), np.inf), np.full((count, len(grid)), -1)
            for i in range(max(0, stop_n - P.MAX_GROUP), stop_n):
                spoken = narr[:, stop_n - 1, 1] - narr[:, i, 0]
                for p in range(max(0, stop_c - P.MAX_GROUP), stop_c):
                    if (i, p) not in cost:
                        continue
                    seen = clip[:, stop_c - 1, 1] - clip[:, p, 0]
                    rate = spoken / np.maximum(seen, 1e-3)
                    fits = (low <= rate[:, None]) & (rate[:, None] <= high) & (rate[:, None] > 0)
                    some = np.flatnonzero(fits.any(axis=1))
                    if not len(some):
                        continue
                    price = np.zeros(count)
                    price[some] = [math.log(r) ** 2 for r in rate[some].tolist()]
                    c = cost[i, p] + (price * (spoken + seen))[:, None] - bonus
                    better = fits & (c < top)
                    top[better], back[better] = c[better], i * (m + 1) + p
            cost[stop_n, stop_c], came[stop_n, stop_c] = top, back
    steps = {at: back.tolist() for at, back in came.items()}
    out = []
    for k in range(count):
        paths = []
        for g in range(len(grid)):
            path, at = [], (n, m)
            if steps[at][k][g] < 0:
                path = [n, m]
            else:
                while at != (0, 0):
                    path = [*at, *path]
                    at = divmod(steps[at][k][g], m + 1)
            paths.append(path)
        out.append(paths)
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))
def _pair_udf(n0: pd.Series, n1: pd.Series, c0: pd.Series, c1: pd.Series) -> pd.Series:
    rows = [(list(zip(a.tolist(), b.tolist())), [list(zip(s.tolist(), e.tolist())) for s, e in zip(c, d)]) for a, b, c, d in zip(n0, n1, c0, c1)]
    found = iter(pairings_of_many([(narr, clip) for narr, clips in rows for clip in clips]))
    return pd.Series([[next(found) for _ in clips] for _, clips in rows])


_pair_udf = _pair_udf.asNondeterministic()


def select_speech(rows: DataFrame, clip: str = "clip", narr: str = "narr",
                  clip_len: Column | None = None, out: str = "line") -> DataFrame:
    """Adds `out`: the run of the clip's segments that is the scene's line."""
    pruned = rows.withColumn("_p", prune_edges(F.col(clip)))
    speech = add_up(F.transform(F.col(narr), lambda s: s["t1"] - s["t0"]))
    limit = F.lit(1e12) if clip_len is None else clip_len
    cut = pruned.withColumn("_r", _run_udf(field(F.col("_p"), "t0"), field(F.col("_p"), "t1"),
                                           speech, limit.cast("double")))
    return cut.withColumn(out, F.when(F.col("_r.i") >= 0, F.slice(
        F.col("_p"), F.col("_r.i") + 1, F.col("_r.j") - F.col("_r.i") + 1))
        .otherwise(F.array().cast(SPAN))).withColumn(out + "_score", F.col("_r.score")).drop(
        "_p", "_r")


def selections(rows: DataFrame, clip_len: Column) -> DataFrame:
    """Scenes with speech on both sides, with `sels` ARRAY<STRUCT<ix,segs>>: the distinct choices of clip
    segments, three at most: the run that is the line, all long segments, those that end before the clip."""
    chosen = select_speech(rows.where((F.size("narr") > 0) & (F.size("clip") > 0)), clip_len=clip_len)
    real = chosen.withColumn("_real", long_segments(F.col("clip")))
    sels = F.filter(F.array_distinct(F.array(
        F.col("line").cast(SPAN), F.col("_real").cast(SPAN),
        without_end_touch(F.col("_real"), clip_len).cast(SPAN))), lambda s: F.size(s) > 0)
    return real.select(*rows.columns, F.transform(sels, lambda s, k: F.struct(k.alias("ix"), s.alias("segs"))).alias("sels"))


def paths_of(sels: Column) -> Column:
    """Per selection of an array of them, its pairings under every search setting."""
    return _pair_udf(field(F.col("narr"), "t0"), field(F.col("narr"), "t1"),
                     F.transform(sels, lambda s: field(s["segs"], "t0")), F.transform(sels, lambda s: field(s["segs"], "t1")))


def phrases_on(path: Column, sel: Column) -> Column:
    """ARRAY<STRUCT<ns,ne,cs,ce>> of a flat path n1, c1, n2, c2, ... over the row's narration and `sel`."""

    def phrase(k: Column) -> Column:
        def used(offset: int) -> Column:
            return F.coalesce(F.get(path, k * 2 - 2 + offset), F.lit(0))

        def upto(offset: int) -> Column:
            return F.get(path, k * 2 + offset) - 1

        return F.struct(F.get("narr", used(0))["t0"].alias("ns"), F.get("narr", upto(0))["t1"].alias("ne"),
                        F.get(sel, used(1))["t0"].alias("cs"), F.get(sel, upto(1))["t1"].alias("ce"))

    return F.transform(F.sequence(F.lit(0), F.floor(F.size(path) / 2).cast("int") - 1), phrase)


def candidates(rows: DataFrame, clip_len: Column, once: bool = False) -> DataFrame:
    """One row per distinct selection of clip segments and search setting, at most 18 per
    scene: adds sel_ix, sel, setting, phrases ARRAY<STRUCT<ns,ne,cs,ce>>. With `once`, of the settings of a
    selection that give equal phrases only the first. The full search; `cheapest` finds the same plan from fewer."""
    chosen = selections(rows, clip_len)
    paths = chosen.withColumn("_paths", paths_of(F.col("sels")))
    each = unfold(paths, F.arrays_zip("sels", "_paths"), "_k", "_s", *rows.columns).select(
        *rows.columns, F.col("_s.sels.ix").alias("sel_ix"), F.col("_s.sels.segs").alias("sel"), F.col("_s._paths").alias("_paths"))
    made = settled(each, _all=F.transform("_paths", lambda path: phrases_on(path, F.col("sel"))))
    listed = F.transform("_all", lambda p, i: F.struct(i.alias("setting"), p.alias("phrases")))
    if once:
        listed = F.filter(listed, lambda x: F.array_position("_all", x["phrases"]) == x["setting"] + 1)
    wide = unfold(made, listed, "_k", "_c", *rows.columns, "sel_ix", "sel")
    return wide.select(*rows.columns, "sel_ix", "sel", "_c.setting", "_c.phrases")


def cheapest(rows: DataFrame, clip_len: Column, plan, least) -> DataFrame:
    """Adds `best` STRUCT<cost,fewer,sel_ix,setting,phrases,body>, the cheapest candidate's plan (null if
    none has one), and `scored`, how many candidates were planned for it.

    plan(phrases) is STRUCT<cost,body> or null; least(segs), a bound below the cost of every plan on a
    selection, needs no pairing. The first selection is planned, and of the others only those whose
    bound does not exceed its cost, so most pairings are never computed. Settings that pair alike
    are planned once. All of it stays inside the scene's row. Equal costs: more segments, then the
    order of selections and settings."""

    def planned(base: DataFrame, sels: Column, best: str, count: str) -> DataFrame:
        def distinct(sel: Column, paths: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(paths) - 1),
                             lambda i: F.array_position(paths, F.get(paths, i)) == i + 1)
            return F.transform(first, lambda i: F.struct(
                sel["ix"].alias("ix"), F.size(sel["segs"]).alias("n"), i.alias("setting"),
                phrases_on(F.get(paths, i), sel["segs"]).alias("phrases")))

        tried = base.withColumn("_try", sels)
        tried = tried.withColumn("_paths", paths_of(F.col("_try")))
        listed = tried.withColumn("_list", F.flatten(F.transform("_try", lambda s, k: bound(
            F.get("_paths", k), lambda paths: distinct(s, paths)))))
        priced = F.transform("_list", lambda x: bound(plan(x["phrases"]), lambda p: F.when(p.isNotNull(), F.struct(
            p["cost"].alias("cost"), (-x["n"]).alias("fewer"), x["ix"].alias("sel_ix"), x["setting"].alias("setting"),
            x["phrases"].alias("phrases"), p["body"].alias("body")))))
        return listed.select(*base.columns, F.array_min(priced).alias(best), F.size("_list").alias(count))

    first = planned(selections(rows, clip_len), F.slice("sels", 1, 1), "_first", "_n")
    open_still = F.filter(F.slice("sels", F.lit(2), F.size("sels")), lambda s: F.col("_first").isNull() | (
        least(s["segs"]) <= F.col("_first.cost")))
    both = planned(first, open_still, "_more", "_m")
    return both.select(*rows.columns, F.array_min(F.array("_first", "_more")).alias("best"),
                       (F.col("_n") + F.col("_m")).alias("scored"))


# ------------------------------------------------------------------ plan columns ----------
def placements(phrases: Column, narr_len: Column, w0: Column) -> Column:
    """ARRAY<STRUCT<narr_start,narr_end,tempo,out_start>>: the narration cut in its pauses,
    each piece at the tempo that makes it as long as the lips move, its onset on the lips'."""
    n = F.size(phrases)

    def place(p: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0.0)).otherwise((F.get(phrases, k - 1)["ne"] + p["ns"]) / 2)
        stop = F.when(k == n - 1, narr_len).otherwise((p["ne"] + F.get(phrases, k + 1)["ns"]) / 2)
        tempo = clamp((p["ne"] - p["ns"]) / F.greatest(p["ce"] - p["cs"], F.lit(1e-3)),
                      *P.TEMPO_RANGE)
        return bound(F.struct(begin.alias("a"), stop.alias("b"), tempo.alias("v")),
                     lambda x: F.struct(
                         x["a"].alias("narr_start"), x["b"].alias("narr_end"),
                         x["v"].alias("tempo"), F.greatest(F.lit(0.0), (p["cs"] - w0)
                                                           - (p["ns"] - x["a"]) / x["v"])
                         .alias("out_start")))

    return F.transform(phrases, place)


def apart_seconds(first: Column, second: Column, total: Column) -> Column:
    """Seconds within [0, total) where exactly one of two interval arrays is on: the pieces
    between neighbouring edges are tested once each."""

    def inner(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), total)

    edges = F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0.0), total), *[F.transform(field(s, n), inner)
                                      for s in (first, second) for n in ("t0", "t1")])))

    def pieces(e: Column) -> Column:
        def on(segs: Column, x: Column) -> Column:
            return F.exists(segs, lambda s: (s["t0"] <= x) & (x < s["t1"]))

        def part(x: Column, i: Column) -> Column:
            return F.when((i + 1 < F.size(e)) & (on(first, x) != on(second, x)),
                          F.get(e, i + 1) - x).otherwise(F.lit(0.0))

        return add_up(F.transform(e, part))

    return F.round(bound(edges, pieces), 3)


def voice_spans(places: Column, narr: Column) -> Column:
    """Where the narration's speech lands on the scene's axis."""

    def one(p: Column) -> Column:
        cut = F.filter(narr, lambda s: F.least(s["t1"], p["narr_end"]) > F.greatest(
            s["t0"], p["narr_start"]))
        return F.transform(cut, lambda s: span(
            p["out_start"] + (F.greatest(s["t0"], p["narr_start"]) - p["narr_start"]) / p["tempo"],
            p["out_start"] + (F.least(s["t1"], p["narr_end"]) - p["narr_start"]) / p["tempo"]))

    return F.flatten(F.transform(places, one))


def lips_in_window(clip: Column, w0: Column, w1: Column) -> Column:
    inside = F.filter(clip, lambda s: (s["t1"] > w0) & (s["t0"] < w1))
    return F.transform(inside, lambda s: span(s["t0"] - w0, s["t1"] - w0))


def fit_plan(phrases: Column, narr_len: Column, clip_len: Column, rule: P.Sync = P.Sync(), fps: int = 24) -> Column:
    """STRUCT<w0,dur,places,freeze_pad,clamped,mismatch,mode> of paired phrases; the row holds clip and narr."""
    first, last = F.get(phrases, F.lit(0)), F.element_at(phrases, -1)

    def timed(x: Column) -> Column:
        tail = F.element_at(x["places"], -1)
        voice_end = tail["out_start"] + (last["ne"] - tail["narr_start"]) / tail["tempo"]
        dur = frame_aligned(F.greatest(last["ce"] - x["w0"], voice_end) + rule.fit_tail, fps)
        # a tempo equal to a bound is one that had to be clamped
        at_bound = F.size(F.filter(x["places"], lambda p: p["tempo"].isin(*P.TEMPO_RANGE)))
        return bound(dur, lambda d: F.struct(
            x["w0"].alias("w0"), d.alias("dur"), x["places"].alias("places"),
            round_exact(F.greatest(F.lit(0.0), x["w0"] + d - clip_len), 3).alias("freeze_pad"), at_bound.alias("clamped"),
            apart_seconds(lips_in_window(F.col("clip"), x["w0"], x["w0"] + d), voice_spans(x["places"], F.col("narr")), d
                          ).alias("mismatch"),
            F.when(F.size(phrases) > 1, "phrases").otherwise("span").alias("mode")))

    return bound(F.greatest(F.lit(0.0), first["cs"] - rule.fit_lead), lambda w0: bound(F.struct(
        w0.alias("w0"), placements(phrases, narr_len, w0).alias("places")), timed))


def fit_cost(plan: Column) -> Column:
    return round_exact(plan["mismatch"] + 0.05 * plan["clamped"] + 0.5 * plan["freeze_pad"], 3)


def fit_plans(cands: DataFrame, narr_len: Column, clip_len: Column,
              rule: P.Sync = P.Sync(), fps: int = 24) -> DataFrame:
    """Adds the plan of each candidate: w0, dur, places, freeze_pad, clamped, mismatch, mode."""
    return cands.withColumn("_f", fit_plan(F.col("phrases"), narr_len, clip_len, rule, fps)).select(*cands.columns, "_f.*")


def least_fit_cost(sel: Column, clip_len: Column, rule: P.Sync = P.Sync(), fps: int = 24) -> Column:
    """A bound below the cost of every plan on a selection, however its pauses pair up.

    The window begins at its first segment and lasts at least to its last one. Where the lips (disjoint
    segments) move in it for longer than the voice lasts at its slowest, they are alone; what the clip is too short
    for freezes. Two thousandths are left for rounding."""

    def price(w: Column) -> Column:
        lips = add_up(F.transform(F.col("clip"), lambda s: F.greatest(F.lit(0.0), F.least(
            s["t1"], w["w1"]) - F.greatest(s["t0"], w["w0"]))))
        voice = add_up(F.transform(F.col("narr"), lambda s: s["t1"] - s["t0"])) / P.TEMPO_RANGE[0]
        return (F.greatest(F.lit(0.0), lips - voice) + 0.5 * F.greatest(F.lit(0.0), w["w1"] - clip_len)) - 0.002

    return bound(F.greatest(F.lit(0.0), F.get(sel, F.lit(0))["t0"] - rule.fit_lead), lambda w0: bound(F.struct(
        w0.alias("w0"), (w0 + frame_aligned(F.element_at(sel, -1)["t1"] - w0 + rule.fit_tail, fps)).alias("w1")), price))


def plan_fit(rows: DataFrame, key: str, narr_len: str = "narr_len", clip_len: str = "clip_len",
             rule: P.Sync = P.Sync(), fps: int = 24) -> DataFrame:
    """Best plan per scene (none without speech on both sides): least disagreement, clamping
    and freezing; then more segments; then the order of the search. `scored`: candidates planned for it."""
    length = F.col(clip_len)

    def plan(phrases: Column) -> Column:
        return bound(fit_plan(phrases, F.col(narr_len), length, rule, fps),
                     lambda f: F.struct(fit_cost(f).alias("cost"), f.alias("body")))

    found = cheapest(keep_parallel(rows, key), length, plan, lambda sel: least_fit_cost(sel, length, rule, fps))
    f = F.col("best.body")
    return found.select(  # every scene with speech on both sides has a plan
        key, f["w0"].alias("w0"), (f["w0"] + f["dur"]).alias("w1"), f["dur"].alias("dur"), f["places"].alias("places"),
        f["freeze_pad"].alias("freeze_pad"), f["mismatch"].alias("mismatch"), f["mode"].alias("mode"),
        F.size("best.phrases").alias("n_phrases"), "scored")


# ------------------------------------------------------------------ table forms -----------
def placed_voice(segments: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """segments(key, ..., t0, t1) x pieces(key, ..., narr_start, narr_end, tempo, out_start)
    -> v0, v1 on the scene's axis, for long tables."""
    joined = overlap_join(segments, pieces, [key], ("t0", "t1"), ("narr_start", "narr_end"))
    low, high = F.greatest("t0", "narr_start"), F.least("t1", "narr_end")
    return joined.withColumn("v0", F.col("out_start") + (low - F.col("narr_start")) / F.col("tempo")
                             ).withColumn("v1", F.col("out_start") + (high - F.col("narr_start"))
                                          / F.col("tempo"))


def window_clip(segments: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Segments touching their scene's window(key, w0, w1), shifted to its axis."""
    return segments.join(windows, key).where((F.col("t1") > F.col("w0")) & (F.col("t0") < F.col("w1"))
                                             ).withColumn("s", F.col("t0") - F.col("w0")).withColumn(
        "e", F.col("t1") - F.col("w0"))
