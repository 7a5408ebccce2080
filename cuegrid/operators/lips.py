"""Re-voicing a clip: phrases with the lips' timing, pace, cuts and the final window."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuegrid import params as P
from cuegrid.functions.rounding import round_exact
from cuegrid.functions.scalars import clamp, count_syllables, frame_aligned
from cuegrid.functions.text import bound
from cuegrid.operators.intervals import (cut_clock, locate_in_row, long_gaps, merge_overlaps,
                                         nearest_in_row, push_later)
from cuegrid.operators.rows import settled, unfold
from cuegrid.session import cut_lineage


def phrase_ranges(firsts: Column, n: Column) -> Column:
    """ARRAY<STRUCT<first_ix,i0,i1>>: word ranges that cover 0..n-1, split before each first
    matched word; the first range begins at 0."""
    return F.transform(firsts, lambda f, k: F.struct(
        f.alias("first_ix"), F.when(k == 0, F.lit(0)).otherwise(f).alias("i0"),
        (F.coalesce(F.get(firsts, k + 1), n) - 1).alias("i1")))


def balanced_groups(syllables: list[int], heard: list[int], seconds: list[float]) -> list[int]:
    """How many words each heard segment gets (in order, at least one each), trading an even
    speaking pace against moving words away from where they were heard."""
    n, m = len(syllables), len(seconds)
    if m < 2:
        return [n] if m else []
    rank = {s: k for k, s in enumerate(sorted(set(heard)))}
    place = [rank[h] for h in heard]
    said = [0]
    for s in syllables:
        said.append(said[-1] + s)
    pace = said[n] / sum(seconds)
    best, back = {0: 0.0}, []
    for p in range(m):
        drift = [0]
        for q in place:
            drift.append(drift[-1] + abs(q - p))
        step, came = {}, {}
        for stop in range(p + 1, n - (m - p - 1) + 1):
            for start, so_far in best.items():
                if start < stop:
                    cost = so_far + math.log((said[stop] - said[start]) / seconds[p] / pace) ** 2 \
                        + P.HEARD_WEIGHT * (drift[stop] - drift[start])
                    if stop not in step or cost < step[stop]:
                        step[stop], came[stop] = cost, start
            # starts are tried in rising order, so equal costs keep the earliest
        best = step
        back.append(came)
    sizes, stop = [], n
    for came in reversed(back):
        sizes.append(stop - came[stop])
        stop = came[stop]
    return sizes[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _balance_udf(syllables: pd.Series, heard: pd.Series, seconds: pd.Series) -> pd.Series:
    return pd.Series([balanced_groups(a.tolist(), b.tolist(), c.tolist())
                      for a, b, c in zip(syllables, heard, seconds)])


_balance_udf = _balance_udf.asNondeterministic()  # keeps filters from re-running it


def make_chunks(rows: DataFrame, key: str) -> DataFrame:
    """Phrases of a line with the lips' timing.

    rows(key, script_words, pairs ARRAY<STRUCT<i,j>>, words ARRAY<STRUCT<t0,t1>>, speech
    ARRAY<STRUCT<seg_ix,t0,t1>>[, onsets ARRAY<DOUBLE>]) -> (key, ix, text, t0, t1, seg_ix). A
    pair is a word's place in `script_words` and in `words`. A row is one scene, its few words and
    its clip's segments, so all of it is planned inside the row and nothing is shuffled. onsets:
    when the mouth visibly starts; a phrase does not start before that."""
    told = F.filter(F.transform(F.array_sort("pairs"), lambda p: F.struct(
        p["i"].alias("i"), F.get("words", p["j"]).alias("w"))), lambda x: x["w"].isNotNull())
    heard = bound(told, lambda found: bound(
        F.transform(found, lambda x: locate_in_row(x["w"]["t0"], x["w"]["t1"], F.col("speech"))),
        lambda at: F.transform(found, lambda x, k: F.struct(
            x["i"].alias("i"), F.array_max(F.slice(at, F.lit(1), k + 1)).alias("heard")))))
    lines = settled(rows, h=heard)
    used = F.transform("h", lambda w: w["heard"])
    lines = settled(lines, segs=F.array_sort(F.transform(
        F.filter("speech", lambda s: F.array_contains(used, s["seg_ix"])),
        lambda s: F.struct(s["seg_ix"].alias("seg_ix"), s["t0"].alias("t0"), s["t1"].alias("t1")))))
    lines = lines.where((F.size("h") > 0) & (F.size("segs") > 0))
    syl = F.transform("h", lambda w: count_syllables(F.get(F.col("script_words"), w["i"])))
    seconds = F.transform("segs", lambda s: F.greatest(F.lit(0.15), s["t1"] - s["t0"]))
    lines = lines.withColumn("_n", _balance_udf(syl, used, seconds))
    firsts = F.transform("_n", lambda _, k: F.get("h", F.aggregate(
        F.slice(F.col("_n"), F.lit(1), k), F.lit(0), lambda a, c: a + c))["i"])
    ranged = settled(lines, _r=bound(firsts, lambda f: phrase_ranges(f, F.size("script_words"))))

    def chunk(r: Column, seg: Column) -> Column:
        start = shift_to_mouth(seg["t0"], seg["t1"], F.col("onsets")) if "onsets" in rows.columns else seg["t0"]
        return F.struct(
            F.array_join(F.slice("script_words", r["i0"] + 1, r["i1"] - r["i0"] + 1), " ").alias("text"),
            start.alias("t0"), seg["t1"].alias("t1"), seg["seg_ix"].alias("seg_ix"))

    chunks = F.transform("_r", lambda r, k: bound(F.get("segs", k), lambda seg: chunk(r, seg)))
    return unfold(ranged, chunks, "ix", "c", key).select(key, "ix", "c.*")


def shift_to_mouth(start: Column, end: Column, onsets: Column) -> Column:
    """Where a phrase starts: shortly after the mouth does, at most 0.1 s later than it was."""

    def moved(found: Column) -> Column:
        seen = found + P.LIP_LEAD_S
        late = found.isNotNull() & (start < seen) & (seen < end - 0.15)
        return F.when(late, F.least(seen, start + P.MOUTH_MAX_SHIFT_S)).otherwise(start)

    return bound(nearest_in_row(start, onsets), moved)


def plan_cuts(speech: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Clip ranges (key, t0, t1) to drop: speech between the first and the last used segment
    that no phrase uses, and the excess of long pauses between the segments kept."""
    marks = used.select(key, "seg_ix").distinct()
    ends = marks.groupBy(key).agg(F.min("seg_ix").alias("_lo"), F.max("seg_ix").alias("_hi"))
    inside = speech.join(ends, key).where(F.col("seg_ix").between(F.col("_lo"), F.col("_hi")))
    flagged = cut_lineage(inside.join(marks.withColumn("_used", F.lit(True)), [key, "seg_ix"],
                                      "left"))
    extra = F.col("_used").isNull() & (F.col("t1") - F.col("t0") >= P.MIN_SPEECH_S)
    unscripted = flagged.where(extra).select(key, (F.col("t0") - 0.04).alias("t0"),
                                             (F.col("t1") + 0.04).alias("t1"))
    pauses = long_gaps(flagged.where(~extra).select(key, "seg_ix", "t0", "t1"), key)
    return merge_overlaps(unscripted.unionByName(pauses), key)


def smooth_pace(chunks: DataFrame, key: str) -> DataFrame:
    """chunks(key, ix, t0, t1, natural) -> adds `fit`: seconds to speak each phrase in, its
    speed held within 12 % of the scene's duration-weighted geometric mean."""
    speed = F.col("natural") / F.greatest(F.lit(0.15), F.col("t1") - F.col("t0"))
    pace = chunks.where("natural > 0").groupBy(key).agg(F.exp(
        F.sum(F.log(speed) * F.col("natural")) / F.sum("natural")).alias("_pace"))
    out = chunks.join(pace, key, "left")
    held = clamp(speed, F.col("_pace") / (1 + P.PACE_SPREAD), F.col("_pace") * (1 + P.PACE_SPREAD))
    return out.withColumn("fit", F.coalesce(F.try_divide(F.col("natural"), held), F.lit(0.0))
                          ).drop("_pace")


def plan_window(chunks: DataFrame, cuts: DataFrame, clips: DataFrame, key: str,
                rule: P.Sync = P.Sync(), fps: int = 24) -> tuple[DataFrame, DataFrame]:
    """chunks(key, ix, t0, t1, voiced), cuts(key, t0, t1), clips(key, clip_len) ->
    (scenes(key, w0, w1, dur, freeze_pad), chunks with `place`)."""
    begin = chunks.groupBy(key).agg(F.min_by("t0", "ix").alias("_first"))
    w0 = begin.select(key, F.greatest(F.lit(0.0), F.col("_first") - rule.fit_lead).alias("w0"))
    frames = cuts.join(w0, key).where(F.col("t0") >= F.col("w0")).select(
        key, (F.rint(F.col("t0") * fps) / fps).alias("a"), (F.rint(F.col("t1") * fps) / fps).alias("b"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("t0").alias("t")),
                             F.struct(F.lit(1).alias("side"), F.col("t1").alias("t"))))
    points = chunks.join(w0, key).select(key, "ix", "w0", ends.alias("x")).select(
        key, "ix", "w0", "x.side", "x.t")
    clock = cut_lineage(cut_clock(points, frames, key, ["ix", "side"]))
    starts = clock.where("side = 0").select(key, "ix", "out")
    placed = cut_lineage(push_later(chunks.join(starts, [key, "ix"]), key))
    lip_end = clock.where("side = 1").groupBy(key).agg(F.max_by("out", "ix").alias("_lips"))
    voice_end = placed.groupBy(key).agg(F.max(F.col("place") + F.col("voiced")).alias("_voice"))
    gone = frames.groupBy(key).agg(F.sum(F.col("b") - F.col("a")).alias("_gone"))
    scenes = w0.join(lip_end, key).join(voice_end, key).join(gone, key, "left").join(clips, key)
    dur = frame_aligned(F.greatest("_voice", "_lips") + rule.fit_tail, fps)
    w1 = F.col("w0") + dur + F.coalesce("_gone", F.lit(0.0))
    return scenes.select(key, "w0", w1.alias("w1"), dur.alias("dur"), round_exact(
        F.greatest(F.lit(0.0), w1 - F.col("clip_len")), 3).alias("freeze_pad")), placed


def next_rate(rate: Column, measured: Column, target: Column) -> Column:
    """Corrected speaking rate after a take, or null when the take is close enough or the
    correction would be too small."""
    new = round_exact(clamp(rate * measured / F.greatest(target, F.lit(0.1)), *P.RATE_RANGE), 2)
    close = F.abs(measured - target) <= 0.04 * target
    return F.when(~close & (F.abs(new - rate) >= 0.01), new)


def settle_takes(takes: DataFrame, keys: list[str]) -> DataFrame:
    """takes(keys, try_no, rate, measured, target) -> the closest take per phrase (the first
    on ties) and the tempo that trims the rest, in its bounds."""
    best = takes.groupBy(*keys).agg(F.min_by(
        F.struct("rate", "measured", "target", "try_no"),
        F.struct(F.abs(F.col("measured") - F.col("target")), "try_no", "rate",
                 "measured")).alias("b"))
    tempo = clamp(F.col("b.measured") / F.greatest(F.col("b.target"), F.lit(0.1)), *P.TRIM_RANGE)
    return best.select(*keys, "b.try_no", "b.rate", "b.measured",
                       tempo.alias("tempo"), (F.abs(tempo - 1) > 0.01).alias("stretch"))
