"""Interval tables: complement, islands, merging, lookup, sweeping.

Tables are long (`key`, order, start, end); a key may own any share of the rows, so ordered
operators use chunked scans and range joins carry a time bucket next to the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid import params as P
from cuegrid.functions.text import bound
from cuegrid.operators.scan import scan
from cuegrid.session import cut_lineage

MIN_PIECE_S = 0.05
CHUNK_S = 3600.0


def time_chunk(t: str | Column, width: float = CHUNK_S) -> Column:
    column = F.col(t) if isinstance(t, str) else t
    return F.floor(column / F.lit(float(width)))


def placed_end(out_start: Column, start: Column, end: Column, tempo: Column) -> Column:
    return out_start + (end - start) / tempo


# ------------------------------------------------------------------ one table -------------
def complement(silences: DataFrame, clips: DataFrame, key: str = "clip_id",
               chunk_s: float = CHUNK_S) -> DataFrame:
    """Speech between silences. silences(key, s, e), clips(key, duration) ->
    (key, t0, t1); pieces of 0.05 s or less are dropped."""
    inside = silences.join(clips, key).select(
        key, F.greatest(F.lit(0.0), "s").alias("s"), F.least("e", "duration").alias("e"))
    order = ["s", "e"]
    ranked = scan(inside, [key], order, time_chunk("s", chunk_s),
                  maxes_before={"seen": F.col("e")})
    body = ranked.select(key, F.greatest(F.lit(0.0), F.coalesce("seen", F.lit(0.0))).alias("t0"),
                         F.col("s").alias("t1"))
    last = inside.groupBy(key).agg(F.max("e").alias("seen"))
    tail = clips.join(last, key, "left").select(
        key, F.greatest(F.lit(0.0), F.coalesce("seen", F.lit(0.0))).alias("t0"),
        F.col("duration").alias("t1"))
    return body.unionByName(tail).where(F.col("t1") - F.col("t0") > MIN_PIECE_S)


def islands(rows: DataFrame, key: str, gap: float = P.UTTERANCE_GAP_S,
            chunk_s: float = CHUNK_S) -> DataFrame:
    """Adds `island`: rises where the silence since the previous segment exceeds `gap`."""
    order = ["t0", "t1", "seg_ix"]
    apart = scan(rows, [key], order, time_chunk("t0", chunk_s), lags={"_end": F.col("t1")})
    apart = apart.withColumn("_new", F.coalesce(F.col("t0") - F.col("_end") > gap, F.lit(False))
                             .cast("int"))
    return scan(cut_lineage(apart), [key], order, time_chunk("t0", chunk_s),
                sums={"island": F.col("_new")}).drop("_end", "_new")


def merge_overlaps(rows: DataFrame, key: str, least: float = MIN_PIECE_S,
                   chunk_s: float = CHUNK_S) -> DataFrame:
    """(key, t0, t1) with overlapping or touching intervals merged, short results dropped."""
    order = ["t0", "t1"]
    base = rows.select(key, "t0", "t1")
    seen = scan(base, [key], order, time_chunk("t0", chunk_s), maxes_before={"_seen": F.col("t1")})
    seen = seen.withColumn("_new", (F.col("_seen").isNull() | (F.col("t0") > F.col("_seen")))
                           .cast("int")).drop("_seen")
    grouped = scan(cut_lineage(seen), [key], order, time_chunk("t0", chunk_s),
                   sums={"_g": F.col("_new")})
    return (grouped.groupBy(key, "_g").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
            .where(F.col("t1") - F.col("t0") >= least).drop("_g"))


def long_gaps(rows: DataFrame, key: str, longest: float = P.MAX_PAUSE_S,
              keep: float = P.KEEP_PAUSE_S, chunk_s: float = CHUNK_S) -> DataFrame:
    """(key, t0, t1): the part to cut out of each pause longer than `longest`."""
    nxt = scan(rows, [key], ["t0", "t1", "seg_ix"], time_chunk("t0", chunk_s),
               leads={"_next": F.col("t0")})
    return nxt.where(F.col("_next") - F.col("t1") > longest).select(
        key, (F.col("t1") + keep / 2).alias("t0"), (F.col("_next") - keep / 2).alias("t1"))


def merge_to(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Join segments across their shortest gaps until `wanted` (in sizes(key, wanted)) are
    left. A merge never changes another gap, so the gaps to close are the first
    `size - wanted` by (gap, position), and what is left is islands."""
    order = ["seg_ix"]
    place = F.floor(F.col("seg_ix") / 4096)
    gaps = scan(rows, [key], order, place, lags={"_end": F.col("t1")}, counts="_size")
    gaps = gaps.withColumn("_gap", F.col("t0") - F.col("_end"))
    inner = cut_lineage(gaps.where(F.col("_gap").isNotNull()).select(key, "seg_ix", "_gap", "_size"))
    ranked = scan(inner, [key], ["_gap", "seg_ix"], F.floor(F.col("_gap") * 100), number="_rank")
    closed = (ranked.join(sizes.select(key, "wanted"), key)
              .where(F.col("_rank") <= F.col("_size") - F.col("wanted"))
              .select(key, "seg_ix", F.lit(1).alias("_closed")))
    flagged = rows.select(key, "seg_ix", "t0", "t1").join(closed, [key, "seg_ix"], "left").withColumn(
        "_new", F.when(F.col("_closed").isNull(), 1).otherwise(0))
    groups = scan(cut_lineage(flagged), [key], order, place, sums={"_g": F.col("_new")})
    return groups.groupBy(key, F.col("_g").cast("int").alias("seg_ix")).agg(
        F.min("t0").alias("t0"), F.max("t1").alias("t1")).withColumn(
        "seg_ix", F.col("seg_ix") - 1)


def pick_island(rows: DataFrame, lengths: DataFrame, key: str,
                gap: float = P.UTTERANCE_GAP_S) -> DataFrame:
    """Segments of the island whose extent is closest to `narration` in lengths(key,
    narration); the earlier one on ties."""
    marked = cut_lineage(islands(rows, key, gap))
    extent = marked.groupBy(key, "island").agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    best = extent.join(lengths.select(key, "narration"), key).groupBy(key).agg(
        F.min_by("island", F.struct(F.abs((F.col("b") - F.col("a")) - F.col("narration")),
                                    "island")).alias("island"))
    return marked.join(best, [key, "island"])


def midpoint_cuts(phrases: DataFrame, key: str) -> DataFrame:
    """phrases(key, ix, start, end, length): the piece of its side each phrase owns, cut in
    the middle of the pauses; the first begins at 0, the last ends at `length`."""
    near = scan(phrases, [key], ["ix"], F.floor(F.col("ix") / 4096),
                lags={"_pe": F.col("end")}, leads={"_ns": F.col("start")})
    return near.withColumn("cut0", F.when(F.col("_pe").isNull(), F.lit(0.0)).otherwise(
        (F.col("_pe") + F.col("start")) / 2)).withColumn(
        "cut1", F.when(F.col("_ns").isNull(), F.col("length")).otherwise(
            (F.col("end") + F.col("_ns")) / 2)).drop("_pe", "_ns")


# ------------------------------------------------------------------ two tables ------------
def _buckets(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 left_span: tuple[str, str], right_span: tuple[str, str],
                 width: float = 10.0) -> DataFrame:
    """Pairs of the same key whose half-open spans overlap.

    Spans are spread over time buckets so that the join is an equi join on (keys, bucket);
    a pair that shares several buckets is kept only in the one where its overlap begins."""
    a, b = left_span
    c, d = right_span
    lhs = left.where(F.col(b) > F.col(a)).withColumn("_bucket",
                                                     _buckets(F.col(a), F.col(b), width))
    rhs = right.where(F.col(d) > F.col(c)).withColumn("_bucket",
                                                      _buckets(F.col(c), F.col(d), width))
    joined = lhs.join(rhs, [*keys, "_bucket"])
    return joined.where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
                        & (F.col("_bucket") == F.floor(F.greatest(a, c) / width))).drop("_bucket")


def nearest_within(points: DataFrame, marks: DataFrame, keys: Sequence[str], near: str, mark: str,
                   ident: Sequence[str], window: float = P.MOUTH_WINDOW_S) -> DataFrame:
    """points plus `found`: the mark nearest to `near` within +/- window (earlier on ties),
    or null. A point looks into the two or three buckets its window touches."""
    spread = points.withColumn("_bucket", _buckets(F.col(near) - window, F.col(near) + window,
                                                   window))
    held = marks.select(*keys, F.col(mark).alias("_mark"),
                        F.floor(F.col(mark) / window).alias("_bucket"))
    hits = spread.join(held, [*keys, "_bucket"]).where(
        F.col("_mark").between(F.col(near) - window, F.col(near) + window))
    best = hits.groupBy(*keys, *ident).agg(F.min(F.struct(
        F.abs(F.col("_mark") - F.col(near)).alias("d"), F.col("_mark").alias("t"))).alias("_b"))
    return points.join(best.select(*keys, *ident, F.col("_b.t").alias("found")),
                       [*keys, *ident], "left")


def locate(points: DataFrame, segments: DataFrame, key: str, ident: str = "word_ix",
           chunk_s: float = CHUNK_S, width: float = 10.0) -> DataFrame:
    """points(key, ident, t0, t1) plus `seg_ix`: the segment containing the probe near the
    point's end; else the one it overlaps most; else the one with the nearest edge.

    Segments are disjoint, so containment and nearest edge only concern the last segment
    starting at or before the probe and the first one after it, which a scan over the union
    of both tables carries along; only the overlap tier needs a (bucketed) range join."""
    probe = F.greatest(F.col("t0"), F.col("t1") - 0.05)
    seg = F.struct(F.col("a"), F.col("seg_ix"), F.col("b"))
    none = F.lit(None).cast("double")
    both = points.select(key, ident, "t0", "t1", probe.alias("_p"), F.lit(1).alias("_kind"),
                         none.alias("a"), none.alias("b"), F.lit(None).cast("int").alias("seg_ix")
                         ).unionByName(segments.select(
                             key, F.lit(None).cast("long").alias(ident), none.alias("t0"),
                             none.alias("t1"), F.col("t0").alias("_p"), F.lit(0).alias("_kind"),
                             F.col("t0").alias("a"), F.col("t1").alias("b"), "seg_ix"))
    seen = scan(both, [key], ["_p", "_kind", ident, "seg_ix"], time_chunk("_p", chunk_s),
                maxes_before={"_prev": F.when(F.col("_kind") == 0, seg)},
                mins_after={"_next": F.when(F.col("_kind") == 0, seg)}).where("_kind = 1")
    prev, nxt = F.col("_prev"), F.col("_next")

    def edge(s: Column) -> Column:
        return F.least(F.abs(s["a"] - F.col("_p")), F.abs(s["b"] - F.col("_p")))

    inside = F.when(prev["b"] > F.col("_p"), prev["seg_ix"])
    nearest = F.when(nxt.isNull() | (edge(prev) <= edge(nxt)), prev["seg_ix"]).otherwise(
        nxt["seg_ix"])
    placed = cut_lineage(seen.select(key, ident, "t0", "t1", inside.alias("_in"),
                                     nearest.alias("_near")))
    loose = placed.where("_in is null").select(key, ident, "t0", "t1")
    spans = segments.select(key, F.col("t0").alias("a"), F.col("t1").alias("b"), "seg_ix")
    most = overlap_join(loose, spans, [key], ("t0", "t1"), ("a", "b"), width).groupBy(
        key, ident).agg(F.min_by("seg_ix", F.struct(
            -(F.least("b", "t1") - F.greatest("a", "t0")), "seg_ix")).alias("_most"))
    return placed.join(most, [key, ident], "left").select(
        key, ident, "t0", "t1", F.coalesce("_in", "_most", "_near").alias("seg_ix"))


# ------------------------------------------------------------------ two arrays ------------
def nearest_in_row(near: Column, marks: Column, window: float = P.MOUTH_WINDOW_S) -> Column:
    """The array form of :func:`nearest_within`: the mark nearest to `near`, or null."""
    close = F.filter(marks, lambda m: m.between(near - window, near + window))
    return F.array_min(F.transform(close, lambda m: F.struct(
        F.abs(m - near).alias("d"), m.alias("t"))))["t"]


def locate_in_row(t0: Column, t1: Column, segments: Column) -> Column:
    """The array form of :func:`locate`: `seg_ix` of the segment, of the row's few segments
    ARRAY<STRUCT<seg_ix,t0,t1>>, that a point belongs to."""

    def find(probe: Column) -> Column:
        seg = F.transform(segments, lambda s: F.struct(
            s["t0"].alias("a"), s["seg_ix"].alias("seg_ix"), s["t1"].alias("b")))
        # null starts come first, as in the scan
        ahead = F.array_max(F.filter(seg, lambda s: s["a"].isNull() | (s["a"] <= probe)))
        behind = F.array_min(F.filter(seg, lambda s: s["a"].isNotNull() & (
            probe.isNull() | (s["a"] > probe))))

        def edge(s: Column) -> Column:
            return F.least(F.abs(s["a"] - probe), F.abs(s["b"] - probe))

        def choose(sides: Column) -> Column:
            prev, nxt = sides["prev"], sides["next"]
            shared = F.filter(seg, lambda s: (t1 > t0) & (s["b"] > s["a"]) & (t0 < s["b"]) & (s["a"] < t1))
            most = F.array_min(F.transform(shared, lambda s: F.struct(
                (-(F.least(s["b"], t1) - F.greatest(s["a"], t0))).alias("d"), s["seg_ix"].alias("seg_ix"))))["seg_ix"]
            nearest = F.when(nxt.isNull() | (edge(prev) <= edge(nxt)), prev["seg_ix"]).otherwise(nxt["seg_ix"])
            return F.coalesce(F.when(prev["b"] > probe, prev["seg_ix"]), most, nearest)

        return bound(F.struct(ahead.alias("prev"), behind.alias("next")), choose)

    return bound(F.greatest(t0, t1 - 0.05), find)


# ------------------------------------------------------------------ clocks and sweeps -----
def cut_clock(points: DataFrame, cuts: DataFrame, key: str, ident: Sequence[str],
              chunk_s: float = CHUNK_S) -> DataFrame:
    """points(key, ident..., t, w0) plus `out`: time on the scene's axis once the (disjoint)
    cuts(key, a, b) are taken out: all lengths of cuts that began before t, less what of the
    last one still lies ahead."""
    none = F.lit(None).cast("double")
    named = [F.lit(None).alias(n) for n in ident]
    both = points.select(key, *ident, "t", "w0", F.lit(0).alias("_kind"), none.alias("a"),
                         none.alias("b")).unionByName(
        cuts.select(key, *named, F.col("a").alias("t"), none.alias("w0"),
                    F.lit(1).alias("_kind"), "a", "b"))
    seen = scan(both, [key], ["t", "_kind", *ident], time_chunk("t", chunk_s),
                sums_before={"_gone": F.when(F.col("_kind") == 1, F.col("b") - F.col("a"))
                             .otherwise(F.lit(0.0))},
                maxes_before={"_last": F.when(F.col("_kind") == 1, F.struct("a", "b"))})
    ahead = F.greatest(F.lit(0.0), F.coalesce(F.col("_last.b"), F.lit(0.0)) - F.col("t"))
    return seen.where("_kind = 0").select(
        key, *ident, "t", (F.col("t") - F.col("w0") - (F.col("_gone") - ahead)).alias("out"))


def push_later(chunks: DataFrame, key: str, gap: float = 0.04, place: str = "place") -> DataFrame:
    """chunks(key, ix, out, voiced) plus `place`: never before the previous chunk's end plus
    `gap`. With P(i) = the sum of (voiced + gap) before i, the chain unrolls to
    place(i) = P(i) + max over j <= i of (out(j) - P(j))."""
    chunk = F.floor(F.col("ix") / 4096)
    moved = scan(chunks, [key], ["ix"], chunk,
                 sums_before={"_p": F.col("voiced") + gap})
    lead = scan(cut_lineage(moved), [key], ["ix"], chunk, maxes={"_m": F.col("out") - F.col("_p")})
    return lead.withColumn(place, F.col("_p") + F.col("_m")).drop("_p", "_m")


def disagreement(first: DataFrame, second: DataFrame, windows: DataFrame, key: str,
                 chunk_s: float = CHUNK_S) -> DataFrame:
    """(key, seconds): time inside [w0, w1) of windows(key, w0, w1) in which exactly one of
    two interval tables (key, t0, t1) is on. An exact sweep over interval edges."""

    def edges(rows: DataFrame, a: int, b: int) -> DataFrame:
        inner = rows.join(windows.select(key, "w0", "w1"), key).select(
            key, F.greatest("t0", "w0").alias("s"), F.least("t1", "w1").alias("e")).where("e > s")
        return inner.select(key, F.explode(F.array(
            F.struct(F.col("s").alias("t"), F.lit(a).alias("da"), F.lit(b).alias("db")),
            F.struct(F.col("e").alias("t"), F.lit(-a).alias("da"), F.lit(-b).alias("db"))))
            .alias("x")).select(key, "x.*")

    steps = edges(first, 1, 0).unionByName(edges(second, 0, 1)).groupBy(key, "t").agg(
        F.sum("da").alias("da"), F.sum("db").alias("db"))
    level = scan(cut_lineage(steps), [key], ["t"], time_chunk("t", chunk_s),
                 sums={"a": F.col("da"), "b": F.col("db")}, leads={"_t": F.col("t")})
    apart = level.where((F.col("a") > 0) != (F.col("b") > 0)).groupBy(key).agg(
        F.sum(F.col("_t") - F.col("t")).alias("_s"))
    return windows.select(key).join(apart, key, "left").select(
        key, F.round(F.coalesce("_s", F.lit(0.0)), 3).alias("seconds"))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float],
                bucket: float) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of `shares`.

    Values are ranked by a chunked scan (chunks are value buckets of width `bucket`), so even
    a corpus-wide group is never gathered in one task."""
    keys = list(keys)
    fake = not keys
    base = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if fake:
        base, keys = base.withColumn("_all", F.lit(0)), ["_all"]
    # equal values are interchangeable, so they are reduced to (value, count) first
    counted = cut_lineage(base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    ranked = scan(counted, keys, ["_v"], F.floor(F.col("_v") / bucket),
                  sums_before={"_below": F.col("_c")})
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    picked = ranked.join(sizes, keys)
    out = []
    for name, share in shares.items():
        spot = F.lit(float(share)) * (F.col("_n") - 1)

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_c")),
                                F.col("_v")))

        low, high = at(F.floor(spot)), at(F.ceil(spot))
        part = F.max(spot - F.floor(spot))
        out.append((low + (high - low) * part).alias(name))
    done = picked.groupBy(*keys).agg(*out)
    return done.drop("_all") if fake else done
