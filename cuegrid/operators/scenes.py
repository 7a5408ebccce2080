"""Scripts to scenes: optimal grouping of units, cue-driven motion, prompts.

One script is one row from the source to the finished scene array, so planning a corpus is
a single narrow stage; scenes are exploded at the very end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuegrid import params as P
from cuegrid.functions import text as X
from cuegrid.functions.scalars import text_sha
from cuegrid.operators.rows import unfold

# --- fixed values: gestures and their wording -------------------------------------------
NEUTRAL_ACTIONS = (
    ("eye_contact",
     "maintains warm, natural eye contact with the camera; relaxed hands resting together"),
    ("head_nod", "gives a small, affirming head nod while speaking"),
    ("right_hand", "makes a slight explanatory gesture with the right hand, then lowers it"),
    ("left_hand", "makes a small open-palm gesture with the left hand, then lowers it"),
    ("both_hands", "uses a small two-handed explanatory gesture in front of the chest"),
    ("forward_lean", "leans forward very slightly to engage the viewer, then settles back"),
    ("facial_emphasis", "shows subtle facial emphasis with gently raised eyebrows"),
    ("head_tilt", "tilts the head slightly while explaining, with a thoughtful expression"),
)
CUE_ACTIONS = {
    "opening": ("welcome", "greets the viewer with a warm, friendly smile and a small nod"),
    "closing": ("closing",
                "gives a warm closing smile and a small nod, hands resting calmly"),
    "question": ("question",
                 "tilts the head slightly with an inquisitive expression, open palm gesture"),
    "enumeration": ("counting", "counts off points with a small, controlled finger gesture"),
    "emphasis": ("emphasis", "makes a small emphatic hand gesture with a subtle forward lean"),
    "contrast": ("contrast",
                 "gestures gently with one hand then the other, as if comparing two ideas"),
}
RETURN_TO_NEUTRAL = "Returns to the neutral seated presenter posture by the end of the clip."


def scene_breaks(rule: P.Planning = P.Planning(), measured_gap: float | None = None):
    """Arrow UDF (paragraphs, words, ends, clauses, seconds) -> ARRAY<INT> of scene ends.

    Dynamic programming over cut positions. Prefix sums make the length and the paragraph
    breaks of any run O(1), and a run only grows to the left, so each cut looks back no
    further than the longest scene allowed. Equal costs prefer the shortest last scene."""
    wps, gap = rule.words_per_second, measured_gap

    def prefix(values) -> list:
        total, out = 0, [0]
        for v in values:
            total += v
            out.append(total)
        return out

    def cuts(paragraphs, words, ends, clauses, seconds) -> list[int]:
        n = len(words)
        turns = prefix([0] + [int(a != b) for a, b in zip(paragraphs[1:], paragraphs[:-1])])
        if gap is None:
            cw, ce, cc = prefix(words), prefix(ends), prefix(clauses)
        cost_to, cut_at = [0.0], [0]
        for stop in range(1, n + 1):
            winner, winner_start, length = float("inf"), stop - 1, 0.0
            for start in range(stop - 1, -1, -1):
                if gap is None:
                    w = cw[stop] - cw[start]
                    length = 0.0 if w == 0 else round(
                        w / wps + (30 * (ce[stop] - ce[start])
                                   + 12 * (cc[stop] - cc[start])) / 100, 2)
                else:
                    length = sum(seconds[start:stop]) + gap * (stop - start - 1)
                if length > rule.max_s and stop - start > 1:
                    break
                price = rule.scene_cost + (rule.target_s - length) ** 2
                if length < rule.min_s:
                    price += P.SHORT_PENALTY * (rule.min_s - length) ** 2
                price = cost_to[start] + (
                    price + rule.paragraph_penalty * (turns[stop] - turns[start + 1]))
                if price < winner:
                    winner, winner_start = price, start
            cost_to.append(winner)
            cut_at.append(winner_start)
        found = []
        while n > 0:
            found.append(n)
            n = cut_at[n]
        return found[::-1]

    def run(paragraphs: pd.Series, words: pd.Series, ends: pd.Series, clauses: pd.Series,
            seconds: pd.Series) -> pd.Series:
        return pd.Series([cuts(p.tolist(), w.tolist(), e.tolist(), c.tolist(), s.tolist())
                          for p, w, e, c, s in zip(paragraphs, words, ends, clauses, seconds)])

    # nondeterministic: filters on the scenes must not run the grouping a second time
    return F.pandas_udf(run, T.ArrayType(T.IntegerType())).asNondeterministic()


def _field(units: Column, name: str) -> Column:
    return F.transform(units, lambda u: u[name])


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def group_units(scripts: DataFrame, rule: P.Planning = P.Planning(),
                measured_gap: float | None = None) -> DataFrame:
    """Adds `scenes` ARRAY<ARRAY<unit>> to rows holding a `units` array. With `measured_gap`
    each unit carries its measured `seconds`, and a scene lasts their sum plus the gaps."""
    seconds = _field(F.col("units"), "seconds") if measured_gap is not None else _empty("double")
    zero = _empty("int")
    counts = [zero, zero] if measured_gap is not None else [
        _field(F.col("units"), "ends"), _field(F.col("units"), "clauses")]
    words = _field(F.col("units"), "words")
    cut = scene_breaks(rule, measured_gap)(_field(F.col("units"), "paragraph"), words, *counts,
                                           seconds)

    def slices(_: Column) -> Column:
        return F.transform(F.col("_ends"), lambda stop, k: X.bound(
            F.coalesce(F.get(F.col("_ends"), k - 1), F.lit(0)),
            lambda start: F.slice(F.col("units"), start + 1, stop - start)))

    return (scripts.withColumn("_ends", cut).withColumn("scenes", slices(F.col("_ends")))
            .drop("_ends"))


def scene_seconds(group: Column, rule: P.Planning = P.Planning(), gap: float | None = None) -> Column:
    """Length of a scene from its units: estimated from their counts, or (with `gap`) measured."""
    if gap is not None:
        return F.round(F.aggregate(_field(group, "seconds"), F.lit(0.0), lambda a, s: a + s)
                       + F.lit(gap) * (F.size(group) - 1), 2)

    def total_of(name: str) -> Column:
        return F.aggregate(_field(group, name), F.lit(0), lambda a, v: a + v)

    return X.speech_seconds(total_of("words"), total_of("ends"), total_of("clauses"), rule.words_per_second)


def assign_gestures(cues: Column) -> Column:
    """ARRAY<STRING> of gestures from an array of cues: the cue's own gesture, otherwise the
    next neutral one, never the previous scene's again. A sequential rule over one script's
    short array, hence a fold inside the row."""
    neutral = F.array(*[F.lit(name) for name, _ in NEUTRAL_ACTIONS])
    by_cue = F.create_map(*[F.lit(x) for cue, (name, _) in CUE_ACTIONS.items()
                            for x in (cue, name)])
    size = len(NEUTRAL_ACTIONS)
    start = F.struct(_empty("string").alias("out"), F.lit(0).alias("next"))

    def step(state: Column, cue: Column) -> Column:
        last = F.when(F.size(state["out"]) > 0, F.element_at(state["out"], -1)).otherwise(F.lit(""))
        own = F.coalesce(by_cue[cue], F.lit(""))
        turn = state["next"] % size
        first = F.get(neutral, turn)
        second = F.get(neutral, (turn + 1) % size)

        def keep(choice: Column, used: Column) -> Column:
            return F.struct(F.array_append(state["out"], choice).alias("out"),
                            (state["next"] + used).cast("int").alias("next"))

        return (F.when((own != "") & (own != last), keep(own, F.lit(0)))
                .when(first != last, keep(first, F.lit(1)))
                .otherwise(keep(second, F.lit(2))))

    return F.aggregate(cues, start, step, lambda s: s["out"])


def action_of(gesture: Column) -> Column:
    table = dict(NEUTRAL_ACTIONS) | {g: a for g, a in CUE_ACTIONS.values()}
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.concat(F.lit("The presenter "), mapping[gesture], F.lit(". " + RETURN_TO_NEUTRAL))


def plan_scenes(scripts: DataFrame, rule: P.Planning = P.Planning(), *,
                measured: DataFrame | None = None, gap: float = 0.2,
                template: Column | None = None, description: Column | None = None,
                with_dialogue: bool = True,
                patterns=X.CUE_PATTERNS) -> DataFrame:
    """scripts(script_id, text) -> one row per scene.

    `measured(text_key, seconds)`, keyed by the SHA-256 of the unit text, replaces the
    estimates: units are exploded, joined by key and gathered again per script."""
    grouped = grouped_scripts(scripts, rule, measured, gap)
    texts = F.transform(F.col("scenes"), lambda g: F.array_join(_field(g, "text"), " "))
    return _explode_plan(grouped.withColumn("texts", texts), rule,
                         None if measured is None else gap, template, description,
                         with_dialogue, patterns)


def grouped_scripts(scripts: DataFrame, rule: P.Planning = P.Planning(), measured: DataFrame | None = None,
                    gap: float = 0.2) -> DataFrame:
    """scripts(script_id, text) -> script_id, units, scenes ARRAY<ARRAY<unit>>; one row per script. A null
    text is an empty one, without units or scenes."""
    base = scripts.select("script_id", X.split_units(F.coalesce("text", F.lit("")), rule.max_s,
                                                     rule.words_per_second).alias("units"))
    if measured is not None:
        base = _with_measured(base, measured, rule)
    return group_units(base, rule, None if measured is None else gap)


def _with_measured(base: DataFrame, measured: DataFrame, rule: P.Planning) -> DataFrame:
    unit = F.col("u")
    rows = unfold(base, "units", "k", "u", "script_id").withColumn(
        "text_key", text_sha(unit["text"]))
    once = measured.groupBy("text_key").agg(F.min("seconds").alias("seconds"))
    joined = rows.join(once, "text_key", "left")
    estimate = X.spoken(unit, rule.words_per_second)
    packed = F.struct("k", unit["paragraph"].alias("paragraph"), unit["text"].alias("text"),
                      unit["words"].alias("words"),
                      F.round(F.coalesce("seconds", estimate), 3).alias("seconds"))
    return joined.groupBy("script_id").agg(F.array_sort(F.collect_list(packed)).alias("units"))


def _explode_plan(rows: DataFrame, rule: P.Planning, gap: float | None, template: Column | None,
                  description: Column | None, with_dialogue: bool, patterns) -> DataFrame:
    total = F.size("texts")
    cues = F.transform(F.col("texts"), lambda t, i: X.classify_cue(t, i, total, patterns))
    rows = rows.withColumn("cues", cues)

    rows = rows.withColumn("gestures", assign_gestures(F.col("cues")))
    zipped = F.transform(F.col("texts"), lambda t, i: F.struct(
        (i + 1).cast("int").alias("scene_ix"), t.alias("text"),
        F.size(F.get("scenes", i)).alias("n_units"),
        F.transform(F.get("scenes", i), lambda u: u["text"]).alias("units"),
        scene_seconds(F.get("scenes", i), rule, gap).alias("estimated_duration"),
        F.get("cues", i).alias("cue"), F.get("gestures", i).alias("gesture")))
    out = unfold(rows, zipped, "_k", "s", "script_id").select(
        "script_id", "s.scene_ix", F.format_string("scene_%03d", "s.scene_ix").alias("scene_id"),
        "s.text", "s.units", "s.n_units", "s.estimated_duration", "s.cue", "s.gesture",
        action_of(F.col("s.gesture")).alias("visual_action"), F.lit("pending").alias("status"))
    if template is not None:
        out = out.withColumn("generation_prompt", X.render_prompt(
            template, description if description is not None else F.lit(""),
            F.col("visual_action"), F.col("text"), with_dialogue))
    return out
