"""Cutting footage from a library of reusable clips."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuegrid.functions.scalars import sub_window_start, window_seed

#: Clips used only for their own gesture.
SPECIAL = ("welcome", "closing")


def clip_gesture(stem: Column) -> Column:
    """The gesture a clip serves besides its own name: `head_nod_2` serves `head_nod`."""
    return F.regexp_replace(stem, r"_\d+$", "")


def matching_clips(scenes: DataFrame, clips: DataFrame, gesture: str = "gesture",
                   clip: str = "clip") -> DataFrame:
    """scenes x clips whose stem is the gesture or the gesture with a number: one equi join
    on the names a clip answers to."""
    names = clips.withColumn(gesture, F.explode(F.array_distinct(F.array(
        F.col(clip), clip_gesture(F.col(clip))))))
    return scenes.where(F.col(gesture) != "").join(names, gesture)


_PICK = T.ArrayType(T.StructType([T.StructField("stem", T.StringType()),
                                  T.StructField("seconds", T.DoubleType()),
                                  T.StructField("matched", T.BooleanType())]))


@F.pandas_udf(_PICK)
def _pick_udf(gestures: pd.Series, seeds: pd.Series, stems: pd.Series, seconds: pd.Series) -> pd.Series:
    """Never the clip of the scene before: each choice depends on the last one, so a script's
    scenes are gone through in order."""

    def serves(stem: str, gesture: str) -> bool:
        return bool(gesture) and (stem == gesture or bool(
            re.fullmatch(re.escape(gesture) + r"_\d+", stem)))

    def picks(wanted, seed, names, lengths) -> list[dict]:
        clips = sorted(zip(names, lengths))
        general = [c for c in clips if not any(serves(c[0], s) for s in SPECIAL)] or clips
        last, out = None, []
        for gesture, number in zip(wanted, seed):
            own = [c for c in clips if serves(c[0], gesture)]
            choice, hit = clips[0], False
            for pool, is_own in ((own, True), (general, False), (clips, False)):
                fresh = [c for c in pool if c[0] != last]
                if fresh:
                    choice, hit = fresh[int(number) % len(fresh)], is_own
                    break
            last = choice[0]
            out.append({"stem": choice[0], "seconds": float(choice[1]), "matched": hit})
        return out

    return pd.Series([picks(*row) for row in zip(gestures, seeds, stems, seconds)])


_pick_udf = _pick_udf.asNondeterministic()  # keeps filters from re-running it


def pick_clips(scripts: DataFrame, clips: Column, wanted_s: Column | None = None) -> DataFrame:
    """scripts(..., gestures ARRAY<STRING>) and a literal clip library
    ARRAY<STRUCT<stem,seconds>> -> adds `picks` ARRAY<STRUCT<stem,matched,start>>."""
    label = F.transform("gestures", lambda _, i: F.format_string("scene_%03d", i + 1))
    rows = scripts.withColumn("_label", label).withColumn("_lib", clips)
    seeds = F.transform("_label", lambda x: window_seed(x, x))
    rows = rows.withColumn("_p", _pick_udf(F.col("gestures"), seeds, F.transform("_lib", lambda c: c["stem"]),
                                           F.transform("_lib", lambda c: c["seconds"])))
    need = wanted_s if wanted_s is not None else F.lit(6.0)
    out = F.transform("_p", lambda p, i: F.struct(
        p["stem"].alias("stem"), p["matched"].alias("matched"), sub_window_start(
            p["seconds"], need, p["matched"], window_seed(F.get("_label", i), F.get("_label", i))).alias("start")))
    return rows.withColumn("picks", out).drop("_label", "_lib", "_p")
