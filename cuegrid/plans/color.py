"""One look for all clips of a project: each channel mapped to the project's median of means and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cuegrid.functions.scalars import color_term
from cuegrid.operators.sequences import channel_stats, color_targets
from cuegrid.session import cut_lineage


def color_filters(pixels: DataFrame, scene: str = "scene", project: str = "project") -> DataFrame:
    """pixels(project, scene, channel, value) -> (project, scene, filter)."""
    stats = cut_lineage(channel_stats(pixels, project, scene))
    joined = stats.join(color_targets(stats, project), [project, "channel"])
    term = color_term(F.col("channel"), F.col("mean"), F.col("std"), F.col("target_mean"),
                      F.col("target_std"))
    return joined.groupBy(project, scene).agg(F.concat(F.lit("lutrgb="), F.concat_ws(
        ":", *[F.max(F.when(F.col("channel") == c, term)) for c in ("r", "g", "b")])).alias("filter"))
