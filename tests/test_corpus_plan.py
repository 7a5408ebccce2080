"""The corpus report as a fold inside each script's row."""

import os

import pytest
from pyspark.sql import functions as F

from cuegrid.functions.rounding import round_exact
from cuegrid.plans.corpus import ACTIONS, production_plan, scene_table

FOLDER = "/root/testdata/sf0.001"


def by_rows(scripts, **options):
    """The same report from one row per scene."""
    return scene_table(scripts, **options).groupBy("script_id").agg(
        F.count(F.lit(1)).alias("scenes"),
        round_exact(F.sum(F.rint(F.col("estimated_duration") * 1000).cast("bigint")) / 1000, 2).alias("narration_s"),
        F.sum("footage").alias("footage_s"), F.count_if(F.col("status") == "failed").alias("uncovered"),
        *[F.count_if(F.col("sync.action") == a).alias(a) for a in ACTIONS])


def some_scripts(spark):
    long_one = "A sentence of a few plain words stands here. " * 40
    return spark.createDataFrame([
        (1, "One short line."), (2, None), (3, ""), (4, long_one), (5, "Title\n\n" + long_one + "\n\nThe end, at last!"),
        (6, "word " * 300 + "."), (7, "?!")], "script_id long, text string")


def test_report_equals_that_of_the_scene_rows(spark):
    scripts = some_scripts(spark)
    got, want = production_plan(scripts), by_rows(scripts)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no corpus tables")
def test_corpus_report_equals_that_of_the_scene_rows(spark):
    scripts = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("script_id"), "text")
    got, want = production_plan(scripts), by_rows(scripts)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
