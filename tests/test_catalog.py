"""Registered queries against their SQL, on the smallest corpus."""

import os

import pytest

from cuegrid.catalog import check, load

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
SAMPLE = ["x3_sentences", "x8_subtitles", "k1_scene_grouping", "k3_clip_choice", "w2_speech_from_silence", "w4_merge_overlaps",
          "j3_locate_words", "k8_disagreement", "k18_cuts", "k20_final_window", "k22_onsets", "m1_layered_settings", "q3_scene_rules",
          "r3_windowed_counts", "w18_gesture_rotation"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no corpus tables")


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, FOLDER)
    cur = duck.execute(ORACLES[name])
    assert check.compare([tuple(r) for r in out.collect()], out.columns, cur.fetchall(), [d[0] for d in cur.description]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0 and "scenes" in out.columns
