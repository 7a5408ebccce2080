"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cuegrid import catalog  # noqa: E402
from cuegrid.session import local_session  # noqa: E402

HEADLINE = (
    "production_plan", "x3_sentences", "x6_units", "x8_subtitles", "x10_classify_cues", "k1_scene_grouping",
    "k3_clip_choice", "k4_sync_plan", "w2_speech_from_silence", "w4_merge_overlaps", "j3_locate_words",
    "j9_lines_in_texts", "k8_disagreement", "k9_fit_plans", "k14_alignment_search", "k15_align_words",
    "k16_lip_chunks", "k22_onsets", "k23_color_match", "w15_failure_streak", "j1_carry_over",
    "m1_layered_settings", "q3_scene_rules", "a1_production_report", "r3_windowed_counts")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    queries, _ = catalog.load()
    wanted = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's workers
    took: dict[str, float] = {}
    for name in wanted:
        begin = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total headline query time", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
