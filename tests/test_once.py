"""Costly columns are evaluated once a row, and rows that are read twice are made once."""

import pytest
from pyspark.sql import functions as F

from cuegrid.catalog import load, tables as T
from cuegrid.functions import text as X
from cuegrid.operators import incremental as I
from cuegrid.operators.align import align_words, matching_pairs
from cuegrid.operators.rows import settled


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, "The tide went out. Nobody said why! It came back. Was it late?"), (2, ""), (3, None), (4, "One line")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_message_is_collapsed_once(spark):
    rows = spark.createDataFrame([(" Not  enough\ncredits ",), ("it FAILED " + "x " * 200,), ("violates   it " + "x" * 599,), ("failed",), (None,)], "t string")
    out = rows.select(X.classify_message(F.col("t")).alias("kind"))
    assert [r.kind for r in out.collect()] == ["rate_limit", None, None, "transient", None]
    assert plan(rows.repartition(2).select(X.classify_message(F.col("t")).alias("kind"))).count("regexp_replace") == 1


@pytest.mark.parametrize("words", [["It’s", "a-B", "", "Ünde"], [], ["a\nb", "C"], [None, "a\nb"], ["x", None], None, ["ΑΣ", "İx", "K9"]])
def test_words_in_one_pass_equal_words_one_by_one(spark, words):
    row = spark.createDataFrame([(words,)], "w array<string>").select(
        X.matching_words(F.col("w")).alias("all"), F.transform("w", X.matching_word).alias("each")).first()
    assert row["all"] == row["each"]


def test_word_class_lists_what_ranges_held(spark):
    chars = spark.range(1, 0x3000).where("id < 55296").select(F.udf(chr, "string")("id").alias("c"))
    from cuegrid.functions.scalars import WORD
    assert chars.where(F.col("c").rlike(WORD) != F.col("c").rlike("[A-Za-z0-9À-ɏ']+")).count() == 0


def test_sentences_are_split_once_behind_a_filter(spark, folder):
    rows = T.sentence_arrays(spark, folder).where(F.size("sents") > 0)
    assert plan(rows).count("flatten(") == plan(T.sentence_arrays(spark, folder)).count("flatten(")
    assert {r.script_id: len(r.sents) for r in rows.collect()} == {1: 4, 4: 1}


def test_settled_columns_replace_and_keep_the_others(spark):
    rows = settled(spark.createDataFrame([(1, "a b")], "k long, t string"), t=F.upper("t"), w=F.split("t", " "))
    assert [tuple(r) for r in rows.select("k", "t", "w").collect()] == [(1, "A B", ["a", "b"])]


def test_heard_words_are_made_once(spark):
    rows = spark.createDataFrame([("To be, or not to be", "to be or to be")], "text string, h string").withColumn("heard", F.split("h", " "))
    out = align_words(rows)
    r = out.first()
    assert [tuple(p) for p in r.pairs] == matching_pairs(["to", "be", "or", "not", "to", "be"], ["to", "be", "or", "to", "be"])
    both = out.select(F.forall("pairs", lambda p: F.get("heard", p["j"]) != ""), F.size("heard"))
    assert plan(both).count("split(h") == plan(out.select("pairs", "heard")).count("split(h") == 1


def test_scenes_read_twice_are_stored(spark):
    scenes = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (2, ["a"]), (None, ["a"])], "k long, units array<string>").select(
        "k", "units", F.sha2(F.lit("x"), 256).alias("text_sha"), F.sha2(F.lit("x"), 256).alias("audio_sha"), F.lit("v").alias("audio_voice"),
        F.lit(0).alias("raw_length"), F.reverse("units").alias("again"))
    out = I.has_speech(scenes, spark.createDataFrame([("a",), ("b",)], "unit_key string"), "k", F.lit("v"))
    assert sorted((str(r.k), r.has_speech) for r in out.collect()) == [("1", False), ("1", False), ("2", True), ("None", False)]
    assert "reverse(" not in plan(out)


def test_scene_plan_is_stored(spark, folder):
    out = load()[0]["k2_scene_plan"](spark, folder)
    assert "flatten(" not in plan(out)
    assert sorted((r.script_id, r.words, r.numbered) for r in out.collect()) == [(1, 13, True), (4, 2, True)]


def test_top_up_rounds_nothing_exactly(spark):
    from cuegrid.operators import sync as S

    rows = spark.createDataFrame([(5.0, []), (9.0, [4.0]), (31.0, [8.0]), (90.0, []), (3.0, [8.0])], "a double, c array<double>")
    out = rows.select(S.top_up(F.col("a"), F.col("c")).alias("c"))
    assert "decimal(" not in plan(out)
    for row, got in zip(rows.collect(), out.collect()):
        have = list(row.c)
        while len(have) < 4:
            p = spark.createDataFrame([(row.a, have)], "a double, c array<double>").select(S.sync_plan(F.col("a"), F.col("c")).alias("p")).first().p
            more = spark.createDataFrame([(p.target_duration - p.video_duration,)], "t double").select(S.choose_clips(F.col("t")).alias("c")).first().c
            if p.action != "insufficient" or not more:
                break
            have.append(more[0])
        assert list(got.c) == have


def test_lines_are_filled_in_one_pass(spark):
    words = ["a", "tide" * 3, "w" * 90, "né", "\U0001f600" * 5, "out"]
    texts = [" ".join(words[(k * k + j) % 6] for j in range(k)) + "." for k in range(1, 60)] + ["One.  Two three. " + "xy " * 70, " ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    one = X.cue_lines(F.col("t"))
    assert "aggregate(" not in plan(rows.select(one))
    for text, lines, sents in rows.select("t", one, X.split_sentences(F.col("t"))).collect():
        want = []
        for s in sents:
            room, done = min(84.0, len(s) / -(-len(s) // 84) * 1.15), []
            for w in s.split():
                if done and len(done[-1]) + 1 + len(w) <= room:
                    done[-1] += " " + w
                else:
                    done.append(w)
            want += [" ".join(s.split())] if len(s) <= room else done
        assert lines == want, text


def test_only_tokens_before_marks_are_tried(spark):
    texts = ["Dr. No met (Mr. X. Y.) vs. U.S.A. troops. He left... J. K. R. wrote e.g. this.\" Ok? No. 5 went.", "Dr.\x1eMr.\x1e It. Be", "x etc. y.\tNo. Z!", "Prof.", "", None, " a. b. "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    marked = F.regexp_replace(X.strip(F.col("t")), rf"(?U)({X._ENDERS})({X.SPACE}+)", f"$1{X._MARK}$2")
    whole = F.filter(F.transform(F.split(F.regexp_replace(marked, X._FALSE_MARK, "$1$2"), X._MARK), X.strip), lambda s: s != "")
    out = rows.select("t", X.split_sentences(F.col("t")).alias("a"), whole.alias("b"))
    assert "substring_index(" in plan(out)
    for r in out.collect():
        assert r.a == r.b, r.t


def test_sides_of_one_shape_are_paired_together(monkeypatch):
    import random
    from cuegrid.operators import fit as FT

    chosen, sides = random.Random(5), []
    for k in range(300):
        narr, clip = ([(i + chosen.randrange(20) / 100, i + chosen.randrange(3, 9) / 10) for i in range(chosen.randrange(0 if k % 9 == 0 else 1, 7))] for _ in range(2))
        sides.append((narr, clip))
    want, alone = [FT.pairings(*s) for s in sides], []
    monkeypatch.setattr(FT, "pairings", lambda n, c, f=FT.pairings: alone.append(1) or f(n, c))
    assert FT.pairings_of_many(sides * 4) == want * 4
    assert len(alone) < len(sides)


def test_candidates_that_pair_alike_come_once(spark):
    from cuegrid.operators import fit as FT

    def segs(shift):
        return [(i + shift, i + 0.5 + shift * i / 10) for i in range(4)]

    rows = spark.createDataFrame([(1, segs(0.1), segs(0.3)), (2, [(0.0, 0.4), (0.0, 0.4), (0.1, 0.3)], segs(0.2)), (3, [], segs(0.1))],
                                 f"k long, clip {FT.SPAN}, narr {FT.SPAN}").withColumn("narr_len", F.lit(5.0)).withColumn("clip_len", F.lit(5.0))
    every, once = (FT.candidates(rows, F.col("clip_len"), once=x).select("k", "sel_ix", "setting", "phrases").collect() for x in (False, True))
    first = {}
    for r in sorted(every):
        first.setdefault((r.k, r.sel_ix, str(r.phrases)), r.setting)
    assert sorted((r.k, r.sel_ix, str(r.phrases), r.setting) for r in once) == sorted((*k, v) for k, v in first.items())
