"""Finding spoken lines inside prompts without comparing every line with every prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuegrid.functions.text import bound, matching_text
from cuegrid.operators.rows import unfold
from cuegrid.session import stored

#: Gram lengths in words. A line uses the longest that fits between its first and last word:
#: long grams are rare, so few texts meet a line they do not contain.
GRAM_SIZES = (8, 4, 2, 1)


def _tokens(norm: Column) -> Column:
    return F.split(norm, " ")


def _line_grams(norm: Column) -> Column:
    """STRUCT<kind, grams>: keys every text containing the line must hold, each of them. Kind
    1-8: all runs of that many of the line's inner words (inner, because the first and last may
    be parts of longer words). Kind 0, for a line of one or two words: the runs of three
    characters of its longest word, or that word if it is shorter."""

    def keys(t: Column) -> Column:
        kind = F.lit(0)
        for size in reversed(GRAM_SIZES):
            kind = F.when(F.size(t) - 2 >= size, F.lit(size)).otherwise(kind)
        longest = F.element_at(F.array_sort(F.transform(t, lambda w: F.struct(
            F.length(w).alias("n"), w.alias("w")))), -1)["w"]

        def inner(n: Column) -> Column:
            return F.transform(F.sequence(F.lit(2), F.size(t) - n), lambda i: F.array_join(F.slice(t, i, n), " "))

        def characters(w: Column) -> Column:
            return F.when(F.length(w) <= 3, F.array(w)).otherwise(F.transform(
                F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))

        return bound(kind, lambda n: F.struct(n.alias("kind"), F.array_distinct(
            F.when(n > 0, inner(n)).otherwise(bound(longest, characters))).alias("grams")))

    return bound(_tokens(norm), keys)


def _text_grams(norm: Column, kinds: list[int]) -> Column:
    """ARRAY<BIGINT>: hashes of the text's grams of the kinds asked for."""

    def gram(kind: int, value: Column) -> Column:
        return F.xxhash64(F.lit(kind), value)

    def of_words(t: Column) -> Column:
        def word_grams(n: int) -> Column:
            spots = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(
                F.array().cast("array<int>"))
            return F.transform(spots, lambda i: gram(n, F.array_join(F.slice(t, i, F.lit(n)), " ")))

        def character_grams() -> Column:
            return F.flatten(F.transform(F.array_distinct(t), lambda w: F.flatten(F.transform(
                F.sequence(F.lit(1), F.length(w)), lambda i: F.array(*[
                    gram(0, F.substring(w, i, F.lit(size))) for size in (1, 2, 3)])))))

        return F.array_distinct(F.concat(*[word_grams(k) if k else character_grams()
                                           for k in kinds]))

    return bound(_tokens(norm), of_words)


def candidate_pairs(lines: DataFrame, texts: DataFrame, line_id: str, text_id: str, line: str, text: str, extra: list[str]) -> DataFrame:
    """(line_id, _line, extra, text_id): each line with the texts that hold its rarest gram."""
    left = lines.select(line_id, matching_text(F.col(line)).alias("_line"), *extra).where(
        F.col("_line") != "").distinct().withColumn("_g", _line_grams(F.col("_line")))
    kinds = sorted(r[0] for r in left.select("_g.kind").distinct().collect())
    offered = stored(unfold(left, F.transform("_g.grams", lambda g: F.xxhash64(F.col("_g.kind"), g)), "_at", "_k", line_id, "_line", *extra).drop("_at"))
    right = texts.select(text_id, matching_text(F.col(text)).alias("_text"))
    grams = unfold(right, _text_grams(F.col("_text"), kinds or [1]), "_at", "_k", text_id).drop("_at")
    held = stored(grams.join(offered.select("_k"), "_k", "left_semi"))
    counts = held.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no text holds comes first, so its line meets none
    rarest = offered.join(counts, "_k", "left").groupBy(line_id, "_line", *extra).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_k")).alias("_best")).select(line_id, "_line", *extra, F.col("_best._k").alias("_k"))
    return held.join(rarest, "_k").drop("_k").distinct()


def containing_texts(lines: DataFrame, texts: DataFrame, line_id: str, text_id: str,
                     line: str = "line", text: str = "text",
                     seconds: str | None = None) -> DataFrame:
    """(line_id, text_id) where the normalised line occurs in the normalised text and, if
    `seconds` names a column of lines, the text also carries that length label.

    A text that contains a line holds every gram of the line, so each line meets texts on the one of
    its grams that the fewest texts hold, by counts over all texts; only those pairs are
    compared. A word that is in every text decides nothing unless a line has no other. Texts
    are broken only into the kinds of gram the lines have (at most five, looked up first), and
    only grams some line has are kept, by a join whose small side Spark broadcasts if its size allows;
    they are written once, so that a gram which stays common is a plain join that Spark can split."""
    extra = [seconds] if seconds else []
    # ids only travel through the gram join; the texts come back for the few candidates
    met = candidate_pairs(lines, texts, line_id, text_id, line, text, extra)
    pairs = met.join(texts.select(text_id, F.col(text).alias("_raw")), text_id)
    pairs = pairs.withColumn("_text", matching_text(F.col("_raw"))).where(F.contains("_text", "_line"))
    if seconds:
        # the label must not be part of a longer number or word
        pairs = pairs.where(F.regexp_like(F.col("_text"), F.concat(
            F.lit(r"(?<![\d.])"), F.col(seconds).cast("string"), F.lit(r"s\b"))))
    return pairs.select(line_id, text_id).distinct()


def reuse_requests(lines: DataFrame, requests: DataFrame, line_id: str = "line_id",
                   seconds: str | None = None) -> DataFrame:
    """Per line: `reuse` (and which request) if a finished request for it exists, `wait` if
    one is pending, else `new`. requests(request_id, text, state), newer ids are newer."""
    hits = containing_texts(lines, requests, line_id, "request_id", seconds=seconds)
    seen = hits.join(requests.select("request_id", "state"), "request_id").groupBy(line_id).agg(
        F.max(F.when(F.col("state") == "finished", F.col("request_id"))).alias("_done"),
        F.max("request_id").alias("_any"))
    return lines.select(line_id).join(seen, line_id, "left").select(
        line_id, F.when(F.col("_done").isNotNull(), "reuse")
        .when(F.col("_any").isNotNull(), "wait").otherwise("new").alias("action"),
        F.coalesce("_done", "_any").alias("request_id"))
