"""Line dedup: hashes partitioned by range, sorted by document and position; first occurrences become keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuegrid.llm.lineage import settled
from cuegrid.operators.rows import unfold

#: Lines whose key is shorter than this (code points) stay, and so do those in fewer documents.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: About as many documents of one key are sorted and streamed as one group.
GROUP_DOCS = 4096
#: White space taken off both ends of a line: space and the controls 9 to 13.
_SPACE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other character as it is. Text of one-byte characters alone takes
    the plain function, which is many times faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _half_digest(text: Column) -> Column:
    """The first 128 bits of the SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _documents(docs: DataFrame, *more) -> DataFrame:
    """A document is named by its id and its text: rows equal in both share everything."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more).select(
        "doc_id", _half_digest(F.col("text")).alias("text_key"), "text")


def line_keys(docs: DataFrame, least_chars: int, groups: int) -> DataFrame:
    """(key, group, doc_id, text_key, position) of every line long enough. The group follows from
    the document, so a key that a third of all documents hold is many groups."""
    lines = unfold(_documents(docs), F.split("text", "\n", -1), "position", "line", "doc_id", "text_key")
    keyed = lines.select("doc_id", "text_key", "position", ascii_lower(F.btrim("line", F.lit(_SPACE))).alias("line"))
    return keyed.where(F.length("line") >= least_chars).select(
        _half_digest(F.col("line")).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("group"), "doc_id", "text_key", "position")


def dropped_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_key, keep) of the documents that lose lines.

    Lines are shuffled once as hashes, by ranges of (key, group), and sorted by document and
    position within; one pass over the sorted rows marks where a document and where a group
    starts. The first document of each group and how many it has are summed by key, which
    leaves a row for each line that repeats often enough. That table and the bitmaps are
    written before they meet lines or texts, so Spark broadcasts them if they are small, or
    splits a hot key if not."""
    groups = max(16, -(-docs.count() // GROUP_DOCS))
    order = Window.partitionBy("key", "group").orderBy(F.desc_nulls_last("doc_id"), "text_key", "position")
    sorted_lines = (
        line_keys(docs, least_chars, groups).repartitionByRange("key", "group")
        .withColumn("nth", F.row_number().over(order)).withColumn("before", F.lag("doc_id").over(order))
        .select("key", "doc_id", "text_key", "position", (F.col("nth") == 1).alias("leads"),
                ((F.col("nth") == 1) | ~F.col("doc_id").eqNullSafe(F.col("before"))).alias("opens")))
    lines = settled(sorted_lines)
    # only the row that opens a document's run of one key counts; a group's first is its largest doc_id
    firsts = settled(
        lines.where("opens").groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max(F.when(F.col("leads"), F.col("doc_id"))).alias("keeper"))
        .where(F.col("docs") >= least_docs).select("key", "keeper"))
    lost = lines.join(firsts, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = lost.groupBy("doc_id", "text_key", F.shiftright("position", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, position % 64)")).alias("gone"))
    return settled(words.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")))


def _with_bitmaps(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    lost = dropped_words(docs, least_chars, least_docs).select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key"), "keep")
    met = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_key") == F.col("lost_key"))
    none = F.expr("cast(array() AS array<struct<word:int,bits:bigint>>)")
    return _documents(docs).join(lost, met, "left").select(
        "doc_id", "text_key", "text", F.coalesce("keep", none).alias("keep"))


_N_LINES = "cast(length(text) - length(replace(text, '\n', '')) + 1 AS bigint)"
_N_DROPPED = "aggregate(keep, 0L, (n, w) -> n + bit_count(~w.bits))"
#: The words from the first to the last stored one, those left out as all ones.
_DENSE = "flatten(transform(keep, (w, k) -> concat(array_repeat(-1L, w.word - if(k = 0, 0, get(keep, k - 1).word + 1)), array(w.bits))))"


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Which lines of each document stay, without its text.

    A line's key is the line without white space (space, controls 9 to 13) at both ends and
    with A to Z in lower case. A key of at least `least_chars` code points that at least
    `least_docs` documents hold loses all its lines but those of the largest doc_id.

    Returns doc_id, text_key (128 bits of the text's SHA-256), n_lines, n_dropped and keep: the
    words of 64 lines that lose any, as (word, bits) in order, a set bit for a line that stays.
    A word left out keeps all its lines, so a document that loses nothing has an empty array.

    Rows of one doc_id are one document when keys are counted, and its keys stay in all of
    them or in none; null doc_ids are together one document, smaller than all others. A null
    or empty text is one empty line. Repeated rows give a row each. Extra columns are ignored;
    an empty table gives no rows. A text is split within its own row, however long."""
    return _with_bitmaps(docs, least_chars, least_docs).select("doc_id", "text_key", F.expr(_N_LINES).alias("n_lines"), F.expr(_N_DROPPED).alias("n_dropped"), "keep")


def kept_texts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """`keep_bitmaps` with the lines that stay, joined by newline, as ``kept``. Texts move only to meet
    the bitmaps, and not at all if Spark finds those small enough to broadcast."""
    # the dense words are bound as a lambda's variable, hence worked out once and not for every line
    cut = (f"get(transform(array({_DENSE}), dense -> array_join(filter(split(text, '\n', -1), "
           "(line, k) -> coalesce(getbit(get(dense, cast(k div 64 AS int)), k % 64), 1) = 1), '\n')), 0)")
    return _with_bitmaps(docs, least_chars, least_docs).select(
        "doc_id", "text_key", F.expr(_N_LINES).alias("n_lines"), F.expr(_N_DROPPED).alias("n_dropped"), "keep",
        F.when(F.size("keep") == 0, F.col("text")).otherwise(F.expr(cut)).alias("kept"))
