"""Text columns: normalising, splitting, classifying and rendering.

Everything here is built-in Spark: patterns mark boundaries in the string, arrays carry
order, and one script stays one row until its parts are exploded, so no step shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from cuegrid import params as P
from cuegrid.functions.scalars import (DIGITS, LOWER, count_clause_marks, count_sentence_ends, count_words,
                                       speech_seconds)

# --- fixed values: patterns and word lists ----------------------------------------------
SPACE = r"[\s\x1c-\x1f]"  # with (?U)
SPACE_CHARACTERS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e",
                 "fig", "no", "vol", "approx", "inc", "ltd", "co", "dept", "est", "u.s", "u.k",
                 "a.m", "p.m")
CONJUNCTIONS = ("and", "but", "so", "because", "which", "while", "although", "however", "whereas")
CUE_PATTERNS = (
    ("enumeration",
     r"(?:^|[.!?]\s+)(?:first|second|third|fourth|fifth|firstly|secondly|thirdly|finally|lastly)\b"
     r"|\bstep \d+\b"
     r"|\b(?:two|three|four|five|several)\s+(?:\w+\s+)?"
     r"(?:things|steps|ways|reasons|points|rules|factors|parts|ideas)\b"),
    ("emphasis",
     r"\b(important|key|crucial|remember|never|always|essential|critical|must)\b"),
    ("contrast",
     r"\b(however|on the other hand|whereas|in contrast|but|instead|unlike)\b"),
)
CREDIT_WORDS = ("not enough credits", "insufficient credits", "out of credits", "no credits",
                "credit limit", "run out of credits")
POLICY_WORDS = ("violat", "policy", "can't generate", "cannot generate", "unable to generate",
                "not able to generate", "prominent people")
FAILURE_WORDS = ("failed", "something went wrong")

_MARK = "\u001e"
_ENDERS = "[.!?…]+[\"'”’)\\]]*"
_HEADING_STOP = "[.!?:;,\"'”]$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once: inside lambdas Spark does not share common
    subexpressions, so a value used twice is bound as the variable of a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every Unicode white space, not only U+0020."""
    return F.trim(text, F.lit(SPACE_CHARACTERS))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def words_of(text: Column) -> Column:
    """Whitespace-separated words; empty array for blank text."""
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def normalize_script(text: Column) -> Column:
    def changed(value: Column, pattern: str, new: str, *signs: str) -> Column:
        """Patterns are only tried on texts that hold one of their signs."""
        return bound(value, lambda t: F.when(reduce(or_, [F.contains(t, F.lit(x)) for x in signs]),
                                             F.regexp_replace(t, pattern, new)).otherwise(t))

    t = F.replace(changed(text, "\r\n?", "\n", "\r"), F.lit("\ufeff"), F.lit(""))
    lines = F.split(changed(t, "[ \t]{2,}|\t", " ", "  ", "\t"), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def split_paragraphs(text: Column) -> Column:
    """ARRAY<STRING> of paragraphs.

    A block's leading headings stand alone; from its first ordinary line on, lines are one
    paragraph. So it is enough to find that first ordinary line in each block."""
    blocks = F.split(normalize_script(text), "\n{2,}")

    def lines_to_paragraphs(lines: Column) -> Column:
        def ordinary(line: Column, i: Column) -> Column:
            after = F.coalesce(F.get(lines, i + 1), F.lit(""))
            heading = ((F.length(line) < 80) & ~line.rlike(_HEADING_STOP)
                       & ((after == "") | after.rlike(r"^[\p{Lu}\p{Nd}]")))
            return ~heading

        def cut(first: Column) -> Column:
            return (F.when(first == 0, lines)
                    .when(first == 1, F.array(F.array_join(lines, " ")))
                    .otherwise(F.array_append(
                        F.slice(lines, F.lit(1), first - 1),
                        F.array_join(F.slice(lines, first, F.size(lines)), " "))))

        return bound(F.array_position(F.transform(lines, ordinary), F.lit(True)).cast("int"), cut)

    def block_paragraphs(block: Column) -> Column:
        return bound(F.filter(F.split(block, "\n"), lambda x: x != ""), lines_to_paragraphs)

    return F.filter(F.flatten(F.transform(blocks, block_paragraphs)), lambda p: p != "")


#: A token that is an abbreviation, an initial or a dotted form, of any length, with the mark
#: behind it.
_FALSE_MARK = (
    rf"(?U)(^|{SPACE})([\"'(“‘]*(?:(?i:"
    + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    + rf")|\p{{Lu}}|(?:[a-zA-Z]\.)+[a-zA-Z])\.){_MARK}")


def ends_with_abbreviation(piece: Column) -> Column:
    """Does the final '.' belong to an abbreviation, an initial or a dotted form?"""
    return F.concat(piece, F.lit(_MARK)).rlike(_FALSE_MARK)


def split_sentences(paragraph: Column) -> Column:
    """ARRAY<STRING> of sentences: mark each candidate end, take the mark back where the
    token before it is an abbreviation, split at the marks that are left."""

    def unmarked(t: Column) -> Column:
        """Only the token before a mark is looked at: the pattern over a whole text tries every word."""
        def kept(piece: Column) -> Column:
            false = piece.endswith(".") & ends_with_abbreviation(F.substring_index(piece, " ", -1))
            return F.when(false, piece).otherwise(F.concat(piece, F.lit(_MARK)))

        return F.array_join(F.transform(F.split(t, _MARK), kept), "")

    def parts(p: Column) -> Column:
        marked = F.regexp_replace(p, rf"(?U)({_ENDERS})({SPACE}+)", f"$1{_MARK}$2")
        # a text with marks of its own goes through the pattern
        return F.split(F.when(F.contains(p, F.lit(_MARK)), F.regexp_replace(marked, _FALSE_MARK, "$1$2")).otherwise(
            unmarked(marked)), _MARK)

    return F.filter(F.transform(bound(strip(paragraph), parts), strip), lambda s: s != "")


def fill(parts: Column, too_long: Callable[[Column, Column], Column]) -> Column:
    """Join neighbouring parts with a space; `too_long(open, trial)` starts a new one.

    The open part is the last array element, so the fold's state is one array."""

    def step(done: Column, part: Column) -> Column:
        def place(trial: Column) -> Column:
            head = F.slice(done, F.lit(1), F.size(done) - 1)
            return F.when(too_long(F.element_at(done, -1), trial),
                          F.array_append(done, part)).otherwise(F.array_append(head, trial))

        return F.when(F.size(done) == 0, F.array(part)).otherwise(
            bound(F.concat_ws(" ", F.element_at(done, -1), part), place))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def counted(text: Column) -> Column:
    """STRUCT<text, words, ends, clauses>: a text with the counts its spoken length needs.

    The counts of texts joined by a space add up, so joined lengths need no second look at
    the characters."""
    return F.struct(text.alias("text"), count_words(text).alias("words"),
                    count_sentence_ends(text).alias("ends"),
                    count_clause_marks(text).alias("clauses"))


def spoken(c: Column, wps: float) -> Column:
    return speech_seconds(c["words"], c["ends"], c["clauses"], wps)


def _joined(a: Column, b: Column) -> Column:
    return F.struct(F.concat_ws(" ", a["text"], b["text"]).alias("text"),
                    *[(a[n] + b[n]).alias(n) for n in ("words", "ends", "clauses")])


_COUNTED = "array<struct<text:string,words:int,ends:int,clauses:int>>"


def _split_once(sentence: Column, max_s: float, wps: float) -> Column:
    """One level: at clause punctuation, else at conjunctions, else whole. Neighbouring
    parts are joined again while the joined text still fits."""

    def attempt(pattern: str) -> Column:
        def pack(parts: Column) -> Column:
            def step(done: Column, part: Column) -> Column:
                return bound(_joined(F.element_at(done, -1), part), lambda trial: F.when(
                    spoken(trial, wps) > max_s, F.array_append(done, part)).otherwise(
                    F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), trial)))

            return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)),
                               F.slice(parts, F.lit(1), F.lit(1)).cast(_COUNTED), step)

        def check(chunks: Column) -> Column:
            return F.when((F.size(chunks) > 1) & F.forall(chunks, lambda c: c["words"] >= 3),
                          chunks)

        raw = F.filter(F.split(sentence["text"], pattern), lambda p: strip(p) != "")
        return bound(raw, lambda parts: F.when(F.size(parts) > 1, bound(
            F.transform(parts, counted).cast(_COUNTED), lambda c: bound(pack(c), check))))

    whole = F.array(sentence).cast(_COUNTED)
    clause = attempt(rf"(?U)(?<=[,;:—]){SPACE}+")
    joint = attempt(rf"(?iU){SPACE}+(?=(?:" + "|".join(CONJUNCTIONS) + r")\b)")
    return F.when(spoken(sentence, wps) <= max_s, whole).otherwise(
        F.coalesce(clause, joint, whole))


def _split_counted(sentence: Column, max_s: float, wps: float) -> Column:
    """A chunk that is still too long after one level is a single clause (or a single
    conjunct), so it can only be split by the other rule, and what that leaves cannot be
    split at all: two levels are the whole recursion."""
    return F.when(spoken(sentence, wps) <= max_s, F.array(sentence).cast(_COUNTED)).otherwise(
        F.flatten(F.transform(_split_once(sentence, max_s, wps),
                              lambda c: _split_once(c, max_s, wps))))


def split_long_sentence(sentence: Column, max_s: float = 8.5, wps: float = 2.5) -> Column:
    """ARRAY<STRING>: clause chunks of a sentence that is longer than `max_s` when spoken."""
    return F.transform(bound(counted(sentence), lambda s: _split_counted(s, max_s, wps)),
                       lambda c: c["text"])


def split_units(text: Column, max_s: float = 8.5, wps: float = 2.5) -> Column:
    """ARRAY<STRUCT<paragraph, text, words, ends, clauses>>: the narrated units, in order."""

    def paragraph_units(p: Column, k: Column) -> Column:
        pieces = F.transform(split_sentences(p), lambda s: bound(
            counted(s), lambda c: _split_counted(c, max_s, wps)))
        return F.transform(F.flatten(pieces), lambda u: F.struct(
            k.cast("int").alias("paragraph"), u["text"].alias("text"),
            u["words"].alias("words"), u["ends"].alias("ends"), u["clauses"].alias("clauses")))

    return F.flatten(F.transform(split_paragraphs(text), paragraph_units))


def cue_lines(text: Column, limit: int = P.MAX_CUE_CHARS) -> Column:
    """ARRAY<STRING> of subtitle lines: each sentence filled word by word up to a limit that
    spreads it evenly over the lines it needs."""

    def sentence_lines(sentence: Column) -> Column:
        size = F.length(sentence)
        even = size / F.ceil(size / F.lit(limit)) * F.lit(1.15)
        room = F.least(F.lit(float(limit)), even)

        def filled(line: Column) -> Column:
            # the longest stretch of whole words that has room, or a word that has none: one pass, not a step a word
            most = F.greatest(F.lit(1), F.floor(room)).cast("string")
            return F.regexp_extract_all(line, F.concat(F.lit(" ?(.{1,"), most, F.lit("}(?= |\\z)|[^ ]+)")), F.lit(1))

        return bound(collapse(sentence), lambda line: F.when(size <= room, F.array(line)).otherwise(filled(line)))

    return F.flatten(F.transform(split_sentences(text), sentence_lines))


def share_words(text: Column, durations: Column) -> Column:
    """ARRAY<STRING>: the text's words shared over the clips in proportion to their length,
    the last clip taking whatever is left."""
    def share(words: Column) -> Column:
        n = F.size(words)
        total = F.aggregate(durations, F.lit(0.0), lambda a, d: a + d)
        counts = F.transform(durations, lambda d: F.rint(n * d / total).cast("int"))

        def piece(_: Column, i: Column) -> Column:
            begin = F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, c: a + c)
            size = F.when(i == F.size(durations) - 1,
                          F.greatest(n - begin, F.lit(0))).otherwise(F.get(counts, i))
            return F.array_join(F.slice(words, begin + 1, size), " ")

        return F.transform(durations, piece)

    return F.when(F.size(durations) <= 1, F.array(text)).otherwise(bound(words_of(text), share))


def classify_cue(text: Column, index: Column, total: Column,
                 patterns: Sequence[tuple[str, str]] = CUE_PATTERNS) -> Column:
    """First matching cue: position, then a question, then the lexicon in its order."""
    out = (F.when(index == 0, F.lit("opening"))
           .when((index == total - 1) & (total > 2), F.lit("closing"))
           .when(text.rlike(rf"(?U)\?{SPACE}*\z"), F.lit("question")))
    for name, pattern in patterns:
        out = out.when(text.rlike("(?iU)" + pattern), F.lit(name))
    return out


#: Sentence template per profile path, in output order.
PROFILE_SENTENCES = (
    ("general_description", "Presenter: "), ("clothing", "Clothing: "), ("hairstyle", "Hair: "),
    ("background", "Setting: "), ("lighting", "Lighting: "))
FRAMING_FIELDS = ("shot", "camera_position", "camera_motion")


def describe_presenter(fields: Mapping[str, Column]) -> Column:
    """Sentences for the profile fields that are not empty."""

    def full(name: str) -> Column:
        return F.nullif(fields.get(name, F.lit(None).cast("string")), F.lit(""))

    parts = [F.concat(F.lit(lead), full(name), F.lit(".")) for name, lead in PROFILE_SENTENCES]
    framing = F.nullif(F.concat_ws(", ", *[full(n) for n in FRAMING_FIELDS]), F.lit(""))
    return F.concat_ws(" ", *parts, F.concat(F.lit("Framing: "), framing, F.lit(".")))


def render_prompt(template: Column, description: Column, action: Column, text: Column,
                  with_dialogue: bool = True) -> Column:
    spoken = F.concat(F.lit('The presenter says: "'), F.replace(text, F.lit('"'), F.lit("'")),
                      F.lit('"')) if with_dialogue else F.lit("")
    out = template
    for slot, value in (("{{PRESENTER_DESCRIPTION}}", description), ("{{VISUAL_ACTION}}", action),
                        ("{{DIALOGUE}}", spoken)):
        out = F.replace(out, F.lit(slot), value)
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def prompt_for(custom: Column, rendered: Column) -> Column:
    return F.coalesce(F.nullif(custom, F.lit("")), rendered)


def matching_text(text: Column) -> Column:
    """Quotes unified, white space collapsed, lower case: the form lines are compared in."""
    return F.lower(collapse(F.translate(text, "\"“”’", "''''")))


def matching_word(word: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(word), F.lit("’"), F.lit("'")), f"[^{LOWER}{DIGITS}']+", "")


def matching_words(words: Column) -> Column:
    """`matching_word` of every word, by one pass over all of them. Words that cannot be told apart in
    the joined text (null, or with a line break) are taken one by one."""
    apart = (F.size(words) == 0) | F.exists(words, lambda w: w.isNull() | F.contains(w, F.lit("\n")))
    joined = F.replace(F.lower(F.array_join(words, "\n")), F.lit("’"), F.lit("'"))
    return F.when(apart, F.transform(words, matching_word)).otherwise(
        F.split(F.regexp_replace(joined, f"[^{LOWER}{DIGITS}'\n]+", ""), "\n"))


def classify_message(message: Column) -> Column:
    """Outcome named by a message's tail: credits, then policy, then a failure."""

    def names(words: Sequence[str], where: Column) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | where.contains(word)
        return hit

    def outcome(tail: Column) -> Column:
        return (F.when(names(CREDIT_WORDS, tail), F.lit("rate_limit"))
                .when(names(POLICY_WORDS, tail), F.lit("permanent"))
                .when(names(FAILURE_WORDS, F.right(tail, F.lit(250))), F.lit("transient")))

    # the message is collapsed once, not once a word
    return bound(collapse(message), lambda m: bound(F.lower(F.right(m, F.lit(600))), outcome))


def wrap_instruction(prompt: Column, seconds: Column, default_seconds: int = 8) -> Column:
    length = F.when(F.coalesce(seconds, F.lit(0.0)) == 0, F.lit(default_seconds)).otherwise(
        F.floor(seconds).cast("int"))
    return F.concat(
        F.lit("Generate exactly one "), length.cast("string"),
        F.lit("-second 16:9 video (one output only) using the attached image as the start frame. "
              "Use this prompt exactly as written, without rewriting it: "), collapse(prompt))
