"""Column functions: counting, timing, keys, schedules and small numeric rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from cuegrid import params as P
from cuegrid.functions.rounding import fixed, round_exact

# --- fixed values: token patterns -------------------------------------------------------
# classes list their characters up to U+00FF: those are one table look-up, while ranges are tried one by one
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
WORD = f"[{LOWER.upper()}{LOWER}{DIGITS}{''.join(map(chr, range(0xC0, 0x100)))}Ā-ɏ']+"
SENTENCE_END = "[.!?]+"
CLAUSE_MARKS = ",;:—"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def count_sentence_ends(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END))


def count_clause_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, CLAUSE_MARKS, ""))


def speech_seconds(words: Column, ends: Column, clauses: Column, wps: float = 2.5) -> Column:
    """Spoken length from the three counts: a steady word rate plus punctuation pauses."""
    return F.when(words == 0, F.lit(0.0)).otherwise(
        F.round(words / F.lit(float(wps)) + (ends * 30 + clauses * 12) / F.lit(100.0), 2))


def estimate_speech(text: Column, wps: float = 2.5) -> Column:
    return speech_seconds(count_words(text), count_sentence_ends(text),
                          count_clause_marks(text), wps)


def format_seconds(seconds: Column) -> Column:
    """``m:ss.ss`` from a minute upwards, ``s.sss`` style seconds below, ``-`` for null."""
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    padded = F.lpad(fixed(rest, 2), 5, "0")
    return (F.when(seconds.isNull(), F.lit("-"))
            .when(minutes != 0, F.concat(minutes.cast("string"), F.lit(":"), padded))
            .otherwise(F.concat(fixed(rest, 2), F.lit("s"))))


def subtitle_time(seconds: Column) -> Column:
    ms = F.rint(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000),
                           F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def frame_aligned(seconds: Column, fps: int | Column = 24) -> Column:
    """Round up to whole frames; the inner rounding absorbs float dust."""
    rate = fps if isinstance(fps, Column) else F.lit(fps)
    return F.ceil(F.round(seconds * rate, 6)) / rate


def parse_ratio(value: Column) -> Column:
    """``"24000/1001"`` or a plain number; null for ``0/0``, ``N/A``, empty or zero below."""
    top = F.split_part(value, F.lit("/"), F.lit(1)).try_cast("double")
    bottom = F.substring_index(value, "/", -1).try_cast("double")
    return (F.when(value.isNull() | value.isin("", "0/0", "N/A"), None)
            .when(F.instr(value, "/") > 0, F.try_divide(top, bottom))
            .otherwise(value.try_cast("double")))


def count_syllables(word: Column) -> Column:
    """Vowel groups of the letters a-z, with a silent final e, and at least one."""
    letters = F.regexp_replace(F.lower(word), f"[^{LOWER}]+", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = letters.endswith("e") & ~letters.rlike("(le|ee)$") & (groups > 1)
    return F.greatest(F.lit(1), groups - silent.cast("int"))


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.greatest(low, F.least(high, value))


def segment_suffix(index: Column) -> Column:
    """'' for the first clip of a scene, then ``_b``, ``_c`` ...; null beyond 25."""
    return (F.when(index == 0, F.lit(""))
            .when(index.between(1, 25), F.concat(F.lit("_"), F.char((index + 97).cast("bigint")))))


def segment_scene(stem: Column) -> Column:
    """Scene id of a clip file stem (``scene_004_b`` -> ``scene_004``)."""
    base = F.regexp_extract(stem, r"^([^_]*_[^_]*)_\p{L}$", 1)
    return F.when(base != "", base).otherwise(stem)


def segment_number(stem: Column) -> Column:
    letter = F.regexp_extract(stem, r"^[^_]*_[^_]*_(\p{L})$", 1)
    return F.when(letter != "", F.ascii(letter) - 97).otherwise(F.lit(0))


def text_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def files_fingerprint(files: Column, extra: Column) -> Column:
    """16 hex digits over an ordered ARRAY<STRUCT<name,length,mtime_ns>> and a prefix.

    Only the file *name* takes part, so the caller keys the result by script and scene."""
    lines = F.transform(files, lambda f: F.concat_ws(
        "|", f["name"], f["length"].cast("string"), f["mtime_ns"].cast("string")))
    body = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit(";"))), "")
    return F.substring(F.sha2(F.concat(extra, body), 256), 1, 16)


def voice_key(override: Column, profile: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(override), F.lit("")), F.nullif(profile, F.lit("")),
                      F.lit("unset"))


def unit_key(voice: Column, text: Column) -> Column:
    """Cache key of one narrated sentence."""
    return F.substring(F.sha2(F.concat(voice, F.lit("|"), text), 256), 1, 16)


def take_key(voice: Column, rate: Column, text: Column) -> Column:
    """Cache key of one take at a speaking rate (three decimals)."""
    return F.substring(F.sha2(F.concat(voice, F.lit("|"), fixed(rate, 3), F.lit("|"), text),
                              256), 1, 16)


def trim_signature(audio: P.Audio = P.Audio()) -> str:
    if not audio.trim_silence:
        return "off"
    return "|".join(f"{v:g}" for v in (audio.silence_threshold_db, audio.keep_leading,
                                       audio.keep_trailing))


def trim_signature_column(trim: Column, threshold: Column, lead: Column, trail: Column) -> Column:
    """The same signature from columns holding already printed numbers."""
    return F.when(trim, F.concat_ws("|", threshold, lead, trail)).otherwise(F.lit("off"))


def backoff_delay(attempt: Column, schedule: Sequence[float], rate_limited: Column | None = None,
                  floor: float = 60.0) -> Column:
    """Delay after failed attempt 1, 2, ...: the schedule, then its last value times 3^k."""
    if not schedule:
        delay = F.lit(0.0)
    else:
        steps = F.array(*[F.lit(float(s)) for s in schedule])
        n = len(schedule)
        delay = F.when(attempt <= n, F.get(steps, F.least(attempt, F.lit(n)) - 1)).otherwise(
            F.lit(float(schedule[-1])) * F.pow(F.lit(3.0), attempt - n))
    if rate_limited is None:
        return delay
    return F.when(rate_limited, F.greatest(delay, F.lit(float(floor)))).otherwise(delay)


def error_class(status: Column) -> Column:
    """HTTP status to error class; null for success."""
    return (F.when(status < 400, None)
            .when(status.isin(401, 403), F.lit("permanent"))
            .when(status == 429, F.lit("rate_limit"))
            .when(status >= 500, F.lit("transient"))
            .otherwise(F.lit("permanent")))


def equal_clips(target: Column, max_segment: Column) -> Column:
    """As few equal clips as fit under `max_segment`."""
    n = F.ceil(target / max_segment).cast("int")
    return F.array_repeat(round_exact(target / n, 3), n)


def long_or_short_clips(target: Column, rule: P.LongClips = P.LongClips()) -> Column:
    n = F.greatest(F.lit(1), F.ceil(target / F.lit(rule.long_clip_s * 0.9)).cast("int"))
    return F.when(target <= rule.long_after_s, F.array(F.lit(float(rule.clip_s)))).otherwise(
        F.array_repeat(F.lit(float(rule.long_clip_s)), n))


def window_seed(label: Column, stem: Column) -> Column:
    """Rotation seed: the first number of the label times 7 plus the stem's length."""
    digits = F.regexp_extract(F.coalesce(F.nullif(label, F.lit("")), stem), r"(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0)) * 7 + F.length(stem)


def sub_window_start(length: Column, wanted: Column, matched: Column, seed: Column) -> Column:
    slack = F.greatest(F.lit(0.0), length - F.least(wanted, length))
    return F.when(matched, slack / 2).otherwise(
        F.get(F.array(F.lit(0.0), slack / 2, slack), (seed % 3).cast("int")))


def qa_status(errors: Column, warnings: Column) -> Column:
    return (F.when(F.size(errors) > 0, F.lit("fail")).when(F.size(warnings) > 0, F.lit("warn"))
            .otherwise(F.lit("ok")))


def safe_label(label: Column) -> Column:
    return F.regexp_replace(label, r"(?U)[^\p{IsAlphabetic}\p{N}_-]", "")


def non_empty(length: Column) -> Column:
    return F.coalesce(length, F.lit(0)) > 0


def clip_length(video_duration: Column, duration: Column) -> Column:
    return F.coalesce(F.nullif(video_duration, F.lit(0.0)), duration)


def color_gain(std: Column, target_std: Column) -> Column:
    return F.try_divide(target_std, std)


def color_term(channel: Column, mean: Column, std: Column, target_mean: Column,
               target_std: Column) -> Column:
    """One channel's affine expression, values printed with two and four decimals."""
    return F.concat(channel, F.lit("='clip((val-"), fixed(mean, 2), F.lit(")*"),
                    fixed(color_gain(std, target_std), 4), F.lit("+"), fixed(target_mean, 2),
                    F.lit(",0,255)'"))
