"""Secret scans: an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column, slices

# ---- fixed values: the three base kinds, in the order in which they are listed ----
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Further kinds of this scanner: key blocks, tokens with a known head, and signed web tokens.
PRIVATE = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"
PREFIXED = r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
SIGNED = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
# ---- end of fixed values ----

#: Kind -> (pattern, group whose length counts, least length). Order breaks ties of position.
RULES = {
    "assign": (ASSIGN, 1, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24),
    "private": (PRIVATE, 0, 0), "prefixed": (PREFIXED, 0, 0), "signed": (SIGNED, 0, 0)}
BASE_KINDS = ("assign", "access", "hex")
#: Raised whenever RULES changes, so that every blob is scanned again.
RULE_VERSION = 1

#: Without a match of these, no rule of that kind can match; the text search for it is cheap.
_HEAD = {"access": "AKIA", "private": "-----BEGIN ", "signed": "eyJ"}
_COMPILED = {kind: (re.compile(p, re.ASCII), group, least) for kind, (p, group, least) in RULES.items()}
# A run of fewer characters fails, and inside a run nothing longer can begin.
_COMPILED["hex"] = (re.compile(r"[0-9a-f]{24,}"), 0, 24)
_FINDINGS = "blob string, rule_version int, spans array<struct<kind:string,first:int,last:int>>"


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the kind's place in RULES."""
    found = []
    for place, (kind, (pattern, group, least)) in enumerate(_COMPILED.items()):
        if kind in _HEAD and _HEAD[kind] not in text:
            continue
        found += [(m.start(), place, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def joined(spans, kinds=None) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans if kinds is None or k in kinds)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    for batch in slices(batches, "text"):
        spans = [[{"kind": k, "first": a, "last": b} for k, a, b in spans_of(t or "")] for t in column(batch, "text").to_pylist()]
        yield pa.record_batch({
            "blob": column(batch, "blob").cast(pa.string()), "rule_version": pa.array([RULE_VERSION] * len(spans), pa.int32()),
            "spans": pa.array(spans, kind)})


def versions(docs: DataFrame) -> DataFrame:
    """Every version with the address of its content: SHA-256 of the text's bytes (null: empty)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "blob", F.sha2(F.encode("text", "UTF-8"), 256))


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of the contents that `ledger` has not seen at the
    present rule version: each distinct content is scanned once, however many paths hold it.

    Addresses alone are grouped; the text of the chosen holder is then fetched by its row. A
    content without a doc_id has no holder to fetch, so it is scanned where it lies."""
    rows = versions(docs)
    chosen = rows.where(F.col("doc_id").isNotNull()).groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    lone = rows.where(F.col("doc_id").isNull()).select("text", "blob").dropDuplicates(["blob"]).join(chosen.select("blob"), "blob", "left_anti")
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        chosen, lone = chosen.join(seen, "blob", "left_anti"), lone.join(seen, "blob", "left_anti")
    # repeated rows of one doc_id may hold one content; the second scan of it is dropped
    held = rows.join(chosen, ["doc_id", "blob"], "left_semi").select("text", "blob")
    return held.unionByName(lone.select("text", "blob")).mapInArrow(_scan, _FINDINGS).dropDuplicates(["blob"])


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One row per version (doc_id, blob, spans): findings of new and of known contents joined back
    to every path that holds them.

    `ledger` holds rows of earlier runs of :func:`scan_blobs`; keep it by appending what that
    returns. Null text counts as the empty text; a null doc_id is kept; repeated rows give a row
    each; an empty table gives none. Other columns are ignored."""
    found = scan_blobs(docs, ledger)
    if ledger is not None:
        found = found.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "spans"))
    # only contents with findings take part in the join; all others have none
    found = found.where(F.size("spans") > 0).select("blob", "spans")
    return versions(docs).select("doc_id", "blob").join(found, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", F.expr("array()")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their checksum, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(F.encode(told(base), "UTF-8"), 256).alias("base_sha256"),
                        told(F.col("spans")).alias("spans"), "blob")


def without(text: str, spans) -> str:
    """`text` with its spans, overlapping ones as one, replaced by the kind of the first."""
    out, at = [], 0
    for kind, first, last in spans:
        if first >= at:
            out += [text[at:first], f"<{kind}>"]
        at = max(at, last)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """All columns of `docs`, texts without their secrets and n_chars to match. Contents are scanned
    by :func:`scan_blobs`; documents whose content has no finding keep their text as it is, also null.
    Columns called blob or spans are dropped."""
    found = scan_blobs(docs, ledger)
    if ledger is not None:
        found = found.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "spans"))
    found = found.where(F.size("spans") > 0).select("blob", "spans")
    spanned = docs.drop("blob", "spans").withColumn("blob", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).join(found, "blob", "left")

    @F.pandas_udf("string")
    def cleared(texts, spans):
        import pandas as pd

        return pd.Series([
            None if x is None else without(t, [(s["kind"], s["first"], s["last"]) for s in x]) for t, x in zip(texts, spans)], dtype=object)

    dirty = F.col("spans").isNotNull()
    text = F.coalesce(cleared(F.when(dirty, F.col("text")), "spans"), "text")  # only texts with findings go to Python
    return (spanned.withColumn("text", text).withColumn("n_chars", F.when(dirty, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .drop("blob", "spans"))
