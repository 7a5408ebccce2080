"""The blob ledger against a plain scan of every document."""

import hashlib
import re

from pyspark.sql import functions as F

from cuegrid.llm import secrets

TEXTS = ["token = \"abcdefgh12345678abcdefgh\" x", "password:short", "PASSWORD : 'longer1'", "secret=token: abcdefgh", "api_key=\"a1b2c3\" apikey=123456", "AKIA" + "B" * 16,
         "xAKIA" + "C" * 15 + " AKIA" + "D" * 30, "0" * 23 + " " + "f" * 24 + "g" + "e" * 40, "é𝔘 token='" + "a" * 40 + "'", "toKen=abcdef", "ſecret=abcdefgh", "",
         "passwd = = x token=a.b/c+d_e- token\"='zzzzzz'", "-----BEGIN RSA PRIVATE KEY-----\nabcd\n-----END RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", "pass" * 50_000 + "token=abcdef9"]


def plain(text):
    """Base spans by the rules as they are stated."""
    found = []
    rule = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found += [(m.start(), 0, "assign", m.end()) for m in rule.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_every_document_has_its_findings(documents):
    rows = [*enumerate([*TEXTS, None]), (40, TEXTS[0]), (40, TEXTS[0]), (None, TEXTS[4]), (None, "token=onlyhere"), (41, TEXTS[8])]
    out = secrets.digest(secrets.find_secrets(documents(rows).repartition(3))).collect()
    assert len(out) == len(rows)
    want = sorted((str(d), hashlib.sha256(secrets.joined(plain(t or "")).encode()).hexdigest(), *[sum(k == x for k, _, _ in plain(t or "")) for x in secrets.BASE_KINDS]) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in out) == want
    for r in out:
        assert set(secrets.joined(plain(dict(rows)[r["doc_id"]] or "")).split(",")) - {""} <= set(r["spans"].split(",")) if r["doc_id"] not in (None, 40) else True
    assert secrets.find_secrets(documents(rows).limit(0)).count() == 0


def test_further_kinds_are_added():
    assert [k for k, _, _ in secrets.spans_of(TEXTS[13])] == ["private"] and [k for k, _, _ in secrets.spans_of(TEXTS[14])] == ["signed"]


def test_only_unseen_contents_are_scanned(documents, spark):
    first = documents([(1, TEXTS[0]), (2, TEXTS[0]), (3, "clean")])
    ledger = secrets.scan_blobs(first)
    assert ledger.count() == 2
    ledger = spark.createDataFrame(ledger.collect(), ledger.schema)
    more = documents([(1, TEXTS[0]), (4, "clean"), (5, TEXTS[2]), (6, TEXTS[2])])
    assert secrets.scan_blobs(more, ledger).count() == 1
    assert sorted((tuple(r) for r in secrets.digest(secrets.find_secrets(more, ledger)).select("doc_id", "spans").collect())) == sorted(
        (tuple(r) for r in secrets.digest(secrets.find_secrets(more)).select("doc_id", "spans").collect()))
    stale = ledger.withColumn("rule_version", F.lit(0))
    assert secrets.scan_blobs(more, stale).count() == 3


def test_redaction(documents):
    out = {r["doc_id"]: r for r in secrets.redact(documents([(1, TEXTS[0]), (2, "clean"), (3, None), (4, TEXTS[8])])).collect()}
    assert out[1]["text"] == "<assign>\" x" and out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == "clean" and out[3]["text"] is None
    assert secrets.spans_of(out[4]["text"]) == []
