"""Line dedup against a plain dictionary of lines."""

import hashlib

from pyspark.sql import functions as F

from cuegrid.llm import lines

SPACE = " \t\n\x0b\f\r"
LICENCE = "All rights reserved by the people who wrote this line."


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, least_chars, least_docs):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(d)
    keeper = {k: max(h, key=lambda d: (d is not None, d or 0)) for k, h in holders.items() if len(h) >= least_docs}
    out = []
    for d, t in rows:
        listed = (t or "").split("\n")
        stay = [x for x in listed if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(listed), len(listed) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()), key=str)


def check(documents, rows, least_chars=40, least_docs=5):
    assert digest(lines.kept_texts(documents(rows).repartition(5), least_chars, least_docs)) == plain(rows, least_chars, least_docs)


def test_lines_stay_in_the_largest_document(documents):
    check(documents, [(k, f"own {k}\n{LICENCE}\n\nend {k}") for k in range(5)] + [(9, "short\n" * 7)])
    check(documents, [(k, LICENCE) for k in range(4)])  # one document too few


def test_keys(documents):
    forty = "é" * 39 + "x"
    rows = [(1, f" \t{LICENCE.upper()}\r"), (2, LICENCE), (3, f"\x0b{LICENCE.lower()}\f"), (4, LICENCE + "\n" + LICENCE), (5, " " + LICENCE)]
    check(documents, rows + [(6, LICENCE)])
    check(documents, [(k, forty) for k in range(6)] + [(9, forty[1:])])  # 40 code points, not bytes
    check(documents, [(k, "Ä" * 40 if k % 2 else "ä" * 40) for k in range(12)])  # only A to Z are folded


def test_edges(documents):
    rows = [(None, LICENCE), (None, f"{LICENCE}\nmore"), (1, None), (2, ""), (3, "\n"), (4, "\n\n"), (7, LICENCE), (7, LICENCE), (7, f"x\n{LICENCE}"),
            (8, LICENCE), (9, f"{LICENCE}\n"), (10, f"\n{LICENCE}\ny")]
    check(documents, rows)
    check(documents, rows, 1, 2)
    check(documents, rows, 0, 1)
    assert lines.kept_texts(documents([(1, "a")]).limit(0)).count() == 0


def test_long_texts_and_hot_lines(documents):
    long = "\n".join(LICENCE if k % 97 == 0 else f"line {k} of a text that has very many lines indeed" for k in range(30000))
    rows = [(k, LICENCE if k % 3 == 0 else f"{LICENCE}\nabout {k % 11} something that is long enough to count") for k in range(2000)]
    check(documents, rows + [(5000, long), (5001, long)], 40, 2)
    check(documents, rows + [(-1, long)])


def test_bitmaps_store_only_words_that_lose_lines(spark, documents):
    text = "\n".join([f"own {k}" for k in range(200)] + [LICENCE] + [f"own {k}" for k in range(100)])
    rows = [(k, text if k == 1 else LICENCE) for k in range(6)]
    found = {r["doc_id"]: r for r in lines.keep_bitmaps(documents(rows)).collect()}
    assert found[1]["n_lines"] == 301 and found[1]["n_dropped"] == 1
    assert [(w["word"], ~w["bits"]) for w in found[1]["keep"]] == [(3, 1 << 8)] and found[5]["keep"] == []


def test_plan_shuffles_lines_by_range_without_python(documents, capsys):
    rows = documents([(1, "a")])
    lines.line_keys(rows, 40, 16).repartitionByRange("key", "group").explain()
    lines.kept_texts(rows).explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning(key" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))
