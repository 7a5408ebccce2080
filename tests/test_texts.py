"""The text sink: files in order, published together or not at all; every registered query once."""

import pytest
from pyspark.sql import functions as F

from cuegrid.catalog import check, load
from cuegrid.sources import files, texts

FOLDER = "/root/testdata/sf0.001"


def lines(spark, n=300):
    return spark.createDataFrame([(k, i, f"{k} {i} é") for i in range(n) for k in ("a", "b/c", "ü %", None)], "k string, i int, line string").repartition(7)


def test_files_are_whole_and_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    assert texts.versions(spark, path) == []
    texts.write_texts(lines(spark), path, 1, "k", ["i"], "line", ".srt")
    got = {r.file: r.text for r in texts.read_texts(spark, path).collect()}
    want = {texts.file_name(k) + ".srt": "".join(f"{k} {i} é\n" for i in range(300)) for k in ("a", "b/c", "ü %", None)}
    assert {k: v for k, v in got.items()} == want


def test_versions_are_published_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    texts.write_texts(lines(spark, 3), path, 1, "k", ["i"], "line")

    def broken(batches):
        for batch in batches:
            yield batch
            raise ValueError("the task is lost")

    failing = lines(spark).repartition(3, "k").mapInArrow(broken, "k string, i int, line string")
    with pytest.raises(Exception, match="lost"):
        texts.write_texts(failing, path, 2, "k", ["i"], "line")
    assert texts.versions(spark, path) == [1] and texts.read_texts(spark, path).count() == 4
    with pytest.raises(ValueError):
        texts.read_texts(spark, path, 2)
    with pytest.raises(ValueError):
        texts.write_texts(lines(spark, 1), path, 1, "k", ["i"], "line")
    texts.write_texts(lines(spark, 5), path, 2, "k", ["i"], "line")
    assert texts.versions(spark, path) == [1, 2]
    assert {r.text.count("\n") for r in texts.read_texts(spark, path).collect()} == {5}
    assert {r.text.count("\n") for r in texts.read_texts(spark, path, 1).collect()} == {3}


def test_lost_attempts_stay_unseen(tmp_path):
    writer = texts.TextWriter(str(tmp_path), 1, ".txt")
    lost, kept = writer.write(iter([("a", "half")])), writer.write(iter([("a", "one"), ("a", "two"), ("b", "three")]))
    assert (kept.files, kept.lines) == (2, 3) and lost.folder != kept.folder
    writer.commit([kept, None, writer.write(iter([]))])
    told = (tmp_path / texts.POINTER).glob("*.json")
    assert [kept.folder in p.read_text() and lost.folder not in p.read_text() for p in told] == [True]
    writer.abort([lost])
    assert not (tmp_path / lost.folder).exists() and (tmp_path / kept.folder).exists()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "out")
    texts.write_texts(lines(spark).limit(0), path, 1, "k", ["i"], "line")
    assert texts.versions(spark, path) == [1] and texts.read_texts(spark, path).count() == 0


QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] in "sfw" or n[:2] in ("r1", "r2", "r3", "r4")])
def test_tables_and_rules_equal_sql(spark, name):
    out = QUERIES[name](spark, FOLDER)
    rows = out.collect()
    if name in ORACLES:
        cur = check.connect(FOLDER).execute(ORACLES[name])
        assert check.compare([tuple(r) for r in rows], out.columns, cur.fetchall(), [d[0] for d in cur.description]) == ""


def test_pointer_is_one_small_file(spark, tmp_path):
    path = str(tmp_path / "out")
    texts.write_texts(lines(spark), path, 7, "k", ["i"], "line")
    names = [p.name for p in (tmp_path / "out" / texts.POINTER).iterdir()]
    assert names == [f"{7:020d}.json"] and texts.read_texts(spark, path).agg(F.sum(F.length("text"))).first()[0] > 0


def test_writer_takes_batches_and_splits_keys_over_them(tmp_path):
    import pyarrow as pa

    def batch(*rows):
        return pa.RecordBatch.from_pylist([{"key": k, "line": v} for k, v in rows], pa.schema([("key", pa.int64()), ("line", pa.string())]))

    writer = texts.BatchWriter(str(tmp_path), 1, ".txt")
    told = writer.write(iter([batch((None, "z"), (1, "a"), (1, "")), batch(), batch((1, None), (2, "b\nc"))]))
    assert (told.files, told.lines) == (3, 5)
    found = {p.name: p.read_text() for p in (tmp_path / told.folder).iterdir()}
    assert found == {"null.txt": "z\n", "=1.txt": "a\n\nNone\n", "=2.txt": "b\nc\n"}
    assert writer.write(iter([])).files == 0


def test_driver_lists_no_file_when_a_version_is_read(spark, tmp_path):
    path = str(tmp_path / "out")
    texts.write_texts(spark.range(2000).selectExpr("id k", "id i", "concat('l', id) line"), path, 1, "k", ["i"], "line", ".srt")
    rows = texts.read_texts(spark, path)
    assert not [f for f in rows.inputFiles() if f.endswith(".srt")]
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.file, r.text) for r in rows.collect()} == {(f"={k}.srt", f"l{k}\n") for k in range(2000)}


def test_folders_are_listed_and_files_read_in_bounded_batches(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(texts, "ENTRIES", 3)
    monkeypatch.setattr(texts, "BYTES", 10)
    (tmp_path / "d" / "e").mkdir(parents=True)
    for i in range(7):
        (tmp_path / "d" / f"{i}.txt").write_text("x" * 4)
    (tmp_path / "d" / "7.txt").write_text("y" * 40)

    def column(*values):
        return pa.record_batch([pa.array(values, pa.string())], ["path"])

    found = [b.to_pylist() for b in texts.entries(str(tmp_path))(iter([column("", "d"), column("d/e")]))]
    assert [len(b) for b in found] == [1, 3, 3, 3] and found[0] == [{"path": "d", "folder": True}]
    assert {r["path"] for b in found[1:] for r in b if not r["folder"]} == {f"d/{i}.txt" for i in range(8)}
    read = [b.to_pylist() for b in texts.contents(str(tmp_path), texts._base_name)(iter([column(*[f"d/{i}.txt" for i in range(8)])]))]
    assert [[len(r["content"]) for r in b] for b in read] == [[4, 4], [4, 4], [4, 4], [4], [40]]
    assert [r["file"] for b in read for r in b] == [f"{i}.txt" for i in range(8)]


def odd_tree(root):
    for name in ("a/x.txt", "_h/x.txt", "_h=1/x.txt", ".d/x.txt", "b/_x.txt", "b/.x.txt", "b/_k=1.txt", "b/x._COPYING_", "_metadata/x.txt",
                 "b/_metadata", "top.txt", "d/e/f/g.txt", "c/\u00fcn\u00ef c\u00f6%25+&#?[]{}|^`\"'<>;,@$!*()~=e\u00a0\u3000\u0085\u00e9.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name, encoding="utf-8")
    (root / "b/empty.txt").write_bytes(b"")
    (root / "b/bad.txt").write_bytes(b"\xff a \xc3")
    (root / "b/bom.txt").write_bytes("\ufeffx\r\ny".encode())
    (root / "nothing").mkdir()
    (root / "link").symlink_to(root / "a")
    (root / "broken").symlink_to(root / "nowhere")


def by_spark(spark, path):
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return sorted(tuple(r) for r in rows.select("_metadata.file_path", F.hex("value")).collect())


def test_scripts_are_read_as_by_spark_without_a_list_in_the_driver(spark, tmp_path):
    import gzip

    root = tmp_path / "sp ace%"
    odd_tree(root)
    for path in (str(root), f"{root}/", root.as_uri().replace("%20", " ").replace("%25", "%"), str(root / "link")):
        rows = files.read_scripts(spark, path, r"([^/]+)$")
        assert not [f for f in rows.inputFiles() if f.endswith(".txt")]
        found = rows.select("path", F.hex("text"), "script_id").collect()
        assert sorted(tuple(r)[:2] for r in found) == by_spark(spark, path)
        assert {r.script_id == r.path.rpartition("/")[2] for r in found} == {True}
    assert files.read_scripts(spark, str(root / "nothing")).count() == 0
    for path in (f"{root}/*", str(root / "a/x.txt")):
        assert sorted(tuple(r) for r in files.read_scripts(spark, path).select("path", F.hex("text")).collect()) == by_spark(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_scripts(spark, str(root / "missing")).collect()
    (root / "b/z.txt.gz").write_bytes(gzip.compress(b"one") + gzip.compress(b"two"))
    assert sorted(tuple(r) for r in files.read_scripts(spark, str(root)).select("path", F.hex("text")).collect()) == by_spark(spark, str(root))
