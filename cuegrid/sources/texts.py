"""Ordered texts, one file a key, published all together: a data source with its own commit."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from cuegrid.operators.rows import keep_parallel

FORMAT = "cuegrid_texts"
POINTER = "published"
#: Entries of a folder, and bytes of texts, that a task hands on at a time.
ENTRIES, BYTES = 10_000, 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task has written: a folder of its own."""

    folder: str
    files: int
    lines: int


def _store(path: str):
    """(file system, path in it) of a plain path or any address that pyarrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TextWriter(DataSourceWriter):
    """Each attempt of a task writes into a folder nobody else knows. The commit makes one small file
    that names the folders of the attempts that count; until it is there, nothing is visible, and
    folders it does not name never become so."""

    def __init__(self, root: str, version: int, suffix: str):
        self.root, self.version, self.suffix = root.rstrip("/"), version, suffix

    def write(self, rows: Iterator) -> Written:
        """Rows (key, line) of whole keys, in order; a line is written as it comes."""
        return self.put((row[0], (row[1],)) for row in rows)

    def put(self, parts: Iterator) -> Written:
        """Parts (key, some lines) of whole keys, in order; a part is written as it comes."""
        store, root = _store(self.root)
        name = f"data/version={self.version}/{uuid.uuid4().hex}"
        key, out, files, lines = None, None, 0, 0
        try:
            for found, some in parts:
                if out is None or found != key:
                    if out is not None:
                        out.close()
                    else:
                        store.create_dir(f"{root}/{name}", recursive=True)
                    key = found
                    out = store.open_output_stream(f"{root}/{name}/{file_name(key)}{self.suffix}")
                    files += 1
                out.write("".join([f"{line}\n" for line in some]).encode())
                lines += len(some)
        finally:
            if out is not None:
                out.close()
        return Written(name, files, lines)

    def commit(self, messages: list) -> None:
        store, root = _store(self.root)
        told = [m for m in messages if m is not None]
        document = {"version": self.version, "folders": sorted(m.folder for m in told if m.files), "files": sum(m.files for m in told), "lines": sum(m.lines for m in told)}
        store.create_dir(f"{root}/{POINTER}", recursive=True)
        draft = f"{root}/{POINTER}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(document).encode())
        store.move(draft, f"{root}/{POINTER}/{self.version:020d}.json")

    def abort(self, messages: list) -> None:
        store, root = _store(self.root)
        for message in messages:
            if message is not None and message.files:
                store.delete_dir(f"{root}/{message.folder}")


class BatchWriter(TextWriter, DataSourceArrowWriter):
    """The same from Arrow batches, which Spark bounds: no row object a line, one write for a key's lines in a batch."""

    def write(self, batches: Iterator) -> Written:
        return self.put((key, [line for _, line in rows]) for batch in batches for key, rows in groupby(
            zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), itemgetter(0)))


def file_name(key) -> str:
    """A name of its own for every key, null included."""
    return "null" if key is None else "=" + quote(str(key), safe="")


class Texts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], int(self.options["version"]), self.options.get("suffix", ".txt"))


def entries(root: str) -> Callable[[Iterator], Iterator]:
    """For mapInArrow: (path) of folders, seen from `root`, to (path, folder) of what they hold. As in Spark's file
    sources, hidden names and empty files are left out."""

    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, top = _store(root)
        schema = pa.schema([("path", pa.string()), ("folder", pa.bool_())])
        for batch in batches:
            for above in batch.column(0).to_pylist():
                found = [(f"{above}/{x.base_name}" if above else x.base_name, x.is_file) for x in store.get_file_info(fs.FileSelector(f"{top}/{above}"))
                         if not _hidden(x.base_name, x.is_file) and (x.size if x.is_file else x.type == fs.FileType.Directory)]
                for i in range(0, len(found), ENTRIES):
                    names, files = zip(*found[i : i + ENTRIES])
                    yield pa.record_batch([names, [not x for x in files]], schema)

    return listed


def _hidden(name: str, is_file: bool) -> bool:
    if not is_file and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def contents(root: str, called: Callable[[str], str]) -> Callable[[Iterator], Iterator]:
    """For mapInArrow: (path) of files, seen from `root`, to (file, content), a few MB at a time; `called` makes
    `file` of a file's whole path."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, top = _store(root)
        schema, files, texts, size = pa.schema([("file", pa.string()), ("content", pa.binary())]), [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{path}") as file:
                    text = file.read()
                if files and size + len(text) > BYTES:
                    yield pa.record_batch([files, texts], schema)
                    files, texts, size = [], [], 0
                files.append(called(f"{top}/{path}"))
                texts.append(text)
                size += len(text)
        if files:
            yield pa.record_batch([files, texts], schema)

    return read


def entries_of(folders: DataFrame, root: str) -> DataFrame:
    """(path, folder) of what the folders(path) below `root` hold: the workers list, the driver sees no file."""
    return keep_parallel(folders, "path").mapInArrow(entries(root), "path string, folder boolean")


def texts_of(files: DataFrame, root: str, called: Callable[[str], str]) -> DataFrame:
    """(file, text) of files(path) below `root`, in as many tasks as the session has shuffle partitions,
    however many files there are. Bytes that are no UTF-8 stay."""
    rows = keep_parallel(files, "path").mapInArrow(contents(root, called), "file string, content binary")
    return rows.select("file", F.col("content").cast("string").alias("text"))


def _base_name(path: str) -> str:
    return path.rpartition("/")[2]


def write_texts(rows: DataFrame, path: str, version: int, key: str, order: list[str], line: str, suffix: str = ".txt") -> None:
    """Write one file for each key, its lines in order, and publish all of them as `version`.

    Keys are dealt over tasks by hash and lines sorted within, so a text streams to its file and no
    task holds one. A version that is already published is not written again."""
    spark = rows.sparkSession
    if version in versions(spark, path):
        raise ValueError(f"version {version} is already published in {path}")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the planner's process need not find the package
    spark.dataSource.register(Texts)
    placed = rows.select(F.col(key).alias("key"), F.col(line).alias("line"), F.struct(*order).alias("place")).repartition("key").sortWithinPartitions("key", "place")
    placed.select("key", "line").write.format(FORMAT).option("path", path).option("version", version).option("suffix", suffix).mode("append").save()


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema("version long, folders array<string>, files long, lines long").option("pathGlobFilter", "*.json").json(place.toString())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, rising."""
    found = _pointers(spark, path)
    return [] if found is None else sorted(r.version for r in found.select("version").collect())


def read_texts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file, text) of a published version, the newest if none is named. A scan of Spark's would hold every
    file in the driver and make a task of a few."""
    known = versions(spark, path)
    wanted = version if version is not None else known[-1] if known else None
    if wanted not in known:
        raise ValueError(f"no published version {wanted} in {path}")
    folders = _pointers(spark, path).where(F.col("version") == wanted).select(F.explode("folders").alias("path"))
    files = entries_of(folders, path).where(~F.col("folder")).select("path")
    return texts_of(files, path, _base_name)
