"""Merkle manifest of a dataset: a tree of SHA-256 states, proofs, and folding from changed leaves."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuegrid.llm.lineage import settled
from cuegrid.llm.lines import ascii_lower
from cuegrid.llm.midstate import FAN_OUT, Level, Step, hex_text, packed, steps, words

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A task handles a subtree of this many levels at once, i.e. 8**4 = 4,096 nodes.
TILE_LEVELS = 4
_BUILT = "tree string, tile long, depth int, ids array<long>, nodes binary, changed binary, top binary"
_PROVEN = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def leaf_of(text: Column | None = None) -> Column:
    """The 32 bytes of a row's leaf; `text` stands in for its text."""
    parts = []
    for name in FIELDS:
        value = (F.col(name) if text is None or name != "text" else text).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A to Z in lower case where 3 divides the checksum of the id, else as it is."""
    return F.when(F.crc32(doc_id.cast("string")) % 3 == 0, ascii_lower(text)).otherwise(text)


def _ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """`nodes` with rank (from 0 within the tree, in order) and depth (levels of the tree).

    Rows are sorted by range, so a tree with nearly all rows is spread over the ranges. What a
    range holds of each tree is a small table whose running sums give where it begins."""
    place = F.monotonically_increasing_id()
    ranged = settled(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).select(
        "*", F.shiftrightunsigned(place, 33).alias("part"), place.alias("place")))
    held = ranged.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settled(held.select("part", "tree", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "first", F.sum("n").over(tree).alias("all")))
    # levels until one node remains: the octal digits of the last rank
    depth = F.when(F.col("all") > 1, F.length(F.conv((F.col("all") - 1).cast("string"), 10, 8))).otherwise(0)
    return ranged.join(starts, ["part", "tree"]).select(
        *nodes.columns, (F.col("before") + F.col("place") - F.col("first")).alias("rank"), depth.cast("int").alias("depth"))


def _levels(nodes: np.ndarray, count: int) -> tuple[list[Level], np.ndarray]:
    """`count` levels above the nodes, and the nodes at their top."""
    out = []
    for _ in range(count):
        out.append(Level(nodes))
        nodes = out[-1].parents
    return out, nodes


def _built(base: int, span: int):
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        depth = rows["depth"][0].as_py()
        nodes = b"".join(rows["node"].to_pylist())
        _, top = _levels(words(nodes), min(span, depth - base))
        return pa.table({
            "tree": rows["tree"][:1], "tile": pa.array([rows["rank"][0].as_py() // FAN_OUT ** span], pa.int64()), "depth": pa.array([depth], pa.int32()),
            "ids": pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())), "nodes": pa.array([nodes], pa.binary()),
            "changed": pa.array([b"".join(rows["changed"].to_pylist())], pa.binary()), "top": pa.array([packed(top)], pa.binary())})

    return build


def grown(nodes: DataFrame, span: int) -> list[DataFrame]:
    """Trees over ranked nodes (tree, rank, depth, id, node, changed): for each round of `span` levels
    a row for each tile of 8**span nodes. A round's top nodes are the next round's nodes. Every
    round is written, so a lost executor costs some tiles."""
    most = nodes.agg(F.max("depth")).first()[0]
    rounds: list[DataFrame] = []
    for base in range(0, max(1, most or 0), span):
        tile = nodes.withColumn("tile", F.expr(f"rank div {FAN_OUT ** span}")).groupBy("tree", "tile")
        rounds.append(settled(tile.applyInArrow(_built(base, span), _BUILT)))
        nodes = rounds[-1].where(F.col("depth") > base + span).select(
            "tree", F.col("tile").alias("rank"), "depth", F.lit(None).cast("long").alias("id"), F.col("top").alias("node"), F.lit(b"").alias("changed"))
    return rounds


def tops(rounds: list[DataFrame], span: int) -> DataFrame:
    """(tree, node): the node that remains of each tree."""
    out = None
    for k, tiles in enumerate(rounds):
        done = tiles.where(_ends_in(k, span)).select("tree", F.col("top").alias("node"))
        out = done if out is None else out.unionByName(done)
    return out


def _ends_in(k: int, span: int) -> Column:
    last = F.col("depth") <= (k + 1) * span
    return last if k == 0 else last & (F.col("depth") > k * span)


def _entry_paths(base: int, span: int):
    """For each node of a tile the path from it upwards: its own levels, then the tile's path."""

    def walk(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes = words(row["nodes"])
                levels, _ = _levels(nodes, min(span, row["depth"] - base))
                made: list[bytes] = [row["path"]]
                for level in reversed(levels):
                    made = [level.step(k) + made[k // FAN_OUT] for k in range(level.nodes.shape[1])]
                n = nodes.shape[1]
                yield pa.record_batch({
                    "tree": pa.array([row["tree"]] * n, pa.string()), "tile": pa.array(np.arange(n) + row["tile"] * FAN_OUT ** span),
                    "top_path": pa.array(made, pa.binary()), "subroot": pa.array([row["subroot"]] * n, pa.binary())})

    return walk


def _descend(rounds: list[DataFrame], starts: DataFrame, span: int) -> DataFrame:
    """Tiles of the lowest round with the path from their top. `starts`: (tree, path, subroot)."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        own = rounds[k].where(_ends_in(k, span)).join(starts, "tree")
        if above is not None:
            met = rounds[k].where(~_ends_in(k, span)).join(above.withColumnRenamed("top_path", "path"), ["tree", "tile"])
            own = own.unionByName(met)
        if k == 0:
            return own
        above = settled(own.mapInArrow(_entry_paths(k * span, span), "tree string, tile long, top_path binary, subroot binary"))
    raise ValueError("no rounds")


def _proven(span: int):
    """Proof and fold of each leaf of a tile."""

    def prove(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                leaves = words(row["nodes"])
                levels, _ = _levels(leaves, min(span, row["depth"]))
                above: list[Step] = steps(row["path"])
                rest = [b"".join(step.siblings for step in above)]
                for level in reversed(levels):  # the siblings from each node upwards, level by level
                    text, last = hex_text(level.nodes), rest
                    runs = [text[j:j + FAN_OUT] for j in range(0, len(text), FAN_OUT)]
                    rest = [b"".join(run[:s] + run[s + 1:]) + last[j] for j, run in enumerate(runs) for s in range(len(run))]
                n = leaves.shape[1]
                own, value = np.arange(n), words(row["changed"])
                for level in levels:
                    value = level.folded(own, value)
                    own = own // FAN_OUT
                for step in above:
                    value = step.folded(value)
                yield pa.record_batch({
                    "doc_id": pa.array(row["ids"], pa.int64()), "leaf": pa.array([x.decode() for x in hex_text(leaves)], pa.string()),
                    "subroot": pa.array([row["subroot"].hex()] * n, pa.string()), "proof_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()),
                    "folded_root": pa.array([x.decode() for x in hex_text(value)], pa.string())})

    return prove


def manifest(docs: DataFrame, changed: Column | None = None, span: int = TILE_LEVELS) -> DataFrame:
    """The Merkle tree of a table of documents, with a proof and a fold for each row.

    A leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each `-` if null, else its
    UTF-8 byte count, a colon and the value. Leaves of one lang ascend by doc_id (nulls first,
    equal ids by leaf); every eight nodes, the last run maybe fewer, become the SHA-256 of their
    hex texts until one remains, the lang's subroot. Subroots in order of lang (null first, by
    bytes) become the root likewise. ``proof_sha256`` is the hash of all siblings from the leaf
    to the root. ``folded_root`` is the root with the leaf of `changed` (a column of text; the
    text itself if none) in place of the leaf; ``verified`` says whether that is the root.

    Every parent keeps the state of its hash before each child's slot. A fold resumes the state
    before the changed child and takes that child and its right siblings only; what lies left
    is in the state. Only ids and digests are shuffled, never texts, and tiles of 8**span nodes
    meet the tasks one by one, however many rows a lang has.

    Repeated rows are a leaf each, side by side. An empty table gives no rows. Extra columns are
    ignored. A text of any length is hashed in its own row.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root (lowercase hex), verified."""
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("id"),
        leaf_of().alias("node"), leaf_of(F.col("text") if changed is None else changed).alias("changed"))
    rounds = grown(_ranked(leaves, "id", "node"), span)
    langs = settled(_ranked(tops(rounds, span).select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node"), "lang"))
    over = grown(langs.withColumn("id", F.lit(None).cast("long")).withColumn("changed", F.lit(b"")), span)
    found = tops(over, span).first()
    root = None if found is None else bytes(found["node"]).hex()
    blank = tops(over, span).select("tree", F.lit(b"").alias("path"), F.col("node").alias("subroot"))
    entries = _descend(over, blank, span).mapInArrow(_entry_paths(0, span), "tree string, tile long, top_path binary, subroot binary")
    starts = settled(entries.select(F.col("tile").alias("rank"), F.col("top_path").alias("path")).join(langs, "rank").select(
        F.col("lang").alias("tree"), "path", F.col("node").alias("subroot")))
    proven = _descend(rounds, starts, span).select("depth", "ids", "nodes", "changed", "path", "subroot").mapInArrow(_proven(span), _PROVEN)
    return proven.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
