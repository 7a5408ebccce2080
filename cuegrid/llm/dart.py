"""MinHash near-dedup with DartMinHash signatures of weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cuegrid.llm.arrow_text import column, mixed, signed, slices, text_bytes, word_bounds, word_names
from cuegrid.llm.lineage import settled

SHINGLE = 5
SIMILARITY = 0.8
#: 25 bands of 4: two texts of similarity 0.8 share none with probability 2e-6.
BANDS, ROWS = 25, 4
#: Slots of the bitmap of a text's shingles, by which pairs are ruled out.
SLOTS = 2048

_FACTORS = mixed(np.arange(16, dtype=np.uint64), 31) | np.uint64(1)
_SIGNED = "doc_id long, text_hash long, print_a long, print_b long, total long, bands array<long>"


def weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle name, times it occurs there) for every distinct shingle of every text. A text
    of fewer words than a shingle has one shingle of all its words; one without words has none."""
    data, offsets = text_bytes(texts)
    starts, ends, firsts = word_bounds(data, offsets)
    names = word_names(data, starts, ends)
    n = np.diff(firsts)
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(firsts[:-1], count)
    total = size[owner].astype(np.uint64)
    for j in range(SHINGLE):
        inside = j < size[owner]
        total += np.where(inside, names[np.minimum(at + j, len(names) - 1)] * _FACTORS[j], np.uint64(0)) if len(names) else 0
    shingle = mixed(total, 32)
    codes, _ = pd.factorize(mixed(shingle + mixed(owner.astype(np.uint64), 33), 34))
    first = np.zeros(codes.max() + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return owner[first], shingle[first], np.bincount(codes, minlength=len(first)).astype(float)


def _arrivals(names: np.ndarray, step: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(dart names, exponential gaps) of the given throw in each strip."""
    dart = mixed(names + np.asarray(step, np.uint64) * np.uint64(0x9E3779B97F4A7C15), 35)
    return dart, -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, coordinates: int) -> np.ndarray:
    """DartMinHash: for each of `sets` weighted sets, the name of the earliest dart of each coordinate.

    Darts are a Poisson process of unit rate over element x weight x time; names, places and times
    depend on the element alone. The weights of an element are cut into strips [0,1), [1,2), [2,4)
    and so on, and each strip throws its darts in order of time. A set sees the darts below its own
    weights. It looks until time t / total weight, with t = k (ln k + 2) for k coordinates, which
    takes about t darts however large the set is; sets with a coordinate still empty look on, for
    twice as long. Two sets share a coordinate's dart with the probability of their weighted
    Jaccard similarity. Weights must be positive. A set without elements has zeros."""
    out = np.zeros((sets, coordinates), np.uint64)
    total = np.bincount(owner, weight, minlength=sets)
    todo = np.flatnonzero(total > 0)
    darts = coordinates * (np.log(coordinates) + 2)
    while len(todo):
        row = np.full(sets, -1)
        row[todo] = np.arange(len(todo))
        mine = row[owner] >= 0
        found = _earliest(row[owner[mine]], element[mine], weight[mine], (darts / total[todo]), len(todo), coordinates)
        full = (found != 0).all(axis=1)
        out[todo[full]] = found[full]
        todo, darts = todo[~full], 2 * darts
    return out


def _earliest(owner, element, weight, until, sets, coordinates) -> np.ndarray:
    # strips: element, how far they reach, and their darts' rate
    strips = [(np.arange(len(owner)), 0.0, 1.0)]
    low = 1.0
    while len(more := np.flatnonzero(weight > low)):
        strips.append((more, low, low))
        low *= 2
    cells, names, times = [], [], []
    for k, (at, start, width) in enumerate(strips):
        seed = mixed(element[at], 40 + k)
        limit, time, step, together = until[owner[at]], np.zeros(len(at)), 0, 1
        while len(at):
            if together == 1:
                dart, gap = _arrivals(seed, step)
                when = (time + gap / width)[:, None]
                dart = dart[:, None]
            else:
                dart, gap = _arrivals(seed[:, None], np.arange(step, step + together)[None, :])
                when = time[:, None] + np.cumsum(gap / width, axis=1)
            hit = when < limit[:, None]
            i, j = np.nonzero(hit)
            more = mixed(dart[i, j], 36)
            below = start + width * ((more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0 ** -32) < weight[at[i]]
            i, j, more = i[below], j[below], more[below]
            cells.append(owner[at[i]] * coordinates + ((more >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64))
            names.append(dart[i, j])
            times.append(when[i, j])
            on = np.flatnonzero(hit[:, -1])  # the last throw was in time, so there may be more
            at, seed, limit, time, step = at[on], seed[on], limit[on], when[on, -1], step + together
            together = 1 if step < 6 else 32
    cell, name, time = np.concatenate(cells), np.concatenate(names), np.concatenate(times)
    order = np.argsort(time, kind="stable")[::-1]
    found = np.zeros(sets * coordinates, np.uint64)
    found[cell[order]] = name[order]  # the earliest is written last
    return found.reshape(sets, coordinates)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        n = batch.num_rows
        owner, shingle, weight = weighted_shingles(column(batch, "text"))
        values = dart_signatures(owner, shingle, weight, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
        bands = mixed((values * _FACTORS[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 37)
        filled = np.zeros(n, bool)
        filled[owner] = True
        prints = []
        for salt in (38, 39):
            one = mixed(shingle + mixed(weight.astype(np.uint64), salt), salt)
            sums = np.zeros(len(one) + 1, np.uint64)
            np.cumsum(one, out=sums[1:], dtype=np.uint64)
            # elements of a text stand together: text numbers rise
            edge = np.searchsorted(owner, np.arange(n + 1))
            prints.append(pa.array(signed(sums[edge[1:]] - sums[edge[:-1]])))
        lists = pa.ListArray.from_arrays(np.arange(0, BANDS * n + 1, BANDS, dtype=np.int32), pa.array(signed(bands.reshape(-1))))
        yield pa.record_batch({"doc_id": column(batch, "doc_id"), "text_hash": column(batch, "text_hash"), "print_a": prints[0], "print_b": prints[1],
                               "total": pa.array(np.bincount(owner, weight, minlength=n).astype(np.int64)),
                               "bands": lists}).filter(pa.array(filled))


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of texts in pairs."""
    n = len(left)
    sides = [weighted_shingles(x) for x in (left, right)]
    pair = np.concatenate([s[0] for s in sides])
    keys = mixed(np.concatenate([s[1] for s in sides]) + mixed(pair.astype(np.uint64), 33), 34)
    weight = np.concatenate([s[2] for s in sides])
    codes, _ = pd.factorize(keys)
    half = len(sides[0][0])
    a = np.bincount(codes[:half], weight[:half], minlength=codes.max() + 1 if len(codes) else 0)
    b = np.bincount(codes[half:], weight[half:], minlength=len(a))
    at = np.zeros(len(a), np.int64)
    at[codes] = pair
    least, most = np.bincount(at, np.minimum(a, b), minlength=n), np.bincount(at, np.maximum(a, b), minlength=n)
    return np.divide(least, most, out=np.zeros(n), where=most > 0)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text_b"):
        close = similarity(column(batch, "text_a"), column(batch, "text_b")) >= SIMILARITY - 1e-12
        yield pa.record_batch({"a": column(batch, "a"), "b": column(batch, "b")}).filter(pa.array(close))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        owner, shingle, weight = weighted_shingles(column(batch, "text"))
        yield pa.record_batch({"shingle": pa.array(signed(shingle)), "node": column(batch, "doc_id").take(pa.array(owner)), "weight": pa.array(weight.astype(np.int64))})


def own_weight(texts: DataFrame) -> DataFrame:
    """(node, own): how much of a node's weight lies on shingles that no other of these texts has."""
    rows = texts.mapInArrow(_shingles, "shingle long, node long, weight long")
    lone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("z"), F.sum("weight").alias("weight")).where("node = z")
    return lone.groupBy("node").agg(F.sum("weight").alias("own"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        n = batch.num_rows
        owner, shingle, weight = weighted_shingles(column(batch, "text"))
        slots = np.zeros((n, SLOTS), bool)
        slots[owner, (shingle >> np.uint64(40)).astype(np.int64) % SLOTS] = True
        longs = np.packbits(slots, axis=1).view(np.int64).reshape(-1)
        yield pa.record_batch({
            "node": column(batch, "doc_id"), "total": pa.array(np.bincount(owner, weight, minlength=n).astype(np.int64)), "filled": pa.array(slots.sum(axis=1)),
            "bits": pa.ListArray.from_arrays(np.arange(0, n * SLOTS // 64 + 1, SLOTS // 64, dtype=np.int32), pa.array(longs))})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # a common partner is on the `a` side, where only its partners' rows are split and its one row is repeated
    return pairs.join(right, "b").join(left, "a").mapInArrow(_verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each connected component; nodes without edges are
    left out. Labels spread along edges and then jump to their label's label, so chains shorten by
    half each round."""
    both = settled(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = settled(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = settled(step)
        jump = settled(step.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label").select(
            "node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("moved")))
        labels = jump.select("node", "label")
        if jump.where("moved").isEmpty():
            return labels


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class): one row for each distinct text of each document with an id.

    A document's texts are apart here: each (doc_id, text) is a node, named by a 64-bit hash, and
    `class` is the smallest name that links reach."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).where(
        F.col("doc_id").isNotNull()).withColumn("node", F.xxhash64("doc_id", "text_hash"))
    linked = _linked(known.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), F.col("class_id").alias("class")).distinct()
    return known.select("doc_id", "text_hash", "node").distinct().join(linked, "node").select("doc_id", "text_hash", "class")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), text_hash.

    Documents are of one class if texts of theirs are (`text_classes`), directly or by way of
    others. Texts without words (null, empty, white space) are alone. A null doc_id has a null
    class. Rows that share a doc_id are one document, all of whose texts count. Extra columns are
    ignored; empty tables give no rows."""
    found = settled(text_classes(docs))
    classed = found.select("doc_id", "class").distinct()
    several = classed.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z")
    edges = settled(classed.join(several, "doc_id").where("class > a").select("a", F.col("class").alias("b")).distinct())
    if not edges.isEmpty():
        whole = components(edges).select(F.col("node").alias("class"), "label")
        classed = classed.join(whole, "class", "left").select("doc_id", F.coalesce("label", "class").alias("class")).distinct()
    least = classed.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    of_doc = classed.join(least, "class").select("doc_id", "class_id")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).join(
        of_doc, "doc_id", "left").select("doc_id", "class_id", "text_hash")


def _linked(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text), whose doc_id has one text: doc_id, class_id (smallest
    doc_id of its class), text_hash.

    A text is the multiset of its five-word shingles; two are linked if the weighted Jaccard
    similarity is 0.8 or more, and a class is all that links connect. Texts with one multiset are
    one node from the start (its smallest doc_id), so copies are never paired. Nodes that share a
    band of DartMinHash values are candidates; links are verified on whole texts.

    A bucket of many near copies must not give all its pairs. First its nodes meet one hub, the node
    that shares most buckets with others, which stands in the middle of its copies. Where several
    classes are left in a bucket, every pair across classes is verified unless a bound rules it out:
    what two texts share is at most what either has less what is its own (on shingles that no other
    text in open buckets has), and less the shingles whose slots of a bitmap the other does not
    fill. Pairs within a class could not change it. So no link between candidates is lost, and a
    bucket of near copies costs about its size."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    known = keyed.where(F.col("doc_id").isNotNull())
    signs = settled(known.mapInArrow(_sign, _SIGNED))
    groups = signs.groupBy("print_a", "print_b").agg(F.min("doc_id").alias("node"))
    member = settled(signs.select("doc_id", "text_hash", "print_a", "print_b", "total").join(groups, ["print_a", "print_b"])
                     .select("doc_id", "text_hash", "total", "node"))
    # one text for each node: the row whose shingles the node stands for
    chosen = member.where("doc_id = node").groupBy("doc_id").agg(F.min(F.struct("text_hash", "total")).alias("one")).select("doc_id", "one.*")
    bands = signs.join(chosen.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi").select(
        F.col("doc_id").alias("node"), F.explode(F.array_distinct("bands")).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = settled(bands.join(shared, "band").dropDuplicates(["band", "node"]))
    degrees = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    hubs = buckets.join(degrees, "node").groupBy("band").agg(F.min(F.struct(-F.col("degree"), "node")).alias("h")).select("band", F.col("h.node").alias("hub"))
    met = settled(_ordered(buckets.join(hubs, "band").where("node <> hub").select("hub", "node")))
    involved = chosen.join(degrees.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    texts = settled(known.join(involved, ["doc_id", "text_hash"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]))
    # a document whose rows have several texts is one node to begin with
    same = member.where("doc_id <> node").join(chosen.select("doc_id"), "doc_id", "left_semi").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    labels = components(settled(verified(met, texts).unionByName(same).distinct()))

    still = settled(_several(buckets.select("band", "node"), labels))
    nodes = still.select(F.col("node").alias("doc_id")).distinct()
    open_texts = texts.join(nodes, "doc_id", "left_semi")
    stats = open_texts.mapInArrow(_bitmaps, "node long, total long, filled long, bits array<long>").join(own_weight(open_texts), "node", "left")
    stats = settled(stats.withColumn("own", F.coalesce("own", F.lit(0))).where("5 * (total - own) >= 4 * total"))
    rows = still.join(stats, "node")
    lacks = F.aggregate(F.zip_with("l.bits", "r.bits", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda a, n: a + n)
    enough = lambda common: 9 * common >= 4 * (F.col("l.total") + F.col("r.total"))
    across = rows.alias("l").join(rows.alias("r"), "band").where(
        (F.col("l.label") < F.col("r.label")) & enough(F.least(F.expr("l.total - l.own"), F.expr("r.total - r.own")))
        & enough(F.least(F.col("l.total") - lacks, F.col("r.total") - F.col("r.filled") + F.col("l.filled") - lacks)))
    across = _ordered(across.select(F.col("l.node").alias("x"), F.col("r.node").alias("y"))).join(met, ["a", "b"], "left_anti")
    last = settled(verified(across, texts))
    classed = member.select("doc_id", "text_hash", "node").distinct().join(labels, "node", "left").withColumn("class_id", F.coalesce("label", "node"))
    if not last.isEmpty():  # classes that the last links join
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        joins = last.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
            F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y")).where("x <> y")
        merged = components(settled(_ordered(joins))).select(F.col("node").alias("class_id"), F.col("label").alias("whole"))
        classed = classed.join(merged, "class_id", "left").withColumn("class_id", F.coalesce("whole", "class_id"))
    classed = classed.select("doc_id", "text_hash", "class_id")
    return keyed.select("doc_id", "text_hash").join(classed, ["doc_id", "text_hash"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "text_hash")


def _several(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose nodes are of several classes, with their labels."""
    labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    return labelled.join(apart, "band")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a < b."""
    x, y = pairs.columns
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
