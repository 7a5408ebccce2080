"""Byte shards against a plain running sum."""

import zlib

from cuegrid.llm import shards


def plain(rows, n):
    listed = sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows)
    total, before, counts, out = sum(x[3] for x in listed), 0, {}, []
    for known, d, crc, size in listed:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((d if known else None, size, crc, shard, counts.get(shard, 0)))
        counts[shard] = counts.get(shard, 0) + 1
        before += size
    return out


def test_shards_are_the_running_sum(documents):
    rows = [(k * 7 % 101, "é" * (k % 13) * (k % 5)) for k in range(101)] + [(None, "x"), (200, None), (201, ""), (202, "y" * 9000), (3, "again"), (3, "again")]
    for n in (1, 3, 16, 300):
        got = shards.byte_shards(documents(rows).repartition(4), n, rows_per_part=20).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(plain(rows, n), key=str)


def test_balance(documents):
    rows = [(k, "x" * (k * 37 % 500)) for k in range(3000)]
    sizes = {}
    for r in shards.byte_shards(documents(rows), 16).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * 501


def test_empty(documents):
    assert shards.byte_shards(documents([(1, "a")]).limit(0)).count() == 0
