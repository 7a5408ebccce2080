"""Row shaping shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unfold(rows: DataFrame, array: Column | str, position: str, value: str, *keep) -> DataFrame:
    """posexplode that evaluates `array` once. For the inner form the optimizer infers a
    filter on the array's size and pushes it, with the whole array expression, below the
    projection, which computes costly arrays again for the test; the outer form has no such
    filter, and the rows it adds for empty arrays are dropped afterwards."""
    out = rows.select(*keep, F.posexplode_outer(array).alias(position, value))
    return out.where(F.col(position).isNotNull())


def settled(rows: DataFrame, **values: Column) -> DataFrame:
    """`rows` with columns that are evaluated once a row, whoever refers to them. The optimizer merges
    a projection into the next one, where a lambda evaluates it for every element, and pushes a
    filter on it below, where it is evaluated again; it does neither past a generator."""
    one = F.array(F.struct(*[value.alias(name) for name, value in values.items()]))
    kept = [c for c in rows.columns if c not in values]
    return rows.select("*", F.explode_outer(one).alias("_once")).select(
        *kept, *[F.col(f"_once.{name}").alias(name) for name in values])


def keep_parallel(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by `keys` into the session's number of shuffle partitions and keep that
    number: adaptive execution merges small partitions by bytes, which would put rows that
    are small but costly to compute into one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys)
