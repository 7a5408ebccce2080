"""Running values over long ordered groups, without putting a group into one task.

A window over `keys` alone sorts a whole group in one task, which fails when one key holds a
large share of the rows. Here each group is cut into chunks along its order (a time bucket
or an ordinal range: any column that never decreases in that order). Rows are shuffled once
by (keys, chunk); each chunk is reduced to one small row; a window over those small rows
gives what each chunk inherits from the chunks before (or after) it; the inherited value is
joined back on (keys, chunk) and combined with a window inside the chunk.

A scan reads its input twice (for the chunk summaries and for the rows), so an operator that
scans the result of a scan writes the first result to the checkpoint folder in between;
otherwise the work would double with every step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _larger(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | (b > a), b).otherwise(a)


def _smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | (b < a), b).otherwise(a)


def scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, *,
         number: str | None = None, sums: Mapping[str, Column] | None = None,
         sums_before: Mapping[str, Column] | None = None,
         maxes: Mapping[str, Column] | None = None,
         maxes_before: Mapping[str, Column] | None = None,
         mins_after: Mapping[str, Column] | None = None,
         lags: Mapping[str, Column] | None = None,
         leads: Mapping[str, Column] | None = None,
         counts: str | None = None) -> DataFrame:
    """Add running columns to `rows`.

    number        1-based position in the group
    counts        size of the group
    sums          running sum including the row;  sums_before: excluding it (0 at the start)
    maxes         running maximum including the row; maxes_before: excluding it (null first)
    mins_after    minimum over the rows behind the row (null for the last)
    lags, leads   value of the neighbouring row (null at the ends)

    `order` must be a total order inside a group. Null keys are a group of their own and null
    orders come first, as in a window."""
    sums, sums_before = dict(sums or {}), dict(sums_before or {})
    maxes, maxes_before = dict(maxes or {}), dict(maxes_before or {})
    mins_after, lags, leads = dict(mins_after or {}), dict(lags or {}), dict(leads or {})
    keys = list(keys)
    # one struct for group and chunk: structs with null fields are equal to themselves, so rows
    # whose key or order is null stay, and one column serves grouping, join and inner window
    local = rows.withColumn("_g", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias("chunk")))
    place = F.struct(*order)

    parts = [F.count(F.lit(1)).alias("_n")]
    for name, value in (sums | sums_before).items():
        parts.append(F.sum(value).alias(f"_s_{name}"))
    for name, value in (maxes | maxes_before).items():
        parts.append(F.max(value).alias(f"_m_{name}"))
    for name, value in mins_after.items():
        parts.append(F.min(value).alias(f"_a_{name}"))
    for name, value in lags.items():
        parts.append(F.max_by(F.struct(value.alias("v")), place).alias(f"_l_{name}"))
    for name, value in leads.items():
        parts.append(F.min_by(F.struct(value.alias("v")), place).alias(f"_f_{name}"))
    summary = local.groupBy("_g").agg(*parts)

    group = [F.col(f"_g.k{i}") for i in range(len(keys))]
    chunks = Window.partitionBy(*group).orderBy("_g.chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    behind = chunks.rowsBetween(1, Window.unboundedFollowing)
    given = ["_g"]
    if number:
        given.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    if counts:
        given.append(F.sum("_n").over(Window.partitionBy(*group)).alias(counts))
    for name in sums | sums_before:
        given.append(F.sum(f"_s_{name}").over(before).alias(f"_s0_{name}"))
    for name in maxes | maxes_before:
        given.append(F.max(f"_m_{name}").over(before).alias(f"_m0_{name}"))
    for name in mins_after:
        given.append(F.min(f"_a_{name}").over(behind).alias(f"_a0_{name}"))
    for name in lags:
        given.append(F.lag(f"_l_{name}").over(chunks).alias(f"_l0_{name}"))
    for name in leads:
        given.append(F.lead(f"_f_{name}").over(chunks).alias(f"_f0_{name}"))
    inherited = summary.select(*given)

    out = local.join(inherited, "_g")
    inside = Window.partitionBy("_g").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    after = inside.rowsBetween(1, Window.unboundedFollowing)
    made: list[Column] = []
    if number:
        made.append((F.col("_n0") + F.row_number().over(inside)).alias(number))
    if counts:
        made.append(F.col(counts))
    for name, value in sums.items():
        made.append((F.coalesce(f"_s0_{name}", F.lit(0)) + F.sum(value).over(upto)).alias(name))
    for name, value in sums_before.items():
        made.append((F.coalesce(f"_s0_{name}", F.lit(0))
                     + F.coalesce(F.sum(value).over(ahead), F.lit(0))).alias(name))
    for name, value in maxes.items():
        made.append(_larger(F.col(f"_m0_{name}"), F.max(value).over(upto)).alias(name))
    for name, value in maxes_before.items():
        made.append(_larger(F.col(f"_m0_{name}"), F.max(value).over(ahead)).alias(name))
    for name, value in mins_after.items():
        made.append(_smaller(F.col(f"_a0_{name}"), F.min(value).over(after)).alias(name))
    for name, value in lags.items():
        inner = F.lag(F.struct(value.alias("v"))).over(inside)
        made.append(F.coalesce(inner, F.col(f"_l0_{name}"))["v"].alias(name))
    for name, value in leads.items():
        inner = F.lead(F.struct(value.alias("v"))).over(inside)
        made.append(F.coalesce(inner, F.col(f"_f0_{name}"))["v"].alias(name))
    return out.select(*rows.columns, *made)
