"""Rounding that agrees with correctly rounded (half-even) decimal output of a double.

Spark's ``round``/``bround`` round the shortest decimal print of a double, so 2.675 (whose
exact value lies below the midpoint) becomes 2.68. Durations are milliseconds printed with
two decimals, hence such midpoints are common. The column below compares the exact binary
value with the midpoint in DECIMAL arithmetic and stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_BITS = 62


def round_exact(value: Column, digits: int) -> Column:
    """`value` rounded to `digits` decimals on its exact binary value, ties to even."""
    scale = 10 ** digits
    size = F.abs(value)
    whole = F.floor(size)
    fraction = (size - whole) * F.lit(float(2 ** _BITS))
    bits = fraction.cast("bigint").cast("decimal(20,0)")
    low = F.floor((size - whole) * scale).cast("bigint")
    twice = bits * F.lit(2 * scale).cast("decimal(8,0)")

    def settle(q: Column) -> Column:
        middle = (2 * q + 1).cast("decimal(10,0)") * F.lit(2 ** _BITS).cast("decimal(20,0)")
        up = (twice > middle) | ((twice == middle) & (q % 2 == 1))
        return q + F.when(up, 1).otherwise(0)

    # the product with the scale can land on the wrong side of an integer by one
    exact = bits * F.lit(scale).cast("decimal(8,0)")
    unit = F.lit(2 ** _BITS).cast("decimal(20,0)")
    low = (low
           - F.when(low.cast("decimal(10,0)") * unit > exact, 1).otherwise(0)
           + F.when((low + 1).cast("decimal(10,0)") * unit <= exact, 1).otherwise(0))
    out = (whole.cast("double") * scale + settle(low)) / scale
    return F.when(value < 0, -out).otherwise(out)


def round_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, ties to even."""
    return F.rint(seconds * 1000).cast("bigint")


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text of `value` with `digits` decimals, correctly rounded."""
    return F.format_string(f"%.{digits}f", round_exact(value, digits))
