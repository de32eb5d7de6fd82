"""Rounding rules of numpy, Python and JavaScript as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_np(x: Column, digits: int) -> Column:
    """numpy ``round``: scale, round half to even, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def _twenty_times(x: Column) -> tuple[Column, Column]:
    """20*x as a double plus the exact error of that double (two-sum)."""
    high, low = x * F.lit(16.0), x * F.lit(4.0)
    total = high + low
    shadow = total - high
    return total, (high - (total - shadow)) + (low - shadow)


def round_one(x: Column) -> Column:
    """Python ``round(x, 1)``: decided on the exact binary value, half to even.

    A value sits on a tie only when 20*x is an odd whole number, so the error
    of that product tells on which side of the tie the true value lies.
    """
    total, error = _twenty_times(x)
    below = F.floor(total / 2.0).cast("double")
    on_tie = F.abs(total % F.lit(2.0)) == 1.0
    even = below % F.lit(2.0) == 0.0
    tied = F.when(error > 0, below + 1).when(error < 0, below).otherwise(
        F.when(even, below).otherwise(below + 1))
    return F.when(on_tie, tied).otherwise(F.rint(total / 2.0)) / 10.0


def fixed_one(x: Column) -> Column:
    """JavaScript ``toFixed(1)`` as a number: as ``round_one``, exact ties go up."""
    total, error = _twenty_times(x)
    below = F.floor(total / 2.0).cast("double")
    on_tie = F.abs(total % F.lit(2.0)) == 1.0
    tied = F.when(error < 0, below).otherwise(below + 1)
    return F.when(on_tie, tied).otherwise(F.rint(total / 2.0)) / 10.0


def round_js(x: Column) -> Column:
    """JavaScript ``Math.round``: halves go up."""
    return F.floor(x + F.lit(0.5))


def mean_of(total: Column, count: Column, unit: int = 1000) -> Column:
    """Mean of a quantity summed as whole ``1/unit`` parts: one division, exact sums."""
    return total / (count * F.lit(unit))


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def degree_parts(name: str, column: str) -> list[Column]:
    """Order-independent sums behind a mean coordinate.

    Whole degrees and 1e-7 fractions are summed as longs, so no partitioning
    changes the mean and the sums stay far from the long limit. Values that are
    not finite do not count.
    """
    value = F.when(is_finite(F.col(column)), F.col(column))
    fraction = F.floor((value - F.floor(value)) * F.lit(1e7) + F.lit(0.5))
    return [
        F.sum(F.floor(value)).alias(f"{name}_whole"),
        F.sum(fraction).alias(f"{name}_part"),
        F.count(value).alias(f"{name}_n"),
    ]


def merge_degree_parts(name: str) -> list[Column]:
    """Second-level sums of :func:`degree_parts`."""
    return [F.sum(f"{name}_{part}").alias(f"{name}_{part}") for part in ("whole", "part", "n")]


def mean_degrees(name: str) -> Column:
    """Mean coordinate from its exact sums; null where no row has one."""
    return F.when(
        F.col(f"{name}_n") > 0,
        (F.col(f"{name}_whole") + F.col(f"{name}_part") / F.lit(1e7)) / F.col(f"{name}_n"),
    )
