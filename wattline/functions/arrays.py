"""Array statistics as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def amean(a: Column) -> Column:
    return asum(a) / F.size(a)


def astd(a: Column) -> Column:
    """Population standard deviation in one pass (running mean and squared distance).

    A mean used inside a lambda would be worked out again for every element.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        m = acc["m"] + (x - acc["m"]) / n
        return F.struct(n.alias("n"), m.alias("m"), (acc["s"] + (x - acc["m"]) * (x - m)).alias("s"))

    return F.aggregate(a, start, step, lambda acc: F.sqrt(acc["s"] / acc["n"]))


def alast(a: Column) -> Column:
    return F.element_at(a, -1)


def afirst(a: Column) -> Column:
    return F.element_at(a, 1)


def clamped_delta(a: Column, lookback: int) -> Column:
    """last - the value ``lookback`` places from the end, the first one if shorter."""
    return alast(a) - F.element_at(a, F.greatest(F.size(a) - lookback + 1, F.lit(1)))


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def mean_abs_diff(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def rmse_of(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b) / F.size(a))


def clip(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def argmax0(a: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")
