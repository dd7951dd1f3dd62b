"""Means that do not depend on the order in which their rows arrive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(value: Column) -> Column:
    """The mean of values with up to six decimals, summed as decimals and rounded once; of others the plain mean.

    A sum of doubles depends on the order in which rows arrive, so a mean that lies on a threshold may fall on either side.
    """
    value = value.cast("double")
    whole = value.try_cast("decimal(18,6)")
    whole = F.when(whole.cast("double") == value, whole)
    n = F.count(value)
    return F.when(F.count(whole) == n, F.sum(whole).cast("double") / n).otherwise(F.avg(value))


def scan_mean(value: Column, order: Column) -> Column:
    """The mean of doubles added one after the other by ``order``, as an engine does that scans a table in that order.

    Where a mean lies on a rounding edge, its noise decides; this one has the noise of the scan, on any number of tasks.
    """
    value = value.cast("double")
    seen = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    total = F.aggregate(seen, F.lit(0.0), lambda acc, x: acc + x["v"])
    return F.when(F.count(value) > 0, total / F.count(value))
