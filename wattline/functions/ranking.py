"""Ordering helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(seed: int, *key: Column | str) -> Column:
    """A repeatable pseudo-random sort key that other SQL engines can compute too."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= k`` lets Spark prune each group to ``k`` rows before the
    shuffle, so a hot key sends at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def sorted_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows written in ``order``, dealt into ranges by splitters that Spark samples of the whole sort key.

    The rows are written before that, since sampling would compute them a second time. Adds ``_part``, the range, and ``_place``, from 1 inside it. Equal leading keys are split by what follows them.
    """
    from wattline.sources.sinks import written

    at = F.monotonically_increasing_id()
    placed = written(written(df, "unranked").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranked")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*df.columns, F.shiftright("_at", 33).alias("_part"), place.alias("_place"))


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "pos", total: str = "total") -> DataFrame:
    """Every row's 1-based rank in ``order`` and the count of all rows.

    No task sorts all rows: a row's rank is its place in its sorted range plus the rows of the ranges before it, for which
    one row per range is summed up.
    """
    placed = sorted_ranges(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ranges = Window.partitionBy(F.lit(0)).orderBy("_part")
    ahead, every = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(every).alias(total))
    return placed.join(sizes, "_part").withColumn(out, F.col("_place") + F.col("_ahead")).drop("_part", "_place", "_ahead")
