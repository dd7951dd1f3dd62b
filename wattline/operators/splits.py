"""Leakage-safe splits. Positions start again at 0 inside every split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.blocks import row_index

# Share of train / val / test rows per data set family.
RATIOS = {"default": (0.6, 0.2, 0.2), "zones": (0.8, 0.1, 0.1), "market": (1.0, 0.0, 0.0)}


def split_ratio(df: DataFrame, pos: str, total: Column, ratios: tuple[float, float, float] = RATIOS["default"]) -> DataFrame:
    """Chronological split at ``int(T * r)``; adds ``split`` and ``split_idx``."""
    first = F.floor(total * F.lit(float(ratios[0])))
    second = F.floor(total * F.lit(float(ratios[0] + ratios[1])))
    p = F.col(pos)
    return df.withColumn(
        "split", F.when(p < first, "train").when(p < second, "val").otherwise("test")
    ).withColumn("split_idx", p - F.when(p < first, 0).when(p < second, first).otherwise(second))


def split_index(df: DataFrame, pos: str, membership: DataFrame) -> DataFrame:
    """Explicit lists ``(split, pos, ordinal)``: the ordinal is the new position."""
    return df.join(membership.select("split", pos, F.col("ordinal").alias("split_idx")), pos)


def split_year(df: DataFrame, ts: str, train_year: int, test_year: int) -> DataFrame:
    y = F.year(ts)
    return df.where(y.isin(train_year, test_year)).withColumn(
        "split", F.when(y == train_year, "train").otherwise("test")
    )


def split_year_internal(axis: DataFrame, ts: str, year: int, train: float = 0.8, val: float = 0.9) -> DataFrame:
    """80/10/10 of the rows of one year, by position in that year. ``axis`` has one row per timestamp."""
    inside = row_index(axis.where(F.year(ts) == year), [], [ts], F.to_date(ts), "pos_in_year")
    n = axis.where(F.year(ts) == year).agg(F.count(F.lit(1))).scalar()
    p = F.col("pos_in_year")
    return inside.withColumn(
        "split", F.when(p < F.floor(n * F.lit(train)), "train").when(p < F.floor(n * F.lit(val)), "val").otherwise("test")
    )


def split_days(days: DataFrame, keys: Sequence[str], day: str, train: float, val: float) -> DataFrame:
    """Ratio over distinct days per key; ``days`` has one row per (key, day)."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(day)) - 1
    n = F.count(F.lit(1)).over(w)
    d = days.withColumn("_r", rank).withColumn("_n", n)
    out = d.withColumn(
        "split",
        F.when(F.col("_r") < F.floor(F.col("_n") * F.lit(train)), "train")
        .when(F.col("_r") < F.floor(F.col("_n") * F.lit(train + val)), "val")
        .otherwise("test"),
    )
    return out.drop("_r", "_n")


def split_dates(df: DataFrame, day: str, bounds: dict[str, tuple[str, str]]) -> DataFrame:
    expr = None
    for name, (lo, hi) in bounds.items():
        hit = F.col(day).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return df.withColumn("split", expr).where("split is not null")


def split_holdout_tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, share: float = 0.15) -> DataFrame:
    """The last ``share`` of each key's ordered items is the validation part."""
    numbered = row_index(df, keys, order, bucket, "_p")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * F.lit(1.0 - share))
    return numbered.join(sizes, list(keys)).withColumn(
        "split", F.when(F.col("_p") < cut, "train").otherwise("val")
    ).drop("_p", "_n")


def time_range(windows: DataFrame, ts: str, start: str | None, end: str | None, cap: int | None, order: Sequence[str]) -> DataFrame:
    out = windows
    if start:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return out.orderBy(*order).limit(cap) if cap else out
