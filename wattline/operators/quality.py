"""Data-quality checks and gaps-and-islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.blocks import BLOCK, prev_row, row_index
from wattline.functions.calendar import from_seconds, seconds
from wattline.functions.quantile import exact_quantiles


def robust_z(long: DataFrame, feature: str, value: str, baseline: Column, target: Column) -> DataFrame:
    """``0.6745 * (x - median) / MAD`` of target rows against the baseline rows of the same feature.

    Both medians are exact and found without bringing a feature into one task: values are counted once, and the median
    and the spread around it come from the counts. A MAD of zero gives NULL.
    """
    counted = long.where(baseline & F.col(value).isNotNull()).groupBy(feature, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_times"))
    mid = exact_quantiles(counted, [feature], "_value", {"_mid": 0.5}, "_times")
    spread = counted.join(mid, feature).withColumn("_dev", F.abs(F.col("_value") - F.col("_mid")))
    mad = exact_quantiles(spread, [feature], "_dev", {"_mad": 0.5}, "_times")
    stats = mid.join(mad, feature)
    z = F.lit(0.6745) * (F.col(value) - F.col("_mid")) / F.col("_mad")
    return long.where(target).join(stats, feature, "left").withColumn("robust_z", F.when(F.col("_mad") != 0, z)).drop("_mid", "_mad")


def with_jump(long: DataFrame, keys: Sequence[str], pos: str, value: str, width: int = BLOCK) -> DataFrame:
    """Add the previous value in row order and the first difference."""
    out = prev_row(long, keys, pos, F.floor(F.col(pos) / width), [value])
    return out.withColumnRenamed(f"{value}_before", "previous_value").withColumn("delta", F.col(value) - F.col("previous_value"))


def anomaly_union(values: DataFrame, jumps: DataFrame, z_value: float, z_jump: float) -> DataFrame:
    a = values.where(F.abs("robust_z") >= z_value).withColumn("check_name", F.lit("value_vs_baseline"))
    b = jumps.where(F.abs("robust_z") >= z_jump).withColumn("check_name", F.lit("jump_vs_baseline"))
    return a.unionByName(b, allowMissingColumns=True)


def missing_ranges(long: DataFrame, keys: Sequence[str], pos: str, ts: str, value: str, width: int = BLOCK) -> DataFrame:
    """Runs of consecutive missing rows with their bounds."""
    gaps = long.where(F.col(value).isNull())
    numbered = row_index(gaps, keys, [pos], F.floor(F.col(pos) / width), "_n")
    return numbered.groupBy(*keys, (F.col(pos) - F.col("_n")).alias("_run")).agg(
        F.count(F.lit(1)).alias("n_missing"), F.min(pos).alias("row_start"), F.max(pos).alias("row_end"),
        F.min(ts).alias("ts_start"), F.max(ts).alias("ts_end"),
    ).drop("_run")


def missing_times(df: DataFrame, keys: Sequence[str], pos: str, ts: str, filled_ts: str, width: int = BLOCK) -> DataFrame:
    """Runs of consecutive rows without a timestamp; their bounds are those of ``filled_ts`` (see ``infer_grid``)."""
    return missing_ranges(df.withColumn("_known", F.col(ts)).withColumn(ts, F.col(filled_ts)), keys, pos, ts, "_known", width)


def absent_times(df: DataFrame, keys: Sequence[str], ts: str, bucket_s: int = 30 * 86400) -> DataFrame:
    """Runs of grid times between a key's first and last row that no row holds: ``n_missing``, ``ts_start``, ``ts_end``.

    The step is the key's median gap. Runs come from the gaps between neighbouring rows, so the grid itself is never made.
    """
    known = df.where(F.col(ts).isNotNull()).select(*keys, seconds(F.col(ts)).alias("_sec")).distinct()
    gaps = prev_row(known, keys, "_sec", F.floor(F.col("_sec") / bucket_s), ["_sec"])
    gaps = gaps.where(F.col("_sec_before").isNotNull()).withColumn("_gap", F.col("_sec") - F.col("_sec_before"))
    wide = gaps.join(exact_quantiles(gaps, keys, "_gap", {"_step": 0.5}), list(keys)).withColumn("n_missing", (F.ceil(F.col("_gap") / F.col("_step")) - 1).cast("long"))
    start = F.col("_sec_before") + F.col("_step")
    return wide.where("n_missing > 0").select(
        *keys, "n_missing", from_seconds(start).alias("ts_start"), from_seconds(F.col("_sec_before") + F.col("_step") * F.col("n_missing")).alias("ts_end")
    )


def daily_completeness(df: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str]) -> DataFrame:
    """Days that hold fewer values than rows, per column."""
    counts = df.groupBy(*keys, day).agg(*[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in columns])
    return counts.unpivot([*keys, day], list(columns), "feature", "missing").where("missing > 0")
