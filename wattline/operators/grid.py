"""Time axes: inferring, completing and resampling them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.blocks import prev_row
from wattline.functions.calendar import from_seconds, seconds
from wattline.functions.quantile import exact_quantiles


def infer_grid(df: DataFrame, keys: Sequence[str], pos: str, ts: str, accept: float = 0.999) -> DataFrame:
    """Fill missing timestamps of a regular grid.

    The step is the median gap between known timestamps, the start is projected
    back from the first known row. Where at least ``accept`` of the known rows
    sit on that grid, missing ones are filled; else the raw axis is kept. Adds
    ``step_s``, ``match`` and ``filled_ts``.
    """
    known = df.where(F.col(ts).isNotNull()).select(*keys, pos, seconds(F.col(ts)).alias("_sec"))
    gaps = prev_row(known.drop(pos), keys, "_sec", F.floor(F.col("_sec") / 2592000), ["_sec"])
    gaps = gaps.where(F.col("_sec_before").isNotNull()).withColumn("gap", F.col("_sec") - F.col("_sec_before"))
    step = exact_quantiles(gaps, keys, "gap", {"step_s": 0.5})
    first = known.groupBy(*keys).agg(F.min(F.struct(pos, "_sec")).alias("_f"))
    frame = first.join(step, list(keys), "left").select(
        *keys, "step_s", (F.col("_f._sec") - F.col("step_s") * F.col(f"_f.{pos}")).alias("_start")
    )
    placed = known.join(frame, list(keys)).withColumn(
        "_on", (F.col("_sec") == F.col("_start") + F.col("step_s") * F.col(pos)).cast("double")
    )
    match = placed.groupBy(*keys).agg(F.avg("_on").alias("match"))
    plan = frame.join(match, list(keys), "left")
    expected = from_seconds(F.col("_start") + F.col("step_s") * F.col(pos))
    return (
        df.join(plan, list(keys), "left")
        .withColumn("filled_ts", F.when((F.col("match") >= accept) & (F.col("step_s") > 0), F.coalesce(F.col(ts), expected)).otherwise(F.col(ts)))
        .drop("_start")
    )


def infer_step_mode(df: DataFrame, keys: Sequence[str], ts: str, bucket_s: int = 30 * 86400, default_s: int = 900) -> DataFrame:
    """The most common gap in seconds (ties: the shortest), one row."""
    sec = df.select(*keys, seconds(F.col(ts).cast("timestamp_ntz")).alias("_sec"))
    gaps = prev_row(sec, keys, "_sec", F.floor(F.col("_sec") / bucket_s), ["_sec"]).select(
        (F.col("_sec") - F.col("_sec_before")).alias("gap")
    )
    counted = gaps.where("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    best = counted.agg(
        F.max_by("gap", F.struct("n", -F.col("gap"))).alias("step_s"), F.max("n").alias("n")
    )
    return best.select(F.coalesce("step_s", F.lit(default_s)).alias("step_s"), F.coalesce("n", F.lit(0)).alias("n"))


def time_axis(keys: DataFrame, ts: str, lo: Column, hi: Column, step: str, together: int = 96) -> DataFrame:
    """Every row of ``keys`` with each time ``lo``, ``lo + step``, … up to ``hi``.

    Made in two levels, starts of ``together`` steps and then the steps themselves, so no array is as long as the axis. ``step``
    is an interval of days or less.
    """
    if any(unit in step.lower() for unit in ("month", "year")):
        raise ValueError(f"a step of {step!r} has no fixed length")
    epoch, length = "timestamp_ntz'1970-01-01 00:00:00'", F.expr(f"interval {step}")
    step_us = F.expr(f"timestampdiff(MICROSECOND, {epoch}, {epoch} + interval {step})")
    last = F.floor(F.timestamp_diff("MICROSECOND", lo, hi) / step_us).cast("long")
    starts = keys.withColumn("_last", last).where("_last >= 0").withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_last"), F.lit(0)), F.lit(together).cast("long"))))
    steps = starts.withColumn("_i", F.explode(F.sequence(F.col("_start"), F.least(F.col("_start") + together - 1, F.col("_last")))))
    return steps.withColumn(ts, lo + length * F.col("_i")).drop("_last", "_start", "_i")


def reindex_grid(df: DataFrame, key: str, ts: str, step: str, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Complete every key onto one regular grid from the first to the last timestamp (or given bounds)."""
    if lo is None or hi is None:
        b = df.agg(F.struct(F.min(ts).alias("lo"), F.max(ts).alias("hi")).alias("b")).scalar()
        lo, hi = b["lo"], b["hi"]
    return time_axis(df.select(key).distinct(), ts, lo, hi, step).join(df, [key, ts], "left")


def resample_mean(df: DataFrame, keys: Sequence[str], ts: str, value: str, width: str = "15 minutes") -> DataFrame:
    return df.groupBy(*keys, F.window(ts, width).alias("_w")).agg(F.avg(value).alias(value)).select(
        *keys, F.col("_w.start").alias(ts), value
    )


def coverage_filter(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """Keys that hold at least ``int(ratio * longest)`` rows, with their counts."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    longest = counts.agg(F.max("rows")).scalar()
    need = F.greatest(F.lit(1), F.floor(longest * F.lit(ratio)))
    return counts.where(F.col("rows") >= need)


def common_overlap(df: DataFrame, key: str, ts: str, value: str, min_rows: int = 100) -> DataFrame:
    """Rows inside the span that every key covers, with the key's coverage of it.

    Coverage counts a key's non-null rows (over its whole span, as given) per
    day of the common span. A span shorter than ``min_rows`` days is an error
    when the plan runs.
    """
    spans = df.groupBy(key).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count(value).alias("known"))
    common = spans.agg(F.struct(F.max("lo").alias("lo"), F.min("hi").alias("hi")).alias("b")).scalar()
    length = F.datediff(common["hi"], common["lo"]) + 1
    checked = F.when(length < min_rows, F.raise_error(F.lit("common span too short")).cast("int")).otherwise(length)
    cover = spans.select(key, (F.col("known") / F.greatest(checked, F.lit(1))).alias("coverage"))
    return df.where(F.col(ts).between(common["lo"], common["hi"])).join(cover, key)


def dense_time_index(df: DataFrame, ts: str, out: str = "t_idx") -> DataFrame:
    """Dense position of each distinct timestamp, joined back to the rows."""
    from wattline.functions.blocks import row_index

    axis = row_index(df.select(ts).distinct(), [], [ts], F.to_date(ts), out)
    return df.join(axis, ts)


