"""Time-aware joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.blocks import carry, row_index
from wattline.functions.calendar import micros


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], width_s: int = 30 * 86400,
    later_fallback: bool = True,
) -> DataFrame:
    """For each left row the nearest right row at or before its time, else the first later one.

    Both time axes are laid into one table and the right values are carried
    along it: one shuffle on (keys, time block), no range join.
    """
    at = micros(F.col(ts))
    rest = [c for c in left.columns if c not in keys and c != ts]
    a = left.select(*keys, (at * 2 + 1).alias("_pos"), F.struct(ts, *rest).alias("_left"))
    b = right.select(*keys, (at * 2).alias("_pos"), F.struct(*columns).alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = carry(both, keys, "_pos", {"_r": F.col("_right")}, width=width_s * 2_000_000, backward=later_fallback)
    value = F.coalesce("_r_prev", "_r_next") if later_fallback else F.col("_r_prev")
    return seen.where(F.col("_left").isNotNull()).select(*keys, "_left.*", *[value[c].alias(c) for c in columns])


def tidy_weather_names(df: DataFrame) -> DataFrame:
    """Add ``temperature`` / ``humidity`` from the last column whose name hints at them, if absent."""
    for hint, name in (("temp", "temperature"), ("humid", "humidity")):
        if name not in df.columns:
            hits = [c for c in df.columns if hint in c.lower()]
            if hits:
                df = df.withColumn(name, F.col(hits[0]))
    return df


def lookup_history_end(windows: DataFrame, frame: DataFrame, columns: Sequence[str], ts: str = "history_end_ts") -> DataFrame:
    """The frame's row at the window's last history timestamp; without a match the row at the
    same position, held inside the frame."""
    frame = tidy_weather_names(frame)
    numbered = row_index(frame, [], ["ts"], F.to_date("ts"), "_row")
    last = numbered.agg(F.max("_row")).scalar()
    exact = numbered.select(F.col("ts").alias(ts), F.struct(*columns).alias("_hit"))
    at = numbered.select(F.col("_row").alias("_at"), F.struct(*columns).alias("_near"))
    tried = windows.join(exact, ts, "left")
    hits = tried.where(F.col("_hit").isNotNull()).withColumnRenamed("_hit", "_row")
    # only windows without a hit go into the second join; many of them may fall on one row, so the rows are repeated and the windows spread
    misses = tried.where(F.col("_hit").isNull()).drop("_hit").withColumn("_at", F.least(F.greatest(F.col("t_start") - 1, F.lit(0)), last))
    misses = misses.withColumn("_salt", F.pmod(F.xxhash64(*windows.columns), F.lit(8)).cast("int"))
    at = at.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    missed = misses.join(at, ["_at", "_salt"], "left").drop("_at", "_salt").withColumnRenamed("_near", "_row")
    return hits.unionByName(missed).select(*windows.columns, *[F.col("_row")[c].alias(c) for c in columns])


def price_history_end(windows: DataFrame, price: DataFrame, ts: str = "history_end_ts") -> DataFrame:
    """Price of the window's own node at its history end, else the mean over all nodes then."""
    own = price.select(F.col("ts").alias(ts), "node_idx", "price")
    mean = price.groupBy(F.col("ts").alias(ts)).agg(F.avg("price").alias("_mean"))
    out = windows.join(own, [ts, "node_idx"], "left").join(mean, ts, "left")
    return out.withColumn("price", F.coalesce("price", "_mean")).select(*windows.columns, "price")


def merge_feeds(feeds: DataFrame, ts: str, mean_of: Sequence[str], max_of: Sequence[str]) -> DataFrame:
    """Full outer merge of stacked feeds by time: row-wise mean (or maximum) without NULLs.

    Stacking and grouping needs one shuffle where an outer join per feed needs one each.
    """
    return feeds.groupBy(ts).agg(*[F.avg(c).alias(c) for c in mean_of], *[F.max(c).alias(c) for c in max_of])


def outer_add(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """a + b per key, a missing side counting as 0; NULL only if both are NULL."""
    return a.select(*keys, value).unionByName(b.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def attach_candidate(starts: DataFrame, candidate: DataFrame, horizon: int, keys: Sequence[str] = ("series",)) -> DataFrame:
    """The candidate curve of ``horizon`` steps from (day, slot), wrapping at midnight; only complete curves."""
    steps = starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    raw = F.col("slot") + F.col("step")
    steps = steps.select(
        *starts.columns, "step", F.when(raw >= 96, F.date_add("day", 1)).otherwise(F.col("day")).alias("_day"), (raw % 96).alias("_slot")
    )
    lookup = candidate.select(*keys, F.col("day").alias("_day"), F.col("slot").alias("_slot"), "prediction")
    got = steps.join(lookup, [*keys, "_day", "_slot"])
    whole = got.groupBy(*starts.columns).agg(F.sort_array(F.collect_list(F.struct("step", "prediction"))).alias("_c"))
    return whole.where(F.size("_c") == horizon).select(*starts.columns, F.col("_c.prediction").alias("candidate_future"))


def candidate_map(truth: DataFrame, overrides: DataFrame, lo: float, hi: float) -> DataFrame:
    """Yesterday's truth by calendar day, replaced by a forecast where there is one, normalised."""
    base = truth.select("series", F.date_add("day", 1).alias("day"), "slot", F.col("price").alias("_base"))
    last = overrides.groupBy("series", "day", "slot").agg(F.max_by("prediction", "arrival").alias("_over"))
    return base.join(last, ["series", "day", "slot"], "left").select(
        "series", "day", "slot", ((F.coalesce("_over", "_base") - F.lit(lo)) / F.lit(hi - lo)).alias("prediction")
    )


def pair_predictions(base: DataFrame, other: DataFrame, keys: Sequence[str] = ("series", "day", "slot")) -> DataFrame:
    """Two prediction tables side by side, copies averaged; differing targets are an error when the plan runs."""
    def mean(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.avg("prediction").alias(f"prediction_{tag}"), F.avg("target").alias(f"target_{tag}"))

    merged = mean(base, "base").join(mean(other, "seq"), list(keys))
    near = F.abs(F.col("target_base") - F.col("target_seq")) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("target_seq")
    target = F.when(near, F.col("target_base")).otherwise(F.raise_error(F.lit("targets do not align")).cast("double"))
    return merged.select(*keys, "prediction_base", "prediction_seq", target.alias("target"))


def pair_variants(records: DataFrame, first: str, second: str) -> DataFrame:
    """Two variants' parsed records joined on (window, node), with errors, gap and advantage."""
    from wattline.functions.arrays import mean_abs_diff

    ok = records.where("parse_ok")
    a = ok.where(F.col("variant") == first).select("t_start", "node_idx", "domain", "target", F.col("pred").alias("full_pred"))
    b = ok.where(F.col("variant") == second).select("t_start", "node_idx", F.col("pred").alias("wo_pred"))
    target = F.col("target")
    # Both sides hold a row per record; a guess from packed files must not send one of them through the driver.
    out = a.join(b.hint("merge"), ["t_start", "node_idx"]).select(
        "*", mean_abs_diff(F.col("full_pred"), F.col("wo_pred")).alias("variant_gap_mae"),
        mean_abs_diff(F.col("full_pred"), target).alias("full_mae"), mean_abs_diff(F.col("wo_pred"), target).alias("wo_mae"),
    )
    return out.withColumn("full_advantage", F.col("wo_mae") - F.col("full_mae"))


