"""Forecast metrics: pooled per step, per record, per day, and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.arrays import argmax0, mean_abs_diff, rmse_of
from wattline.functions.quantile import exact_quantiles
from wattline.sources.sinks import written

FLAT_RANGE = 1e-9


def per_step(records: DataFrame, vmin: Column, vmax: Column, keep: Sequence[str]) -> DataFrame:
    """Parsed records as rows ``(…, h, err)`` with the error on the raw scale."""
    zipped = F.arrays_zip(F.col("pred").alias("pred"), F.col("target").alias("target"))
    rows = records.where("parse_ok").select(*keep, F.posexplode(zipped).alias("_h", "_x"))
    scale = vmax - vmin
    return rows.select(*keep, (F.col("_h") + 1).alias("h"), ((F.col("_x.pred") - F.col("_x.target")) * scale).alias("err"))


def grouping_sets(df: DataFrame, by: Sequence[str], cube: Sequence[str]):
    """Group by ``by`` plus every combination of ``cube`` (an absent column is NULL)."""
    subsets = [list(c) for n in range(len(cube) + 1) for c in combinations(cube, n)]
    return df.groupingSets([[*by, *s] for s in subsets], *by, *cube)


def pooled(steps: DataFrame, by: Sequence[str], cube: Sequence[str]) -> DataFrame:
    """RMSE and MAE of pooled errors over every combination of ``cube`` columns within ``by``.

    The errors are added up once per finest group; the combinations read those sums.
    """
    err = F.col("err")
    sums = steps.groupBy(*by, *cube).agg(F.sum(err * err).alias("_sq"), F.sum(F.abs(err)).alias("_abs"), F.count(err).alias("_n"))
    return grouping_sets(sums, by, cube).agg(
        F.sqrt(F.try_divide(F.sum("_sq"), F.sum("_n"))).alias("rmse"), F.try_divide(F.sum("_abs"), F.sum("_n")).alias("mae")
    )


def direction_accuracy(pred: Column, true: Column, last: Column) -> Column:
    """Share of steps whose change has the same sign; both paths start at the last history value."""
    def steps(a: Column) -> Column:
        path = F.concat(F.array(last), F.slice(a, 1, F.size(a) - 1))
        return F.zip_with(a, path, lambda x, y: F.signum(x - y))

    same = F.zip_with(steps(pred), steps(true), lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    return F.aggregate(same, F.lit(0.0), lambda acc, x: acc + x) / F.size(true)


def forecast_records(records: DataFrame, vmin: Column, vmax: Column, digits: int = 4) -> DataFrame:
    """One row per record with raw-scale, rounded series and its metrics; NULL where not parsed."""
    def raw(c: str) -> Column:
        return F.transform(F.col(c), lambda x: x * (F.col("_hi") - F.col("_lo")) + F.col("_lo"))

    base = records.withColumn("_lo", vmin).withColumn("_hi", vmax)
    base = base.select("*", raw("x_hist").alias("_x"), raw("target").alias("_y"), raw("pred").alias("_p"))
    x, y, p = F.col("_x"), F.col("_y"), F.col("_p")
    ok = lambda c: F.when(F.col("parse_ok"), c)
    rounded = lambda a: F.transform(a, lambda v: F.bround(v, digits))
    return base.select(
        *records.columns, rounded(x).alias("history_raw"), rounded(y).alias("target_raw"), ok(rounded(p)).alias("prediction_raw"),
        ok(mean_abs_diff(p, y)).alias("mae"), ok(rmse_of(p, y)).alias("rmse"),
        ok(direction_accuracy(p, y, F.element_at(x, -1))).alias("direction_accuracy"),
        ok(argmax0(p) - argmax0(y)).alias("peak_time_error_steps"),
        ok(F.abs(F.array_max(p) - F.array_max(y))).alias("peak_abs_error"),
        ok(F.array_max(p) - F.array_min(p)).alias("prediction_range"), (F.array_max(y) - F.array_min(y)).alias("target_range"),
    )


def record_rollup(scored: DataFrame, by: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Means of per-record metrics: overall, and by each column of ``levels`` (one pass).

    The roots are averaged per record, unlike ``pooled``.
    """
    tagged = scored.withColumn(
        "_lvl", F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("member")),
                                  *[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("member")) for c in levels]))
    )
    n = F.count(F.lit(1))
    parsed = F.sum(F.col("parse_ok").cast("long"))
    return tagged.groupBy(*by, F.col("_lvl.level").alias("level"), F.col("_lvl.member").alias("member")).agg(
        n.alias("records"), parsed.alias("parsed"), (parsed / F.greatest(n, F.lit(1))).alias("parse_rate"),
        *[F.avg(c).alias(c) for c in ("mae", "rmse", "direction_accuracy", "peak_abs_error")],
        F.avg(F.abs("peak_time_error_steps")).alias("peak_time_abs_error"),
    )


def sequence_diagnostics(scored: DataFrame, by: Sequence[str], split_by: str) -> DataFrame:
    """Constant-forecast counts and mean ranges, overall and per ``split_by``."""
    ok = scored.where("parse_ok")
    flat_p, flat_t = F.col("prediction_range") <= FLAT_RANGE, F.col("target_range") <= FLAT_RANGE
    return grouping_sets(ok, by, [split_by]).agg(
        F.sum(flat_p.cast("long")).alias("constant_prediction_count"), F.avg(flat_p.cast("double")).alias("constant_prediction_rate"),
        F.sum(flat_t.cast("long")).alias("target_constant_count"), F.avg(flat_t.cast("double")).alias("target_constant_rate"),
        F.avg("prediction_range").alias("mean_prediction_range"), F.avg("target_range").alias("mean_target_range"),
    )


def flat_ratio_quantiles(scored: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Share of constant forecasts, extremes and quartiles of a metric; the scores are computed once and read twice."""
    ok = written(scored.where("parse_ok").select(*by, metric, *({"prediction_range"} - {metric, *by})), "scores")
    flat = ok.groupBy(*by).agg(
        F.avg((F.col("prediction_range") < 1e-6).cast("double")).alias("flat_ratio"),
        F.min(metric).alias("min"), F.max(metric).alias("max"),
    )
    q = exact_quantiles(ok, by, metric, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return flat.join(q, list(by))


def day_metrics(
    df: DataFrame, pred: str = "prediction", target: str = "target", floor: float = 40.0, cap: float = 1000.0,
    keys: Sequence[str] = ("series", "day"), slots: int | None = 96,
) -> DataFrame:
    """Per-day errors and accuracies. Relative errors divide by ``max(|true|, floor)``.

    With ``slots`` set, a day with another number of rows is an error when the plan runs.
    """
    p, t = F.col(pred), F.col(target)
    err = p - t
    first_max = lambda c: F.max_by("slot", F.struct(c, -F.col("slot")))
    day = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err) / F.greatest(F.abs(t), F.lit(floor))).alias("relative_mape"),
        F.avg(p).alias("pred_mean"), F.avg(t).alias("true_mean"), F.max(p).alias("pred_max"), F.max(t).alias("true_max"),
        (first_max(p) == first_max(t)).cast("int").alias("peak_slot_hit"),
    )
    mae = F.col("mae")
    if slots is not None:
        wrong = F.raise_error(F.concat(F.lit("rows in a day: "), F.col("_n").cast("string"))).cast("double")
        mae = F.when(F.col("_n") == slots, mae).otherwise(wrong)
    zero = F.lit(0.0)
    return day.select(
        *keys, mae.alias("mae"), "rmse", "relative_mape", F.greatest(zero, 1 - F.col("relative_mape")).alias("relative_accuracy"),
        F.greatest(zero, 1 - F.col("mae") / F.lit(max(cap - floor, 1e-6))).alias("range_accuracy"),
        F.greatest(zero, 1 - F.abs(F.col("pred_mean") - F.col("true_mean")) / F.greatest(F.abs("true_mean"), F.lit(floor))).alias("daily_mean_accuracy"),
        "peak_slot_hit", "pred_mean", "true_mean", "pred_max", "true_max",
    )


def day_summary(days: DataFrame, by: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Means, medians and shares over days, with the threshold audit of the daily-mean accuracy."""
    aggs = [F.count(F.lit(1)).alias("days"), F.avg("mae").alias("mean_day_mae"), F.avg("rmse").alias("mean_day_rmse")]
    for c in ("relative_accuracy", "range_accuracy", "daily_mean_accuracy"):
        aggs += [F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}"), F.avg((F.col(c) >= threshold).cast("double")).alias(f"share_{c}")]
    out = days.groupBy(*by).agg(*aggs, F.avg("peak_slot_hit").alias("peak_slot_hit_rate"))
    return out.withColumn("passed", (F.col("mean_daily_mean_accuracy") >= threshold).cast("int"))


def parse_rate(records: DataFrame, by: Sequence[str], split_by: str) -> DataFrame:
    ok = F.sum(F.col("parse_ok").cast("long"))
    n = F.count(F.lit(1))
    return grouping_sets(records, by, [split_by]).agg(
        n.alias("requested"), ok.alias("parsed"), (ok / F.greatest(n, F.lit(1))).alias("parse_rate")
    )


def variant_summary(steps: DataFrame, horizon: int) -> DataFrame:
    """One row per variant with a column per step and metric (fixed list, one pass)."""
    sq = F.col("err") * F.col("err")
    aggs = [F.sqrt(F.avg(sq)).alias("overall_rmse"), F.avg(F.abs("err")).alias("overall_mae")]
    for d in ("CBD", "Residential"):
        aggs.append(F.avg(F.when(F.col("domain") == d, F.abs("err"))).alias(f"{d.lower()}_mae"))
    for h in range(1, horizon + 1):
        at = F.col("h") == h
        aggs += [F.sqrt(F.avg(F.when(at, sq))).alias(f"h{h}_rmse"), F.avg(F.when(at, F.abs("err"))).alias(f"h{h}_mae")]
    return steps.groupBy("variant").agg(*aggs)


def run_delta(metrics: DataFrame, base: str, new: str) -> DataFrame:
    """``metrics(track, run, variant, metric, value)`` to new - base per run and its mean and deviation across runs."""
    wide = metrics.groupBy("run", "variant", "metric").agg(
        F.max(F.when(F.col("track") == base, F.col("value"))).alias("base"),
        F.max(F.when(F.col("track") == new, F.col("value"))).alias("new"),
    ).withColumn("delta", F.col("new") - F.col("base"))
    return wide.groupBy("variant", "metric").agg(
        F.count("delta").alias("runs"),
        *[x for c in ("base", "new", "delta") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))],
    )


def progress_best(runs: DataFrame, order: str) -> DataFrame:
    """The first run with the lowest error and the first with the highest accuracy (NaN left out)."""
    acc = F.when(~F.isnan("accuracy"), F.col("accuracy"))
    return runs.agg(
        F.min_by("run", F.struct("mae", order)).alias("best_by_mae"),
        F.max_by("run", F.when(acc.isNotNull(), F.struct(acc, -F.col(order)))).alias("best_by_accuracy"),
    )


def describe_pct(long: DataFrame, feature: str, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles per feature."""
    base = long.groupBy(feature).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    q = exact_quantiles(long, [feature], value, {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})
    return base.join(q, feature)


def zone_aggregate(stations: DataFrame, zone: str, means: Sequence[str], sums: Sequence[str], zones: DataFrame) -> DataFrame:
    agg = stations.groupBy(zone).agg(
        *[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("station_count")
    )
    return zones.join(agg, zone, "left")


def ratio_rows(scored: DataFrame, pos: Column, windows: Column, ratios: Sequence[float], by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean scores per share of the data: for every ratio the items of the first ``windows * ratio`` windows, one at least.

    ``pos`` is an item's window, from 0. All ratios come from one pass.
    """
    each = scored.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    kept = each.where(pos < F.greatest(F.lit(1), F.floor(windows * F.col("ratio"))))
    return kept.groupBy(*by, "ratio").agg(F.count(F.lit(1)).alias("items"), *[F.avg(c).alias(c) for c in columns])
