"""Queries: metrics, diagnostics, run tables and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.arrays import clip
from wattline.operators import grid, metrics, quality
from wattline.plans.fixtures_sql import day_metrics_sql
from wattline.plans.registry import query
from wattline.sources.fixtures import MARKET_COLUMNS, PRICE_CAP, PRICE_FLOOR


@query(
    "zone_aggregate",
    "zone:s s_acctbal:f suppkeys:i station_count:i",
    """
SELECT n_name AS zone, avg(s_acctbal) AS s_acctbal, sum(s_suppkey) AS suppkeys, count(*) AS station_count FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name
UNION ALL SELECT n_name, NULL, 0, 0 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'beyond ' || n_name, NULL, 0, 0 FROM nation""",
)
def _(fx):
    zones = fx.table("nation").select("n_nationkey", F.col("n_name").alias("zone"))
    s = fx.table("supplier").join(zones, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("suppkeys", F.col("s_suppkey"))
    # every second zone has no station
    listed = zones.select(F.explode(F.array("zone", F.concat(F.lit("beyond "), "zone"))).alias("zone"))
    out = metrics.zone_aggregate(s, "zone", ["s_acctbal"], ["suppkeys"], listed)
    return out.fillna(0, ["suppkeys", "station_count"])


@query(
    "horizon_metrics",
    "variant:s h:i rmse:f mae:f",
    "SELECT variant, coalesce(h, 0) AS h, sqrt(avg(err * err)) AS rmse, avg(abs(err)) AS mae FROM step_errors GROUP BY GROUPING SETS ((variant, h), (variant))",
)
def _(fx):
    return metrics.pooled(fx.steps, ["variant"], ["h"]).fillna(0, ["h"])


@query(
    "domain_metrics",
    "variant:s domain:s h:i rmse:f mae:f",
    """SELECT variant, coalesce(domain, 'all') AS domain, coalesce(h, 0) AS h, sqrt(avg(err * err)) AS rmse, avg(abs(err)) AS mae
FROM step_errors GROUP BY GROUPING SETS ((variant, domain, h), (variant, domain), (variant, h), (variant))""",
)
def _(fx):
    return metrics.pooled(fx.steps, ["variant"], ["domain", "h"]).fillna(0, ["h"]).fillna("all", ["domain"])


_ROLL = "count(*) AS records, sum(CAST(parse_ok AS INT)) AS parsed, avg(CAST(parse_ok AS DOUBLE)) AS parse_rate, avg(mae) AS mae, avg(rmse) AS rmse, avg(direction_accuracy) AS direction_accuracy, avg(peak_abs_error) AS peak_abs_error, avg(abs(peak_time_error_steps)) AS peak_time_abs_error"


@query(
    "record_metrics_rollup",
    "variant:s level:s member:s records:i parsed:i parse_rate:f mae:f rmse:f direction_accuracy:f peak_abs_error:f peak_time_abs_error:f",
    f"""
SELECT variant, 'all' AS level, 'all' AS member, {_ROLL} FROM scored GROUP BY variant
UNION ALL SELECT variant, 'domain', domain, {_ROLL} FROM scored GROUP BY variant, domain
UNION ALL SELECT variant, 'node_id', node_id, {_ROLL} FROM scored GROUP BY variant, node_id""",
)
def _(fx):
    return metrics.record_rollup(fx.scored, ["variant"], ["domain", "node_id"])


@query(
    "forecast_records",
    "variant:s t_start:i node_idx:i parse_ok:i mae:f rmse:f target_1:f4 pred_6:f4",
    """
SELECT variant, t_start, node_idx, CAST(parse_ok AS INT) AS parse_ok, mae, rmse, round_even(target[1] * (vmax - vmin) + vmin, 4) AS target_1,
       round_even(pred[6] * (vmax - vmin) + vmin, 4) AS pred_6 FROM scored CROSS JOIN norm_bounds""",
)
def _(fx):
    return fx.scored.withColumn("target_1", F.col("target_raw")[0]).withColumn("pred_6", F.col("prediction_raw")[5])


@query("direction_accuracy", "variant:s t_start:i node_idx:i direction_accuracy:f",
       "SELECT variant, t_start, node_idx, direction_accuracy FROM scored WHERE parse_ok")
def _(fx):
    return fx.scored.where("parse_ok")


@query("peak_time_error", "variant:s t_start:i node_idx:i peak_time_error_steps:i peak_abs_error:f",
       "SELECT variant, t_start, node_idx, peak_time_error_steps, peak_abs_error FROM scored WHERE parse_ok")
def _(fx):
    return fx.scored.where("parse_ok")


@query(
    "sequence_diagnostics",
    "variant:s domain:s constant_prediction_count:i constant_prediction_rate:f target_constant_count:i target_constant_rate:f mean_prediction_range:f mean_target_range:f",
    """
SELECT variant, coalesce(domain, 'all') AS domain, sum(CAST(prediction_range <= 1e-9 AS INT)) AS constant_prediction_count, avg(CAST(prediction_range <= 1e-9 AS DOUBLE)) AS constant_prediction_rate,
       sum(CAST(target_range <= 1e-9 AS INT)) AS target_constant_count, avg(CAST(target_range <= 1e-9 AS DOUBLE)) AS target_constant_rate, avg(prediction_range) AS mean_prediction_range, avg(target_range) AS mean_target_range
FROM scored WHERE parse_ok GROUP BY GROUPING SETS ((variant, domain), (variant))""",
)
def _(fx):
    return metrics.sequence_diagnostics(fx.scored, ["variant"], "domain").fillna("all", ["domain"])


@query(
    "flat_ratio_quantiles",
    "variant:s flat_ratio:f min:f p25:f median:f p75:f max:f",
    """
SELECT variant, avg(CAST(prediction_range < 1e-6 AS DOUBLE)) AS flat_ratio, min(mae) AS min, quantile_cont(mae, 0.25) AS p25, quantile_cont(mae, 0.5) AS median, quantile_cont(mae, 0.75) AS p75, max(mae) AS max
FROM scored WHERE parse_ok GROUP BY variant""",
)
def _(fx):
    return metrics.flat_ratio_quantiles(fx.scored, ["variant"], "mae")


_DAY = "series:s day:d mae:f rmse:f relative_mape:f relative_accuracy:f range_accuracy:f daily_mean_accuracy:f peak_slot_hit:i pred_mean:f true_mean:f pred_max:f true_max:f"


@query("day_metrics", _DAY, "SELECT * FROM days_a")
def _(fx):
    return metrics.day_metrics(fx.pred_a, floor=PRICE_FLOOR, cap=PRICE_CAP)


_SUMM = ["relative_accuracy", "range_accuracy", "daily_mean_accuracy"]


@query(
    "day_metrics_summary",
    "series:s days:i mean_day_mae:f mean_day_rmse:f " + " ".join(f"mean_{c}:f median_{c}:f share_{c}:f" for c in _SUMM) + " peak_slot_hit_rate:f passed:i",
    f"""
SELECT series, count(*) AS days, avg(mae) AS mean_day_mae, avg(rmse) AS mean_day_rmse,
       {", ".join(f"avg({c}) AS mean_{c}, median({c}) AS median_{c}, avg(CAST({c} >= 0.8 AS DOUBLE)) AS share_{c}" for c in _SUMM)},
       avg(peak_slot_hit) AS peak_slot_hit_rate, CAST(avg(daily_mean_accuracy) >= 0.8 AS INT) AS passed FROM days_a GROUP BY series""",
)
def _(fx):
    return metrics.day_summary(metrics.day_metrics(fx.pred_a, floor=PRICE_FLOOR, cap=PRICE_CAP), ["series"])


@query(
    "oracle_day_shift",
    _DAY,
    "WITH shifted AS (SELECT series, day, slot, target, least(greatest(prediction + avg(target) OVER d - avg(prediction) OVER d, 5.0), 200.0) AS p FROM pred_a WINDOW d AS (PARTITION BY series, day))"
    + day_metrics_sql("shifted", "p", PRICE_FLOOR, PRICE_CAP),
)
def _(fx):
    shift = fx.pred_a.groupBy("series", "day").agg((F.avg("target") - F.avg("prediction")).alias("shift"))
    moved = fx.pred_a.join(shift, ["series", "day"]).withColumn("prediction", clip(F.col("prediction") + F.col("shift"), PRICE_FLOOR, PRICE_CAP))
    return metrics.day_metrics(moved, floor=PRICE_FLOOR, cap=PRICE_CAP)


@query(
    "parse_rate",
    "variant:s domain:s requested:i parsed:i parse_rate:f",
    """SELECT variant, coalesce(domain, 'all') AS domain, count(*) AS requested, sum(CAST(parse_ok AS INT)) AS parsed, avg(CAST(parse_ok AS DOUBLE)) AS parse_rate
FROM records GROUP BY GROUPING SETS ((variant, domain), (variant))""",
)
def _(fx):
    return metrics.parse_rate(fx.records, ["variant"], "domain").fillna("all", ["domain"])


_HS = range(1, 7)


@query(
    "variant_summary",
    "variant:s overall_rmse:f overall_mae:f cbd_mae:f residential_mae:f " + " ".join(f"h{h}_rmse:f h{h}_mae:f" for h in _HS),
    f"""
SELECT variant, sqrt(avg(err * err)) AS overall_rmse, avg(abs(err)) AS overall_mae, avg(abs(err)) FILTER (domain = 'CBD') AS cbd_mae, avg(abs(err)) FILTER (domain = 'Residential') AS residential_mae,
       {", ".join(f"sqrt(avg(err * err) FILTER (h = {h})) AS h{h}_rmse, avg(abs(err)) FILTER (h = {h}) AS h{h}_mae" for h in _HS)} FROM step_errors GROUP BY variant""",
)
def _(fx):
    return metrics.variant_summary(fx.steps, 6)


@query(
    "run_delta",
    "variant:s metric:s runs:i base_mean:f base_std:f new_mean:f new_std:f delta_mean:f delta_std:f",
    """
WITH m AS (SELECT variant AS track, t_start // 28 AS run, domain AS variant, unnest(['mae', 'rmse']) AS metric, unnest([avg(mae), avg(rmse)]) AS value FROM scored WHERE parse_ok GROUP BY variant, t_start // 28, domain),
w AS (SELECT run, variant, metric, max(value) FILTER (track = 'mean') AS base, max(value) FILTER (track = 'seasonal') AS new FROM m GROUP BY ALL)
SELECT variant, metric, count(new - base) AS runs, avg(base) AS base_mean, stddev_pop(base) AS base_std, avg(new) AS new_mean, stddev_pop(new) AS new_std,
       avg(new - base) AS delta_mean, stddev_pop(new - base) AS delta_std FROM w GROUP BY ALL""",
)
def _(fx):
    m = fx.scored.where("parse_ok").groupBy(F.col("variant").alias("track"), F.floor(F.col("t_start") / 28).alias("run"), F.col("domain").alias("variant")).agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")
    )
    return metrics.run_delta(m.unpivot(["track", "run", "variant"], ["mae", "rmse"], "metric", "value"), "mean", "seasonal")


@query(
    "ratio_rows",
    "variant:s ratio:f items:i mae:f",
    """
SELECT variant, ratio, count(*) AS items, avg(mae) AS mae FROM scored CROSS JOIN (SELECT unnest([0.1, 0.3, 0.6]) AS ratio) CROSS JOIN (SELECT count(DISTINCT t_start) AS nw FROM scored)
WHERE parse_ok AND t_start - 12 < greatest(1, floor(nw * CAST(ratio AS DOUBLE))) GROUP BY ALL""",
)
def _(fx):
    return metrics.ratio_rows(fx.scored.where("parse_ok"), F.col("t_start") - 12, (fx.n_steps - 17).cast("long"), [0.1, 0.3, 0.6], ["variant"], ["mae"])


@query(
    "progress_best",
    "best_by_mae:s best_by_accuracy:s",
    """
WITH r AS (SELECT series AS run, row_number() OVER (ORDER BY series) AS o, avg(mae) AS mae, CASE WHEN avg(peak_slot_hit) = 0 THEN 'nan'::DOUBLE ELSE avg(daily_mean_accuracy) END AS accuracy FROM days_a GROUP BY series)
SELECT (SELECT run FROM r ORDER BY mae, o LIMIT 1) AS best_by_mae, (SELECT run FROM r WHERE NOT isnan(accuracy) ORDER BY accuracy DESC, o LIMIT 1) AS best_by_accuracy""",
)
def _(fx):
    s = metrics.day_summary(metrics.day_metrics(fx.pred_a, floor=PRICE_FLOOR, cap=PRICE_CAP), ["series"])
    acc = F.when(F.col("peak_slot_hit_rate") == 0, F.lit(float("nan"))).otherwise(F.col("mean_daily_mean_accuracy"))
    names = s.select(F.sort_array(F.collect_set("series")).alias("n")).scalar()
    runs = s.select(F.col("series").alias("run"), F.array_position(names, F.col("series")).alias("o"), F.col("mean_day_mae").alias("mae"), acc.alias("accuracy"))
    return metrics.progress_best(runs, "o")


@query(
    "describe_pct",
    "feature:s n:i mean:f std:f min:f p01:f p05:f p50:f p95:f p99:f max:f",
    """
SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max FROM market_long GROUP BY feature""",
)
def _(fx):
    return metrics.describe_pct(fx.market_long, "feature", "value")


# --- data quality ---
_CUT = "2024-01-21"
_NO_TIME = "pos % 50 BETWEEN 3 AND 5"
_STATS = "SELECT feature, median(value) AS mid FROM {src} WHERE day < DATE '%s' AND value IS NOT NULL GROUP BY feature" % _CUT


def _z(src: str) -> str:
    return f"""SELECT t.*, CASE WHEN mad <> 0 THEN 0.6745 * (t.value - mid) / mad END AS robust_z FROM {src} t
LEFT JOIN (SELECT b.feature, any_value(mid) AS mid, median(abs(b.value - mid)) AS mad FROM {src} b JOIN ({_STATS.format(src=src)}) s USING (feature)
  WHERE b.day < DATE '{_CUT}' AND b.value IS NOT NULL GROUP BY b.feature) q USING (feature) WHERE t.day >= DATE '{_CUT}'"""


_JUMPS = "jumps AS MATERIALIZED (SELECT series, pos, day, ts, feature, value AS level, lag(value) OVER w AS previous_value, value - lag(value) OVER w AS value FROM market_long WINDOW w AS (PARTITION BY series, feature ORDER BY pos))"


def _value_z(fx):
    base = F.col("day") < F.lit(_CUT).cast("date")
    return quality.robust_z(fx.market_long, "feature", "value", base, ~base)


def _jump_z(fx):
    base = F.col("day") < F.lit(_CUT).cast("date")
    j = quality.with_jump(fx.market_long, ["series", "feature"], "pos", "value")
    return quality.robust_z(j, "feature", "delta", base, ~base)


@query("robust_z", "series:s pos:i feature:s value:f robust_z:f flag:i",
       f"SELECT *, CAST(abs(coalesce(robust_z, 0)) >= 8 AS INT) AS flag FROM ({_z('market_long')})")
def _(fx):
    return _value_z(fx).withColumn("flag", (F.abs(F.coalesce("robust_z", F.lit(0.0))) >= 8).cast("int"))


@query("robust_jump", "series:s pos:i feature:s value:f previous_value:f delta:f robust_z:f",
       f"WITH {_JUMPS} SELECT series, pos, feature, level AS value, previous_value, value AS delta, robust_z FROM ({_z('jumps')})")
def _(fx):
    return _jump_z(fx)


@query(
    "anomaly_union",
    "check_name:s feature:s series:s pos:i value:f previous_value:f delta:f robust_z:f",
    f"""WITH {_JUMPS} SELECT 'value_vs_baseline' AS check_name, feature, series, pos, value, NULL AS previous_value, NULL AS delta, robust_z FROM ({_z('market_long')}) WHERE abs(robust_z) >= 3
UNION ALL SELECT 'jump_vs_baseline', feature, series, pos, level, previous_value, value, robust_z FROM ({_z('jumps')}) WHERE abs(robust_z) >= 10""",
)
def _(fx):
    return quality.anomaly_union(_value_z(fx), _jump_z(fx), 3.0, 10.0)


@query(
    "missing_ranges",
    "series:s feature:s n_missing:i row_start:i row_end:i ts_start:t ts_end:t",
    f"""
WITH l AS ({" UNION ALL ".join(f"SELECT series, pos, ts, '{c}' AS feature FROM market_raw WHERE {c} IS NULL AND day >= DATE '{_CUT}'" for c in MARKET_COLUMNS)}
  UNION ALL SELECT series, pos, ts, 'ts' FROM market_raw WHERE {_NO_TIME} AND day >= DATE '{_CUT}')
SELECT series, feature, count(*) AS n_missing, min(pos) AS row_start, max(pos) AS row_end, min(ts) AS ts_start, max(ts) AS ts_end
FROM (SELECT *, pos - row_number() OVER (PARTITION BY series, feature ORDER BY pos) AS run FROM l) GROUP BY series, feature, run""",
)
def _(fx):
    # the axis has holes; its times come back from the grid that the others lie on
    holes = fx.market_raw.withColumn("ts", F.when(~F.expr(_NO_TIME), F.col("ts")))
    timed = grid.infer_grid(holes, ["series"], "pos", "ts")
    late = timed.where(F.col("day") >= F.lit(_CUT).cast("date"))
    long = late.withColumn("ts_known", F.col("ts").isNotNull().cast("int")).unpivot(["series", "pos", "ts_known", "filled_ts"], MARKET_COLUMNS, "feature", "value")
    values = quality.missing_ranges(long, ["series", "feature"], "pos", "filled_ts", "value")
    times = quality.missing_times(late, ["series"], "pos", "ts", "filled_ts").withColumn("feature", F.lit("ts"))
    return values.unionByName(times)


@query(
    "absent_times",
    "series:s n_missing:i ts_start:t ts_end:t",
    f"""
WITH have AS (SELECT series, ts FROM market_raw WHERE NOT ({_NO_TIME})), gone AS (SELECT series, pos, ts FROM market_raw WHERE {_NO_TIME})
SELECT series, count(*) AS n_missing, min(ts) AS ts_start, max(ts) AS ts_end FROM (SELECT *, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS run FROM gone) g
GROUP BY series, run HAVING min(ts) > (SELECT min(ts) FROM have h WHERE h.series = g.series) AND max(ts) < (SELECT max(ts) FROM have h WHERE h.series = g.series)""",
)
def _(fx):
    return quality.absent_times(fx.market_raw.where(~F.expr(_NO_TIME)), ["series"], "ts")


@query(
    "daily_completeness",
    "series:s day:d feature:s missing:i",
    f"""
SELECT * FROM (SELECT series, day, unnest({MARKET_COLUMNS}) AS feature, unnest([{", ".join(f"count(*) - count({c})" for c in MARKET_COLUMNS)}]) AS missing FROM market_raw GROUP BY series, day) WHERE missing > 0""",
)
def _(fx):
    return quality.daily_completeness(fx.market_raw, ["series"], "day", MARKET_COLUMNS)
