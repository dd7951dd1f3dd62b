"""Queries: projections, predicates, cleaning and gap repair."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.functions import nodes as nd
from wattline.functions.calendar import cyclic, slot_of, weekday0
from wattline.operators import clean, grid, splits
from wattline.plans.fixtures_sql import fill_sql
from wattline.plans.registry import query
from wattline.sources.fixtures import EVENT_CURVES

PI2 = "(2 * pi())"


@query(
    "ts_coerce",
    "event_id:i parsed:t",
    f"""
SELECT event_id, CASE event_id % 22
         WHEN 1 THEN date_trunc('minute', s) WHEN 3 THEN date_trunc('minute', s) WHEN 6 THEN date_trunc('minute', s) WHEN 9 THEN date_trunc('minute', s)
         WHEN 14 THEN date_trunc('minute', s) WHEN 17 THEN date_trunc('minute', s)
         WHEN 18 THEN CASE WHEN day(s) > 12 THEN date_trunc('minute', s) ELSE make_timestamp(year(s), day(s), month(s), hour(s), minute(s), 0) END
         WHEN 10 THEN date_trunc('day', s) WHEN 11 THEN date_trunc('day', s) WHEN 12 THEN NULL
         WHEN 8 THEN s + INTERVAL 1 SECOND
         WHEN 13 THEN TIMESTAMP '1899-12-30' + to_seconds(CAST(round((sec // 86400 + (sec % 86400 * 1000000 // 86400) / 1000000.0) * 86400) AS BIGINT)) ELSE s END AS parsed
FROM (SELECT *, date_trunc('second', ts) AS s, date_diff('second', TIMESTAMP '1899-12-30', date_trunc('second', ts)) AS sec FROM events)""",
)
def _(fx):
    sec = F.expr("timestampdiff(SECOND, timestamp_ntz'1899-12-30', date_trunc('second', ts))")
    micro = F.floor((sec % 86400) * 1000000 / 86400).cast("long")
    layouts = {
        0: "yyyy-MM-dd HH:mm:ss", 1: "yyyy/MM/dd HH:mm", 2: "yyyyMMddHHmmss", 3: "yyyy-MM-dd HH:mm", 4: "yyyy-MM-dd'T'HH:mm:ss", 5: "yyyy/MM/dd HH:mm:ss",
        6: "yyyy/M/d H:mm", 7: "yyyy-MM-dd HH:mm:ss'.4'", 8: "yyyy-MM-dd'T'HH:mm:ss'.75Z'", 9: "MM/dd/yyyy HH:mm", 10: "yyyy-MM-dd", 11: "yyyyMMdd",
        14: "MM/dd/yyyy hh:mm a", 15: "yyyy-MM-dd HH:mm:ss'+08:00'", 16: "MMM d, yyyy HH:mm:ss", 17: "d-MMM-yyyy HH:mm", 18: "dd/MM/yyyy HH:mm",
        19: "dd MMMM yyyy HH:mm:ss 'GMT'", 20: "yyyy-MM-dd hh:mm:ss a", 21: "yyyy-MM-dd'T'HH:mm:ss'-0330'",
    }
    # two layouts say the time of another zone
    ahead = F.when(F.col("event_id") % 22 == 15, F.expr("interval 8 hours")).when(F.col("event_id") % 22 == 21, F.expr("interval '-03:30' hour to minute")).otherwise(F.expr("interval 0 hours"))
    turn, text = F.col("event_id") % 22, F.concat(F.floor(sec / 86400).cast("string"), F.lit("."), F.lpad(micro.cast("string"), 6, "0"))
    text = F.when(turn == 12, F.when(F.col("event_id") % 44 == 12, "n/a").otherwise("2024-02-30 10:00")).otherwise(text)
    for k, layout in layouts.items():
        text = F.when(turn == k, F.date_format(F.col("ts") + ahead, layout)).otherwise(text)
    return fx.table("events").select("event_id", clean.ts_coerce(text).alias("parsed"))


# A quarter-hour axis with every seventh time missing; some series also sit off the grid, so their axis is kept.
NO_TIME, OFF_GRID = "pos % 7 = 3", "length(series) % 3 = 0 AND pos % 5 = 0"


@query(
    "infer_grid",
    "series:s pos:i step_s:f match:f filled_ts:t",
    f"""
WITH raw AS (SELECT series, pos, CASE WHEN {NO_TIME} THEN NULL WHEN {OFF_GRID} THEN ts + INTERVAL 1 MINUTE ELSE ts END AS ts FROM market_raw),
steps AS (SELECT series, median(gap) AS step_s FROM (
  SELECT series, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY series ORDER BY ts) AS gap FROM raw WHERE ts IS NOT NULL) WHERE gap IS NOT NULL GROUP BY series),
starts AS (SELECT f.series, step_s, s0 - step_s * p0 AS start FROM (
  SELECT series, min(pos) AS p0, arg_min(epoch(ts), pos) AS s0 FROM raw WHERE ts IS NOT NULL GROUP BY series) f LEFT JOIN steps USING (series)),
matched AS (SELECT series, avg(CASE WHEN epoch(ts) = start + step_s * pos THEN 1.0 ELSE 0.0 END) AS match
  FROM raw JOIN starts USING (series) WHERE ts IS NOT NULL GROUP BY series)
SELECT raw.series, pos, step_s, match,
       CASE WHEN match >= 0.999 THEN coalesce(ts, make_timestamp(CAST((start + step_s * pos) * 1000000 AS BIGINT))) ELSE ts END AS filled_ts
FROM raw LEFT JOIN starts USING (series) LEFT JOIN matched USING (series)""",
)
def _(fx):
    ts = F.when(F.expr(NO_TIME), None).when(F.expr(OFF_GRID), F.col("ts") + F.expr("interval 1 minute")).otherwise(F.col("ts"))
    return grid.infer_grid(fx.market_raw.select("series", "pos", ts.alias("ts")), ["series"], "pos", "ts")


@query(
    "infer_freq_mode",
    "step_s:i n:i",
    """
SELECT gap AS step_s, count(*) AS n FROM (
  SELECT date_diff('second', lag(day::TIMESTAMP) OVER (PARTITION BY station ORDER BY day), day::TIMESTAMP) AS gap FROM stations)
WHERE gap IS NOT NULL GROUP BY gap ORDER BY n DESC, gap LIMIT 1""",
)
def _(fx):
    return grid.infer_step_mode(fx.stations, ["station"], "day", bucket_s=365 * 86400)


@query(
    "num_coerce",
    "event_id:i num:f",
    """
SELECT event_id, CASE WHEN isfinite(v) THEN v END AS num FROM (SELECT event_id, TRY_CAST(CASE event_type
  WHEN 'click' THEN CAST(value AS VARCHAR) WHEN 'view' THEN 'inf' WHEN 'signup' THEN 'nan'
  WHEN 'purchase' THEN '-' || CAST(event_id AS VARCHAR) ELSE 'missing' END AS DOUBLE) AS v FROM events)""",
)
def _(fx):
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.col("value").cast("string")).when(kind == "view", "inf").when(kind == "signup", "nan")
        .when(kind == "purchase", F.concat(F.lit("-"), F.col("event_id").cast("string"))).otherwise("missing")
    )
    return fx.table("events").select("event_id", clean.num_coerce(text).alias("num"))


@query(
    "missing_mask",
    "stage:s feature:s missing:i",
    """
SELECT 'before' AS stage, 'price' AS feature, sum(CAST(price IS NULL AS INT)) AS missing FROM market_raw
UNION ALL SELECT 'before', 'tie', sum(CAST(tie IS NULL AS INT)) FROM market_raw
UNION ALL SELECT 'after', 'price', sum(CAST(price IS NULL AS INT)) FROM market
UNION ALL SELECT 'after', 'tie', sum(CAST(tie IS NULL AS INT)) FROM market""",
)
def _(fx):
    before = clean.missing_counts(fx.market_raw, ["price", "tie"]).withColumn("stage", F.lit("before"))
    after = clean.missing_counts(fx.market, ["price", "tie"]).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


@query("missing_mask_rows", "series:s pos:i price_missing:i tie_missing:i",
       "SELECT series, pos, CAST(price IS NULL AS INT) AS price_missing, CAST(tie IS NULL AS INT) AS tie_missing FROM market_raw")
def _(fx):
    return clean.missing_mask(fx.market_raw, ["price", "tie"])


@query(
    "reindex_grid",
    "station:s day:d power:f2",
    """
SELECT g.station, g.day, s.power FROM (
  SELECT station, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day
  FROM (SELECT DISTINCT station FROM stations) CROSS JOIN (SELECT min(day) AS lo, max(day) AS hi FROM stations)) g
LEFT JOIN stations s ON s.station = g.station AND s.day = g.day""",
)
def _(fx):
    return grid.reindex_grid(fx.stations, "station", "day", "1 day")


@query("interp_time", "node_id:s day:d value:f",
       f"SELECT node_id, day, greatest(value, 100000) AS value FROM ({fill_sql('daily_raw', 'node_id', 't_idx', ['value'])})")
def _(fx):
    stamped = fx.daily_raw.withColumn("ts", F.col("day").cast("timestamp_ntz"))
    return clean.interp_time(stamped, ["node_id"], "ts", ["value"], clip_lower=100000.0)


@query("interp_pos", "series:s pos:i price:f tie:f", "SELECT series, pos, price, tie FROM market")
def _(fx):
    return fx.market


@query("ffill_bfill", "node_id:s day:d value:f", fill_sql("daily_raw", "node_id", "t_idx", ["value"], "step"))
def _(fx):
    return clean.ffill_bfill(fx.daily_raw, ["node_id"], "t_idx", "value")


@query(
    "zero_fill",
    "node_idx:i t_idx:i value:f",
    """
SELECT node_idx, t_idx, CASE WHEN v IS NULL OR NOT isfinite(v) THEN 0.0 ELSE v END AS value FROM (
  SELECT node_idx, t_idx, CASE WHEN value > 400 THEN 'inf'::DOUBLE WHEN value < 20 THEN 'nan'::DOUBLE ELSE value END AS v FROM load_raw)""",
)
def _(fx):
    v = F.when(F.col("value") > 400, float("inf")).when(F.col("value") < 20, float("nan")).otherwise(F.col("value"))
    return fx.load_raw.select("node_idx", "t_idx", clean.zero_fill(v).alias("value"))


@query("dedupe_mean", "l_orderkey:i l_linenumber:i l_quantity:f l_extendedprice:f",
       "SELECT l_orderkey, l_linenumber, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL")
def _(fx):
    return clean.dedupe_mean(fx.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])


_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
for _key, _last in (("dedupe_first", False), ("dedupe_last", True)):

    @query(
        _key,
        "l_orderkey:i l_linenumber:i l_shipdate:t l_partkey:i l_suppkey:i l_extendedprice:f",
        f"""
SELECT l_orderkey, l_linenumber, {", ".join(_ORDER)} FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + (" DESC" if _last else "") for c in _ORDER)}) = 1""",
    )
    def _(fx, _last=_last):
        rows = fx.table("lineitem").select("l_orderkey", "l_linenumber", *_ORDER)
        return clean.dedupe_first(rows, ["l_orderkey", "l_linenumber"], _ORDER, last=_last)


@query("resample_mean", "user_id:i ts:t value:f",
       "SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS value FROM events GROUP BY ALL")
def _(fx):
    return grid.resample_mean(fx.table("events"), ["user_id"], "ts", "value")


@query(
    "coverage_filter",
    "station:s rows:i",
    """
SELECT station, n AS rows FROM (SELECT station, count(*) AS n, max(count(*)) OVER () AS most FROM stations GROUP BY station)
WHERE n >= greatest(1, floor(most * CAST(0.95 AS DOUBLE)))""",
)
def _(fx):
    return grid.coverage_filter(fx.stations, "station", 0.95)


@query(
    "common_overlap",
    "station:s day:d power:f2 coverage:f",
    """
WITH spans AS (SELECT station, min(day) AS lo, max(day) AS hi, count(power) AS known FROM stations GROUP BY station),
bounds AS (SELECT max(lo) AS lo, min(hi) AS hi FROM spans)
SELECT s.station, s.day, s.power, known / (date_diff('day', b.lo, b.hi) + 1) AS coverage
FROM stations s JOIN spans USING (station) CROSS JOIN bounds b WHERE s.day BETWEEN b.lo AND b.hi""",
)
def _(fx):
    return grid.common_overlap(fx.stations, "station", "day", "power")


_NORM = "(value - lo) / (hi - lo + 1e-8)"
@query(
    "minmax_norm",
    "node_idx:i t_idx:i full_data:f train_only:f price_bounds:f",
    """
SELECT node_idx, t_idx, (value - lo) / (hi - lo + 1e-8) AS full_data, (value - tlo) / (thi - tlo + 1e-8) AS train_only,
       value / (1000 + 1e-8) AS price_bounds
FROM load_fill CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi, min(value) FILTER (t_idx < floor(n * 4 * CAST(0.6 AS DOUBLE))) AS tlo,
  max(value) FILTER (t_idx < floor(n * 4 * CAST(0.6 AS DOUBLE))) AS thi FROM load_fill CROSS JOIN ev_days)""",
)
def _(fx):
    train = F.col("t_idx") < F.floor(fx.n_steps * 0.6)
    df = clean.minmax_norm(fx.load_fill, "value").withColumnRenamed("value_norm", "full_data")
    df = clean.minmax_norm(df, "value", train).withColumnRenamed("value_norm", "train_only")
    return clean.minmax_norm(df, "value", bounds=(0.0, 1000.0)).withColumnRenamed("value_norm", "price_bounds")


@query(
    "denormalize",
    "node_idx:i t_idx:i value:f",
    """
SELECT node_idx, t_idx, value * (vmax - vmin) + vmin AS value FROM load_norm CROSS JOIN (
  SELECT min(value) AS vmin, max(value) AS vmax FROM load_fill CROSS JOIN ev_days WHERE t_idx < floor(n * 4 * CAST(0.6 AS DOUBLE)))""",
)
def _(fx):
    train = F.col("t_idx") < F.floor(fx.n_steps * 0.6)
    df = clean.minmax_norm(fx.load_fill, "value", train)
    return df.select("node_idx", "t_idx", clean.denormalize(F.col("value_norm"), F.col("vmin"), F.col("vmax")).alias("value"))


@query(
    "split_ratio",
    "node_idx:i t_idx:i split:s split_idx:i",
    """
SELECT node_idx, t_idx, split, t_idx - CASE split WHEN 'train' THEN 0 WHEN 'val' THEN a ELSE b END AS split_idx FROM (
  SELECT node_idx, t_idx, a, b, CASE WHEN t_idx < a THEN 'train' WHEN t_idx < b THEN 'val' ELSE 'test' END AS split
  FROM load_raw CROSS JOIN (SELECT floor(n * 4 * CAST(0.6 AS DOUBLE)) AS a, floor(n * 4 * CAST(0.8 AS DOUBLE)) AS b FROM ev_days))""",
)
def _(fx):
    return splits.split_ratio(fx.load_raw, "t_idx", fx.n_steps)


@query(
    "split_index",
    "node_idx:i t_idx:i split:s split_idx:i",
    """
SELECT l.node_idx, l.t_idx, m.split, m.ordinal AS split_idx FROM load_raw l JOIN (
  SELECT t_idx, split, row_number() OVER (PARTITION BY split ORDER BY t_idx) - 1 AS ordinal FROM (
    SELECT DISTINCT t_idx, CASE WHEN isodow(ts) >= 6 THEN 'test' WHEN isodow(ts) = 1 THEN 'val' ELSE 'train' END AS split FROM load_raw)) m USING (t_idx)""",
)
def _(fx):
    wd = weekday0(F.col("ts"))
    axis = fx.load_raw.select("t_idx", F.when(wd >= 5, "test").when(wd == 0, "val").otherwise("train").alias("split")).distinct()
    lists = axis.withColumn("ordinal", F.row_number().over(Window.partitionBy("split").orderBy("t_idx")) - 1)
    return splits.split_index(fx.load_raw, "t_idx", lists)


@query("split_year", "node_id:s day:d split:s",
       "SELECT node_id, day, CASE year(day) WHEN 1996 THEN 'train' ELSE 'test' END AS split FROM daily_raw WHERE year(day) IN (1996, 1997)")
def _(fx):
    return splits.split_year(fx.daily_raw, "day", 1996, 1997)


@query(
    "split_year_internal",
    "day:d pos_in_year:i split:s",
    """
SELECT day, p AS pos_in_year, CASE WHEN p < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN p < floor(n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) WHERE year(day) = 1996)""",
)
def _(fx):
    axis = fx.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return splits.split_year_internal(axis, "day", 1996)


@query(
    "split_days",
    "series:s day:d split:s",
    """
SELECT series, day, CASE WHEN day_idx < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN day_idx < floor(n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM price_days)""",
)
def _(fx):
    return splits.split_days(fx.price_days, ["series"], "day", 0.8, 0.1)


@query(
    "split_dates",
    "series:s day:d split:s",
    """
SELECT series, day, CASE WHEN day BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' THEN 'train' WHEN day BETWEEN DATE '2024-01-21' AND DATE '2024-01-25' THEN 'val' ELSE 'test' END AS split
FROM price_days WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-29'""",
)
def _(fx):
    return splits.split_dates(
        fx.price_days, "day", {"train": ("2024-01-01", "2024-01-20"), "val": ("2024-01-21", "2024-01-25"), "test": ("2024-01-26", "2024-01-29")}
    )


@query(
    "split_holdout_tail",
    "expert:s t_start:i node_idx:i split:s",
    """
SELECT zone_type AS expert, t_start, node_idx, CASE WHEN row_number() OVER (PARTITION BY zone_type ORDER BY t_start, node_idx) - 1
  < floor(count(*) OVER (PARTITION BY zone_type) * CAST(0.85 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split
FROM windows JOIN user_nodes USING (node_idx)""",
)
def _(fx):
    items = fx.windows.select("t_start", "node_idx").join(fx.user_nodes.select("node_idx", F.col("zone_type").alias("expert")), "node_idx")
    return splits.split_holdout_tail(items, ["expert"], ["t_start", "node_idx"], F.col("t_start"))


@query(
    "calendar_feats",
    "series:s pos:i hour_sin:f hour_cos:f dow_sin:f dow_cos:f slot_sin:f slot_cos:f month_sin:f month_cos:f is_weekend:i",
    f"""
SELECT series, pos, sin({PI2} * hour(ts) / 24) AS hour_sin, cos({PI2} * hour(ts) / 24) AS hour_cos,
       sin({PI2} * (isodow(ts) - 1) / 7) AS dow_sin, cos({PI2} * (isodow(ts) - 1) / 7) AS dow_cos,
       sin({PI2} * slot / 96) AS slot_sin, cos({PI2} * slot / 96) AS slot_cos,
       sin({PI2} * month(ts) / 12) AS month_sin, cos({PI2} * month(ts) / 12) AS month_cos, CAST(isodow(ts) >= 6 AS INT) AS is_weekend
FROM market_raw""",
)
def _(fx):
    ts = F.col("ts")
    cols = []
    for name, x, period in (("hour", F.hour(ts), 24), ("dow", weekday0(ts), 7), ("slot", slot_of(ts), 96), ("month", F.month(ts), 12)):
        s, c = cyclic(x, period)
        cols += [s.alias(f"{name}_sin"), c.alias(f"{name}_cos")]
    return fx.market_raw.select("series", "pos", *cols, (weekday0(ts) >= 5).cast("int").alias("is_weekend"))


@query("slot_day", "event_id:i day:d slot:i",
       "SELECT event_id, ts::DATE AS day, hour(ts) * 4 + minute(ts) // 15 AS slot FROM events")
def _(fx):
    return fx.table("events").select("event_id", F.to_date("ts").alias("day"), slot_of(F.col("ts")).alias("slot"))


@query(
    "time_range_filter",
    "t_start:i node_idx:i target_ts:t",
    """
SELECT t_start, node_idx, target_ts FROM windows WHERE target_ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'
ORDER BY t_start, node_idx LIMIT 300""",
)
def _(fx):
    return splits.time_range(fx.windows, "target_ts", "2024-01-10 06:00:00", "2024-01-20 18:00:00", 300, ["t_start", "node_idx"])


@query(
    "time_range_filter_all",
    "t_start:i node_idx:i target_ts:t",
    "SELECT t_start, node_idx, target_ts FROM windows WHERE target_ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'",
)
def _(fx):
    return splits.time_range(fx.windows, "target_ts", "2024-01-10 06:00:00", "2024-01-20 18:00:00", None, ["t_start", "node_idx"])


_KINDS = {**EVENT_CURVES, "refund": "refund", "renewal": "renewal"}
@query(
    "drop_zero_cols",
    "day:d feature:s value:f",
    f"""
WITH wide AS (SELECT ts::DATE AS day, {", ".join(f"count(*) FILTER (event_type = '{t}')::DOUBLE AS {c}" for c, t in _KINDS.items())} FROM events GROUP BY ALL),
long AS (UNPIVOT wide ON {", ".join(_KINDS)} INTO NAME feature VALUE value)
SELECT * FROM long WHERE feature IN (SELECT feature FROM long GROUP BY feature HAVING sum(abs(value)) > 0)""",
)
def _(fx):
    wide = fx.table("events").groupBy(F.to_date("ts").alias("day")).agg(
        *[F.count(F.when(F.col("event_type") == t, 1)).cast("double").alias(c) for c, t in _KINDS.items()]
    )
    return clean.drop_zero_features(wide.unpivot(["day"], list(_KINDS), "feature", "value"))


@query(
    "zone_from_flag",
    "node_idx:i zone:s",
    """
SELECT node_idx, CASE WHEN coalesce(TRY_CAST(flag AS DOUBLE), 0) > 0 THEN 'CBD' ELSE 'Residential' END AS zone FROM (
  SELECT node_idx, CASE r_regionkey WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'unknown' WHEN 3 THEN '2.5' END AS flag FROM user_nodes)""",
)
def _(fx):
    r = F.col("r_regionkey")
    flag = F.when(r == 0, "1").when(r == 1, "0").when(r == 2, "unknown").when(r == 3, "2.5")
    return fx.user_nodes.select("node_idx", clean.zone_from_flag(flag).alias("zone"))


@query(
    "node_align",
    "node_idx:i nation:s balance:f",
    "SELECT u.node_idx, m.nation, m.balance FROM users u LEFT JOIN (SELECT nation, balance, CASE WHEN balance > 0 THEN node_idx ELSE -1 - node_idx END AS node_idx FROM user_nodes) m USING (node_idx)",
)
def _(fx):
    # nodes with a debt go by another key, so that some are missing
    meta = fx.user_nodes.withColumn("node_idx", F.when(F.col("balance") > 0, F.col("node_idx")).otherwise(-1 - F.col("node_idx")))
    return nd.align_nodes(fx.users, meta.select("node_idx", "nation", "balance"), "node_idx")


@query("node_static_context", "node_idx:i node_id:s zone_type:s capacity:f area:f",
       "SELECT node_idx, node_id, segment AS zone_type, balance AS capacity, r_regionkey * 10.0 AS area FROM user_nodes")
def _(fx):
    raw = fx.user_nodes.select(
        "node_idx", "node_id", F.col("segment").alias("area_type"), F.col("balance").alias("Station_Capacity"),
        F.floor("balance").alias("pile_count"), (F.col("r_regionkey") * 10.0).alias("station_area"),
    )
    return nd.static_context(raw)


@query(
    "domain_label",
    "node_idx:i label:s",
    """
SELECT node_idx, CASE WHEN trim(raw) = '' THEN NULL WHEN regexp_matches(lower(raw), 'cbd|commercial|business') THEN 'CBD'
  WHEN regexp_matches(lower(raw), 'res|living') THEN 'Residential'
  ELSE array_to_string(list_transform(string_split(lower(trim(raw)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS label
FROM (SELECT node_idx, CASE r_regionkey WHEN 0 THEN segment || ' commercial' WHEN 1 THEN 'RESIDENTIAL ' || region WHEN 2 THEN '  ' || segment || ' '
  WHEN 3 THEN '  ' ELSE segment || ' ' || region END AS raw FROM user_nodes)""",
)
def _(fx):
    r = F.col("r_regionkey")
    raw = (
        F.when(r == 0, F.concat("segment", F.lit(" commercial"))).when(r == 1, F.concat(F.lit("RESIDENTIAL "), "region"))
        .when(r == 2, F.concat(F.lit("  "), "segment", F.lit(" "))).when(r == 3, F.lit("  ")).otherwise(F.concat_ws(" ", "segment", "region"))
    )
    return fx.user_nodes.select("node_idx", nd.domain_label(raw).alias("label"))


# Node ids and source columns of a mixed site, one kind per market segment.
SITE_ROLES = {
    "AUTOMOBILE": ("load_", "sys_demand"), "BUILDING": ("pv_", "p_pv_total"), "FURNITURE": ("wind_", "speed"),
    "HOUSEHOLD": ("grid_", "gate"), "MACHINERY": ("z_", "spot_price"),
}


@query(
    "task_profile",
    "node_idx:i kind:s role:s unit:s domain:s",
    f"""
SELECT node_idx, kind, CASE kind {" ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in nd.PROFILES.items())} END AS role,
       CASE kind {" ".join(f"WHEN '{k}' THEN '{v[3]}'" for k, v in nd.PROFILES.items())} END AS unit,
       CASE kind WHEN 'price' THEN zone_type WHEN 'system' THEN zone_type {" ".join(f"WHEN '{k}' THEN '{v[4]}'" for k, v in nd.PROFILES.items() if k not in ("price", "system"))} END AS domain
FROM (SELECT *, CASE WHEN src LIKE '%price%' THEN 'price' WHEN nation_type LIKE '%tie_line%' THEN 'system' WHEN id LIKE '%pv%' THEN 'solar' WHEN id LIKE '%wind%' THEN 'wind'
        WHEN id LIKE '%load%' THEN 'demand' WHEN id LIKE '%grid%' THEN 'flow' ELSE 'charging' END AS kind
  FROM (SELECT node_idx, zone_type, CASE segment {" ".join(f"WHEN '{s}' THEN '{p}'" for s, (p, _) in SITE_ROLES.items())} ELSE 'u' END || node_idx AS id,
               CASE segment {" ".join(f"WHEN '{s}' THEN '{c}'" for s, (_, c) in SITE_ROLES.items())} ELSE '' END AS src,
               CASE WHEN r_regionkey = 4 THEN 'tie_line' ELSE 'site' END AS nation_type FROM user_nodes))""",
)
def _(fx):
    prefix, source = F.lit("u"), F.lit("")
    for s, (p, c) in SITE_ROLES.items():
        prefix = F.when(F.col("segment") == s, p).otherwise(prefix)
        source = F.when(F.col("segment") == s, c).otherwise(source)
    kind = F.when(F.col("r_regionkey") == 4, "tie_line").otherwise("site")
    profile = nd.task_profile(F.concat(prefix, F.col("node_idx")), kind, F.col("zone_type"), F.lit(None).cast("string"), source, F.lit(None).cast("string"))
    return fx.user_nodes.select("node_idx", profile.alias("p")).select("node_idx", "p.*")


@query(
    "node_meta_build",
    "node_idx:i node_id:s capacity:f zone_type:s expert_id:i known:i",
    """
SELECT node_idx, node_id, max(abs(value)) AS capacity, zone_type, CASE zone_type WHEN 'CBD' THEN 0 ELSE 1 END AS expert_id, count(value) AS known
FROM load_raw JOIN user_nodes USING (node_idx) GROUP BY ALL""",
)
def _(fx):
    peaks = fx.load_raw.groupBy("node_idx").agg(F.max(F.abs("value")).alias("capacity"), F.count("value").alias("known"))
    return peaks.join(fx.user_nodes, "node_idx").withColumn("expert_id", nd.expert_label(F.col("zone_type")))


@query(
    "validate_dataset",
    "stage:s check_name:s found:f ok:i",
    "".join(
        f"""{"UNION ALL" if stage == "filled" else ""}
SELECT '{stage}' AS stage, 'missing_column:value' AS check_name, 0 AS found, 1 AS ok
UNION ALL SELECT '{stage}', 'missing_column:price', 1, 0
UNION ALL SELECT '{stage}', 'null_share', avg(CAST(value IS NULL AS DOUBLE)), CAST(count(*) = count(value) AS INT) FROM {table}
UNION ALL SELECT '{stage}', 'null_share:' || split, avg(CAST(value IS NULL AS DOUBLE)), CAST(count(*) = count(value) AS INT)
  FROM (SELECT value, CASE WHEN t_idx < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN t_idx < floor(n * CAST(0.8 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM {table}, (SELECT max(t_idx) + 1 AS n FROM {table})) GROUP BY split
UNION ALL SELECT '{stage}', 'node_count', count(DISTINCT node_idx), CAST(count(DISTINCT node_idx) = 247 AS INT) FROM {table}
UNION ALL SELECT '{stage}', 'cell_count', count(*), CAST(count(*) = 247 * 8640 AS INT) FROM {table} """
        for stage, table in (("raw", "load_raw"), ("filled", "load_fill"))
    ),
)
def _(fx):
    out = None
    for stage, df in (("raw", fx.load_raw), ("filled", fx.load_fill)):
        parted = splits.split_ratio(df, "t_idx", df.agg(F.max("t_idx") + 1).scalar(), (0.6, 0.2, 0.2))
        rows = clean.validate(parted, ["node_idx"], "value", ["value", "price"], n_time=8640, n_nodes=247, split="split")
        rows = rows.select(F.lit(stage).alias("stage"), F.col("check").alias("check_name"), "found", "ok")
        out = rows if out is None else out.unionByName(rows)
    return out
