"""Queries: windows, samples and day curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.arrays import asum
from wattline.operators import splits, windows
from wattline.plans.registry import query
from wattline.sources.fixtures import EXOG, PRICE_CAP, PRICE_FLOOR

_SPLIT = """SELECT *, CASE WHEN t_idx < a THEN 'train' WHEN t_idx < b THEN 'val' ELSE 'test' END AS split,
  t_idx - CASE WHEN t_idx < a THEN 0 WHEN t_idx < b THEN a ELSE b END AS split_idx
  FROM load_norm CROSS JOIN (SELECT floor(n * 4 * CAST(0.6 AS DOUBLE)) AS a, floor(n * 4 * CAST(0.8 AS DOUBLE)) AS b FROM ev_days)"""


def _split_load(fx):
    return splits.split_ratio(fx.load_norm, "t_idx", fx.n_steps)


@query(
    "sliding_windows",
    "split:s node_idx:i t_start:i part:s i:i v:f",
    f"""
WITH w AS (SELECT split, node_idx, split_idx AS t_start, x_hist, y3, y6 FROM (
  SELECT split, node_idx, split_idx, list(value) OVER (p ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x_hist,
         list(value) OVER (p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS y3, list(value) OVER (p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS y6
  FROM ({_SPLIT}) WINDOW p AS (PARTITION BY split, node_idx ORDER BY split_idx))
  WHERE len(x_hist) = 12 AND len(y6) = 6 AND (split_idx - 12) % 2 = 0)
SELECT split, node_idx, t_start, 'x_hist' AS part, generate_subscripts(x_hist, 1) AS i, unnest(x_hist) AS v FROM w
UNION ALL SELECT split, node_idx, t_start, 'y_3', generate_subscripts(y3, 1), unnest(y3) FROM w
UNION ALL SELECT split, node_idx, t_start, 'y_6', generate_subscripts(y6, 1), unnest(y6) FROM w""",
)
def _(fx):
    df = _split_load(fx).select("split", "node_idx", "split_idx", "value")
    w = windows.sliding_windows(df, ["split", "node_idx"], "split_idx", "value", history=12, horizons=[3, 6], stride=2)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("vals")) for c in ("x_hist", "y_3", "y_6")]))
    rows = w.select("split", "node_idx", "t_start", parts.alias("p")).select("*", F.posexplode("p.vals").alias("i", "v"))
    return rows.select("split", "node_idx", "t_start", "p.part", (F.col("i") + 1).alias("i"), "v")


@query(
    "context_windows",
    "node_idx:i t_start:i c_len:i c_first:f c_last:f c_sum:f x_first:f y_last:f",
    """
SELECT node_idx, t_idx AS t_start, len(c) AS c_len, c[1] AS c_first, c[28] AS c_last, list_sum(c) AS c_sum, c[17] AS x_first, y[6] AS y_last FROM (
  SELECT node_idx, t_idx, list(value) OVER (p ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS c, list(value) OVER (p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS y
  FROM load_norm WINDOW p AS (PARTITION BY node_idx ORDER BY t_idx)) WHERE len(c) = 28 AND len(y) = 6""",
)
def _(fx):
    w = windows.sliding_windows(
        fx.load_norm.drop("value_raw"), ["node_idx"], "t_idx", "value", history=12, horizons=[6], context=28
    )
    c = F.col("x_context")
    return w.select(
        "node_idx", "t_start", F.size(c).alias("c_len"), c[0].alias("c_first"), c[27].alias("c_last"), asum(c).alias("c_sum"),
        F.col("x_hist")[0].alias("x_first"), F.col("y_6")[5].alias("y_last"),
    )


@query(
    "aux_windows",
    "node_idx:i t_start:i t_hist_first:f t_hist_last:f t_future_first:f t_future_last:f h_hist_sum:f h_future_sum:f",
    """
SELECT node_idx, t_idx AS t_start, th[1] AS t_hist_first, th[12] AS t_hist_last, tf[1] AS t_future_first, tf[6] AS t_future_last,
       list_sum(hh) AS h_hist_sum, list_sum(hf) AS h_future_sum FROM (
  SELECT node_idx, t_idx, list(temperature) OVER (p ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS th, list(humidity) OVER (p ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS hh,
         list(temperature) OVER (p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS tf, list(humidity) OVER (p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS hf
  FROM load_norm JOIN axis_weather USING (t_idx) WINDOW p AS (PARTITION BY node_idx ORDER BY t_idx)) WHERE len(th) = 12 AND len(tf) = 6""",
)
def _(fx):
    df = fx.load_norm.drop("value_raw").join(fx.axis_weather.drop("ts"), "t_idx")
    w = windows.sliding_windows(
        df, ["node_idx"], "t_idx", "value", history=12, horizons=[6], extra=["temperature", "humidity"]
    )
    th, tf = F.col("temperature_hist"), F.col("temperature_future")
    return w.select(
        "node_idx", "t_start", th[0].alias("t_hist_first"), th[11].alias("t_hist_last"), tf[0].alias("t_future_first"),
        tf[5].alias("t_future_last"), asum(F.col("humidity_hist")).alias("h_hist_sum"), asum(F.col("humidity_future")).alias("h_future_sum"),
    )


@query(
    "inference_windows",
    "node_idx:i t_start:i first:f last:f total:f",
    """
SELECT node_idx, t_idx AS t_start, x[1] AS first, x[12] AS last, list_sum(x) AS total FROM (
  SELECT node_idx, t_idx, list(value) OVER (PARTITION BY node_idx ORDER BY t_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x FROM load_norm) WHERE len(x) = 12""",
)
def _(fx):
    w = windows.sliding_windows(fx.load_norm.drop("value_raw"), ["node_idx"], "t_idx", "value", history=12, horizons=[], stride=1)
    x = F.col("x_hist")
    return w.select("node_idx", "t_start", x[0].alias("first"), x[11].alias("last"), asum(x).alias("total"))


@query(
    "concat_windows",
    "node_idx:i step:i t_start:i y:f",
    """
SELECT node_idx, t_start - 12 + i - 1 AS step, t_start, y FROM (
  SELECT node_idx, t_start, generate_subscripts(y, 1) AS i, unnest(y) AS y FROM windows WHERE (t_start - 12) % 6 = 0)""",
)
def _(fx):
    return windows.concat_windows(fx.windows, 6, "y", ["node_idx"], first=12)


@query(
    "rolling_origins",
    "series:s origin:i chunk:i chunk_start:i chunk_end:i hist_start:i hist_end:i target_mean:f",
    """
SELECT o.series, origin, chunk, origin + chunk * 16 AS chunk_start, origin + chunk * 16 + 16 AS chunk_end,
       origin + chunk * 16 - 192 AS hist_start, origin + chunk * 16 AS hist_end, avg(m.price) AS target_mean
FROM (SELECT series, pos AS origin FROM market CROSS JOIN ev_days WHERE pos >= 192 AND (pos - 192) % 96 = 0 AND pos <= n * 96 - 96) o
CROSS JOIN (SELECT unnest(range(6)) AS chunk) c
JOIN market m ON m.series = o.series AND m.pos >= origin + chunk * 16 AND m.pos < origin + chunk * 16 + 16 GROUP BY ALL""",
)
def _(fx):
    o = windows.rolling_origins(fx.market, ["series"], "pos", context=192, chunk=16)
    steps = o.withColumn("pos", F.explode(F.sequence(F.col("chunk_start"), F.col("chunk_end") - 1)))
    joined = steps.join(fx.market.select("series", "pos", "price"), ["series", "pos"])
    return joined.groupBy(*o.columns).agg(F.avg("price").alias("target_mean"))


_STARTS = "SELECT t_idx AS t_start, t_idx - 12 AS win FROM (SELECT DISTINCT t_idx FROM load_raw) CROSS JOIN ev_days WHERE t_idx >= 12 AND t_idx <= n * 4 - 6"


def _starts(fx):
    return fx.spark.range(12, max(12, fx.days * 4 - 5)).select(F.col("id").alias("t_start"), (F.col("id") - 12).alias("win"))


# Node ids with holes: two numbers between any two nodes belong to none.
_SPARSE = "(SELECT node_idx * 3 + 1 AS node_idx, row_number() OVER (ORDER BY node_idx) - 1 AS n FROM users)"


def _nodes(fx):
    return fx.users.select((F.col("node_idx") * 3 + 1).alias("node_idx"))


_ITEMS = f"SELECT win, t_start, node_idx, win * (SELECT count(*) FROM users) + n AS item FROM ({_STARTS}) CROSS JOIN {_SPARSE}"


@query("tag_nodes", "win:i t_start:i node_idx:i item:i", _ITEMS)
def _(fx):
    return windows.tag_nodes(_starts(fx), _nodes(fx))


@query("tag_nodes_capped", "win:i t_start:i node_idx:i item:i", f"SELECT * FROM ({_ITEMS}) WHERE item < 5000")
def _(fx):
    return windows.tag_nodes(_starts(fx), _nodes(fx), cap=5000)


@query(
    "tag_nodes_shuffled",
    "win:i t_start:i node_idx:i",
    f"SELECT win, t_start, node_idx FROM ({_STARTS}) CROSS JOIN {_SPARSE} ORDER BY md5('42:' || win || ':' || node_idx) LIMIT 2000",
)
def _(fx):
    return windows.tag_nodes(_starts(fx), _nodes(fx), cap=2000, seed=42)


@query("tag_nodes_shuffled_all", "win:i t_start:i node_idx:i", f"SELECT win, t_start, node_idx FROM ({_STARTS}) CROSS JOIN {_SPARSE}")
def _(fx):
    return windows.tag_nodes(_starts(fx), _nodes(fx), seed=42)


_SLOTS = range(96)


@query(
    "day_pivot",
    "series:s day:d " + " ".join(f"s{i}:f" for i in _SLOTS),
    "SELECT series, day, " + ", ".join(f"max(price) FILTER (slot = {i}) AS s{i}" for i in _SLOTS) + " FROM market GROUP BY ALL",
)
def _(fx):
    return windows.day_pivot(fx.market, ["series", "day"], "price")


_EX_COLS = "target_slot prev_day_slot slot_delta_vs_prev_day target_day_mean target_day_std prev_day_mean".split()
_POINT = (
    "series:s day:d slot:i day_of_week:i month:i is_weekend:i slot_sin:f slot_cos:f prev_day_same_slot_price:f prev_2day_same_slot_price:f "
    "prev_7day_same_slot_price:f prev_day_price_mean:f prev_day_price_std:f prev_day_price_max:f prev_day_price_min:f prev_2day_price_mean:f prev_7day_price_mean:f "
    + " ".join(f"{c}_{x}:f" for c in EXOG for x in _EX_COLS)
    + " daily_orders_seen:f daily_order_value:f daily_errors:f priority_month_f0:f priority_month_f1:f target_price:f"
)
_EX_SQL = ", ".join(
    f"m.{c} AS {c}_target_slot, {c}_prev AS {c}_prev_day_slot, m.{c} - {c}_prev AS {c}_slot_delta_vs_prev_day, {c}_m AS {c}_target_day_mean, {c}_s AS {c}_target_day_std, {c}_m1 AS {c}_prev_day_mean"
    for c in EXOG
)


@query(
    "day_point_features",
    _POINT,
    f"""
WITH ds AS MATERIALIZED (SELECT *, row_number() OVER w AS r, lag(pm, 1) OVER w AS pm1, lag(ps, 1) OVER w AS ps1, lag(px, 1) OVER w AS px1, lag(pn, 1) OVER w AS pn1, lag(pm, 2) OVER w AS pm2,
  lag(pm, 7) OVER w AS pm7, {", ".join(f"lag({c}_m, 1) OVER w AS {c}_m1" for c in EXOG)} FROM (
    SELECT series, day, avg(price) AS pm, stddev_samp(price) AS ps, max(price) AS px, min(price) AS pn, {", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in EXOG)}
    FROM market GROUP BY series, day) WINDOW w AS (PARTITION BY series ORDER BY day)),
mr AS MATERIALIZED (SELECT *, lag(price, 1) OVER w AS p1, lag(price, 2) OVER w AS p2, lag(price, 7) OVER w AS p7, {", ".join(f"lag({c}, 1) OVER w AS {c}_prev" for c in EXOG)}
  FROM market WINDOW w AS (PARTITION BY series, slot ORDER BY day))
SELECT m.series, m.day, m.slot, isodow(m.day) - 1 AS day_of_week, month(m.day) AS month, CAST(isodow(m.day) >= 6 AS INT) AS is_weekend,
       sin(2 * pi() * m.slot / 96) AS slot_sin, cos(2 * pi() * m.slot / 96) AS slot_cos,
       p1 AS prev_day_same_slot_price, p2 AS prev_2day_same_slot_price, p7 AS prev_7day_same_slot_price,
       pm1 AS prev_day_price_mean, ps1 AS prev_day_price_std, px1 AS prev_day_price_max, pn1 AS prev_day_price_min, pm2 AS prev_2day_price_mean, pm7 AS prev_7day_price_mean,
       {_EX_SQL}, coalesce(sd.orders_seen, 0) AS daily_orders_seen, coalesce(sd.order_value, 0) AS daily_order_value, coalesce(sd.errors, 0) AS daily_errors,
       coalesce(mo.f0, 0) AS priority_month_f0, coalesce(mo.f1, 0) AS priority_month_f1, m.price AS target_price
FROM mr m JOIN ds d ON d.series = m.series AND d.day = m.day AND r > 7
LEFT JOIN slow_days sd ON sd.day = m.day LEFT JOIN monthly mo ON mo.month = month(m.day)""",
)
def _(fx):
    return windows.day_point_features(fx.market, EXOG, fx.slow_days, fx.monthly)


_LOW, _HIGH, _TRAIN_END = 50.0, 150.0, "2024-01-20"
_ORIGIN = f"(day <= DATE '{_TRAIN_END}' AND (pos - 672) % 8 = 0) OR (day > DATE '{_TRAIN_END}' AND slot = 0)"
_SCALE = PRICE_CAP - PRICE_FLOOR


_SLOW = ("orders_seen", "order_value", "errors")
_CURVE_COLUMNS = " ".join(f"{c}_future:f {c}_prev:f {c}_delta:f {c}_day_mean:f {c}_day_std:f {c}_prev_mean:f" for c in EXOG)
_SLOW_COLUMNS = " ".join(f"slow_{c}:f" for c in _SLOW)


def _each(template: str, names=EXOG) -> str:
    return ", ".join(template.replace("@", c) for c in names)


@query(
    "day_sequence_features",
    f"series:s origin:i step:i hist_price:f prev2_price:f prev7_price:f {_CURVE_COLUMNS} hist_mean:f hist_std:f hist_max:f hist_min:f prev2_mean:f prev7_mean:f "
    f"floor_share:f peak_share:f slot_sin:f dow_cos:f month_sin:f {_SLOW_COLUMNS} base_price:f target_price:f target_floor:i target_peak:i",
    f"""
WITH b AS (SELECT {_each("min(@) AS @_lo, max(@) AS @_hi")} FROM market WHERE day <= DATE '{_TRAIN_END}'),
nm AS MATERIALIZED (SELECT *, lag(p, 96) OVER w AS hist_price, lag(price, 96) OVER w AS base_price, lag(p, 192) OVER w AS prev2_price, lag(p, 672) OVER w AS prev7_price,
  {_each("lag(@_future, 96) OVER w AS @_prev")} FROM (
  SELECT series, pos, ts, price, (price - {PRICE_FLOOR}) / {_SCALE} AS p, {_each("(@ - @_lo) / (@_hi - @_lo + 1e-6) AS @_future")} FROM market CROSS JOIN b)
  WINDOW w AS (PARTITION BY series ORDER BY pos)),
og AS MATERIALIZED (SELECT series, pos AS origin FROM market CROSS JOIN ev_days WHERE pos >= 672 AND pos + 96 <= n * 96 AND ({_ORIGIN})),
st AS MATERIALIZED (SELECT series, origin, step, origin + step AS at FROM (SELECT series, origin, unnest(range(96)) AS step FROM og)),
f AS MATERIALIZED (SELECT origin, step, nm.* EXCLUDE (price), price AS target_price FROM st JOIN nm ON nm.series = st.series AND nm.pos = st.at),
g AS (SELECT series, origin, avg(hist_price) AS hist_mean, stddev_pop(hist_price) AS hist_std, max(hist_price) AS hist_max, min(hist_price) AS hist_min, avg(prev2_price) AS prev2_mean,
  avg(prev7_price) AS prev7_mean, avg(CAST(base_price <= {_LOW} AS DOUBLE)) AS floor_share, avg(CAST(base_price >= {_HIGH} AS DOUBLE)) AS peak_share,
  {_each("avg(@_future) AS @_day_mean, stddev_pop(@_future) AS @_day_std, avg(@_prev) AS @_prev_mean")}, min(ts)::DATE AS day FROM f GROUP BY ALL),
s AS (SELECT day, {_each("(@ - min(@) OVER ()) / (max(@) OVER () - min(@) OVER () + 1e-6) AS slow_@", _SLOW)} FROM slow_days)
SELECT f.*, {_each("f.@_future - f.@_prev AS @_delta")}, g.* EXCLUDE (series, origin, day), sin(2 * pi() * (hour(f.ts) * 4 + minute(f.ts) // 15) / 96) AS slot_sin,
       cos(2 * pi() * (isodow(f.ts) - 1) / 7) AS dow_cos, sin(2 * pi() * month(f.ts) / 12) AS month_sin, {_each("coalesce(s.slow_@, 0) AS slow_@", _SLOW)},
       CAST(target_price <= {_LOW} AS INT) AS target_floor, CAST(target_price >= {_HIGH} AS INT) AS target_peak
FROM f JOIN g USING (series, origin) LEFT JOIN s USING (day)""",
)
def _(fx):
    train = F.col("day") <= F.lit(_TRAIN_END).cast("date")
    return windows.day_sequence_features(fx.market, EXOG, PRICE_FLOOR, PRICE_CAP, F.expr(_ORIGIN), train, _LOW, _HIGH, fx.slow_days.select("day", *_SLOW))


@query(
    "slow_features_asof",
    "day:d orders_seen:f order_value:f errors:f f0:f f1:f",
    "SELECT day, orders_seen, order_value, errors, f0, f1 FROM slow_days JOIN monthly ON month = month(day)",
)
def _(fx):
    return fx.slow_days.withColumn("month", F.month("day")).join(fx.monthly, "month")


_OFFSET_COLUMNS = " ".join(f"{c}_mean:f {c}_std:f {c}_max:f" for c in EXOG)
_OFFSET_SQL = ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, max({c}) AS {c}_max" for c in EXOG)


@query(
    "day_offset_rows",
    f"series:s day:d candidate_mean:f candidate_min:f candidate_max:f prev_mean:f prev7_mean:f {_OFFSET_COLUMNS} day_offset:f",
    f"""
WITH d AS (SELECT *, lag(truth, 1) OVER w AS l1, coalesce(lag(truth, 7) OVER w, first_value(truth) OVER w) AS prev7_mean FROM (
  SELECT series, day, avg(price) / 500.0 AS truth, {_OFFSET_SQL}
  FROM market GROUP BY ALL) WINDOW w AS (PARTITION BY series ORDER BY day)),
c AS (SELECT series, day, avg(prediction) AS candidate_mean, min(prediction) AS candidate_min, max(prediction) AS candidate_max FROM candidate GROUP BY ALL)
SELECT d.*, c.candidate_mean, candidate_min, candidate_max, coalesce(l1, candidate_mean) AS prev_mean,
       least(greatest(truth - candidate_mean, -0.2), 0.2) AS day_offset FROM d JOIN c USING (series, day)""",
)
def _(fx):
    return windows.day_offset_rows(fx.market, fx.candidate, EXOG, 500.0)
