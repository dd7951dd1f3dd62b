"""The input tables of the queries, as SQL over the driver's tables.

``wattline.sources.fixtures`` builds the same tables with Spark.
"""

from __future__ import annotations

from wattline.sources.fixtures import EVENT_CURVES, MARKET_COLUMNS

FIXTURES: dict[str, str] = {}


def fill_sql(source: str, keys: str, pos: str, values: list[str], how: str = "linear") -> str:
    """Both-ended fill of ``values``; NULLs that no row can fill stay NULL."""
    inner, outer = [], []
    for v in values:
        inner.append(
            f"last_value({v} IGNORE NULLS) OVER w1 AS {v}_a, "
            f"last_value(CASE WHEN {v} IS NOT NULL THEN {pos} END IGNORE NULLS) OVER w1 AS {v}_pa, "
            f"first_value({v} IGNORE NULLS) OVER w2 AS {v}_b, "
            f"first_value(CASE WHEN {v} IS NOT NULL THEN {pos} END IGNORE NULLS) OVER w2 AS {v}_pb"
        )
        if how == "linear":
            outer.append(
                f"CASE WHEN {v} IS NOT NULL THEN {v} WHEN {v}_a IS NULL THEN {v}_b WHEN {v}_b IS NULL THEN {v}_a "
                f"ELSE {v}_a + ({v}_b - {v}_a) * ({pos} - {v}_pa) / ({v}_pb - {v}_pa) END AS {v}"
            )
        else:
            outer.append(f"coalesce({v}_a, {v}_b) AS {v}")
    over = f"PARTITION BY {keys} ORDER BY {pos}"
    drop = ", ".join(f"{v}_{x}" for v in values for x in ("a", "pa", "b", "pb"))
    return f"""
SELECT * EXCLUDE ({drop}) REPLACE ({", ".join(outer)}) FROM (
  SELECT *, {", ".join(inner)} FROM {source}
  WINDOW w1 AS ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


FIXTURES["ev_days"] = "SELECT min(ts)::DATE AS lo, max(ts)::DATE AS hi, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS n FROM events"

# --- price line -----------------------------------------------------------
FIXTURES["zone_events"] = """
SELECT n_name AS series, ts::DATE AS day, hour(ts) * 4 + minute(ts) // 15 AS slot, e.*
FROM events e JOIN customer ON e.user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

_curves = ", ".join(f"count(*) FILTER (event_type = '{t}') AS {c}" for c, t in EVENT_CURVES.items())
_zero = ", ".join(f"coalesce(o.{c}, 0)::DOUBLE AS {c}" for c in EVENT_CURVES)
FIXTURES["market_raw"] = f"""
SELECT s.series, d.day, k.slot, date_diff('day', lo, d.day) * 96 + k.slot AS pos,
       d.day::TIMESTAMP + to_minutes(CAST(k.slot * 15 AS BIGINT)) AS ts, o.price, {_zero}, o.tie
FROM (SELECT DISTINCT series FROM zone_events) s
CROSS JOIN ev_days
CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM ev_days) d
CROSS JOIN (SELECT unnest(range(96)) AS slot) k
LEFT JOIN (SELECT series, day, slot, avg(value) AS price, avg(user_id) AS tie, {_curves}
           FROM zone_events GROUP BY ALL) o
  ON o.series = s.series AND o.day = d.day AND o.slot = k.slot"""
FIXTURES["market"] = fill_sql("market_raw", "series", "pos", ["price", "tie"])
FIXTURES["price_days"] = """
SELECT series, day, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS day_idx
FROM (SELECT DISTINCT series, day FROM market)"""
FIXTURES["pred_both"] = """
SELECT series, day, date_diff('day', lo, day) AS day_idx, slot, price AS target, lag(price, 1) OVER w AS lag_a, lag(price, 7) OVER w AS lag_b
FROM market CROSS JOIN ev_days WINDOW w AS (PARTITION BY series, slot ORDER BY day)"""
FIXTURES["pred_a"] = "SELECT series, day, day_idx, slot, lag_a AS prediction, target FROM pred_both WHERE day_idx >= 7"
FIXTURES["pred_b"] = "SELECT series, day, day_idx, slot, lag_b AS prediction, target FROM pred_both WHERE day_idx >= 7"
FIXTURES["candidate"] = "SELECT series, day, slot, prediction / 500.0 AS prediction FROM pred_a"
FIXTURES["offsets"] = """
SELECT series, day, day_idx, (m0 - m1) / 500.0 AS off_true, (m1 - m2) / 500.0 AS off_pred FROM (
  SELECT series, day, day_idx, m0, lag(m0, 1) OVER w AS m1, lag(m0, 2) OVER w AS m2 FROM (
    SELECT series, day, date_diff('day', lo, day) AS day_idx, avg(price) AS m0 FROM market CROSS JOIN ev_days GROUP BY ALL)
  WINDOW w AS (PARTITION BY series ORDER BY day)) WHERE m2 IS NOT NULL"""

# --- load line ------------------------------------------------------------
FIXTURES["users"] = "SELECT DISTINCT user_id AS node_idx FROM events"
FIXTURES["load_raw"] = """
SELECT u.node_idx, a.t_idx, lo::TIMESTAMP + to_hours(CAST(6 * a.t_idx AS BIGINT)) AS ts, o.value
FROM users u CROSS JOIN ev_days CROSS JOIN (SELECT unnest(range(0, n * 4)) AS t_idx FROM ev_days) a
LEFT JOIN (SELECT user_id AS node_idx, date_diff('day', lo, ts::DATE) * 4 + hour(ts) // 6 AS t_idx, avg(value) AS value
           FROM events CROSS JOIN ev_days GROUP BY ALL) o
  ON o.node_idx = u.node_idx AND o.t_idx = a.t_idx"""
FIXTURES["load_fill"] = fill_sql("load_raw", "node_idx", "t_idx", ["value"])
FIXTURES["load_norm"] = """
SELECT node_idx, t_idx, ts, value AS value_raw, (value - vmin) / (vmax - vmin + 1e-8) AS value
FROM load_fill CROSS JOIN (
  SELECT min(value) AS vmin, max(value) AS vmax FROM load_fill CROSS JOIN ev_days WHERE t_idx < floor(n * 4 * CAST(0.6 AS DOUBLE)))"""
FIXTURES["user_nodes"] = """
SELECT user_id AS node_idx, 'u' || user_id AS node_id, r_name AS region, n_name AS nation, r_regionkey,
       CASE WHEN r_regionkey < 2 THEN 'CBD' ELSE 'Residential' END AS zone_type, c_acctbal AS balance, c_mktsegment AS segment
FROM (SELECT DISTINCT user_id FROM events) JOIN customer ON user_id = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
FIXTURES["user_edges"] = """
SELECT a.user_id AS src, b.user_id AS dst, count(*)::DOUBLE AS weight
FROM events a JOIN events b ON b.event_id = a.event_id + 1 GROUP BY ALL"""
FIXTURES["weather"] = """
SELECT lo::TIMESTAMP + to_hours(CAST(6 * step AS BIGINT)) AS ts, avg(l_quantity) AS temperature, avg(l_discount) * 100 AS humidity,
       avg(l_tax) * 1000 AS ghi, avg(l_extendedprice) / 1000 AS wind_speed_10m
FROM (SELECT date_diff('day', DATE '1995-01-01', l_shipdate::DATE) % (n * 4) AS step, lo, l.* FROM lineitem l CROSS JOIN ev_days)
GROUP BY lo, step"""
FIXTURES["node_price"] = """
SELECT lo::TIMESTAMP + to_hours(CAST(6 * step AS BIGINT)) AS ts, node_idx, avg(o_totalprice) / 997 AS price
FROM (SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % (n * 4) AS step, lo, o_custkey AS node_idx, o_totalprice
      FROM orders CROSS JOIN ev_days WHERE o_custkey IN (SELECT node_idx FROM users))
GROUP BY lo, step, node_idx"""
FIXTURES["windows"] = """
SELECT node_idx, t_idx AS t_start, ts AS target_ts, ts - INTERVAL 6 HOUR AS history_end_ts, x_hist, y FROM (
  SELECT node_idx, t_idx, ts, list(value) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS x_hist,
         list(value) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS y
  FROM load_norm WINDOW w AS (PARTITION BY node_idx ORDER BY t_idx))
CROSS JOIN ev_days WHERE t_idx >= 12 AND t_idx <= n * 4 - 6"""
FIXTURES["records"] = """
SELECT variant, t_start, node_idx, node_id, zone_type AS domain, t_start % 17 <> 0 AS parse_ok, x_hist, y AS target,
       CASE WHEN t_start % 17 <> 0 THEN
         CASE WHEN variant = 'seasonal' THEN [x_hist[9], x_hist[10], x_hist[11], x_hist[12], x_hist[9], x_hist[10]]
              ELSE [list_avg(x_hist), list_avg(x_hist), list_avg(x_hist), list_avg(x_hist), list_avg(x_hist), list_avg(x_hist)] END
       END AS pred
FROM windows JOIN user_nodes USING (node_idx) CROSS JOIN (SELECT unnest(['seasonal', 'mean']) AS variant)"""

# --- large graph matrix ---------------------------------------------------
FIXTURES["daily_raw"] = """
SELECT g.node_id, g.day, date_diff('day', lo, g.day) AS t_idx, o.value
FROM (SELECT n_name AS node_id, lo, hi, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day
      FROM nation CROSS JOIN (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders)) g
LEFT JOIN (SELECT n_name AS node_id, o_orderdate::DATE AS day, sum(o_totalprice) AS value
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) o
  ON o.node_id = g.node_id AND o.day = g.day"""
FIXTURES["daily_fill"] = fill_sql("daily_raw", "node_id", "t_idx", ["value"])
FIXTURES["stations"] = """
SELECT n_name AS station, l_shipdate::DATE AS day, sum(l_extendedprice) AS power
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL"""
FIXTURES["feed"] = """
SELECT l_returnflag AS feed, l_shipdate::DATE AS day, avg(l_quantity) AS temperature, avg(l_discount) * 100 AS humidity,
       max(l_linenumber)::DOUBLE AS rain
FROM lineitem GROUP BY ALL"""

# --- slow daily and monthly features ---------------------------------------
FIXTURES["timeline"] = """
SELECT day, orders_seen, order_value FROM (
  SELECT lo + CAST(off AS INTEGER) AS day, count(*)::DOUBLE AS orders_seen, avg(o_totalprice) / 1000 AS order_value, avg(count(*)) OVER () AS usual
  FROM (SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % n AS off, lo, o_totalprice FROM orders CROSS JOIN ev_days) GROUP BY lo, off)
WHERE orders_seen > usual"""
FIXTURES["policy"] = """
SELECT day, errors FROM (SELECT day, errors, median(errors) OVER () AS mid FROM (
  SELECT ts::DATE AS day, (count(*) FILTER (event_type = 'error'))::DOUBLE AS errors FROM events GROUP BY ALL)) WHERE errors > mid"""
FIXTURES["monthly"] = """
SELECT month(o_orderdate) AS month, avg(o_totalprice) / 1000 AS f0, count(*)::DOUBLE AS f1 FROM orders GROUP BY ALL"""
FIXTURES["slow_days"] = """
SELECT day, coalesce(last_value(orders_seen IGNORE NULLS) OVER w, 0) AS orders_seen, coalesce(last_value(order_value IGNORE NULLS) OVER w, 0) AS order_value,
       coalesce(last_value(errors IGNORE NULLS) OVER w, 0) AS errors
FROM timeline FULL OUTER JOIN policy USING (day) WHERE year(day) = 2024
WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
FIXTURES["axis_weather"] = fill_sql(
    "(SELECT 0 AS one, t_idx, a.ts, temperature, humidity FROM (SELECT DISTINCT t_idx, ts FROM load_raw) a LEFT JOIN weather w ON w.ts = a.ts)",
    "one", "t_idx", ["temperature", "humidity"])

# --- scored records ---------------------------------------------------------
FIXTURES["norm_bounds"] = """
SELECT min(value) AS vmin, max(value) AS vmax FROM load_fill CROSS JOIN ev_days WHERE t_idx < floor(n * 4 * CAST(0.6 AS DOUBLE))"""
FIXTURES["record_steps"] = """
SELECT variant, domain, node_idx, t_start, generate_subscripts(pred, 1) AS h, unnest(pred) AS p, unnest(target) AS t, vmin, vmax
FROM records CROSS JOIN norm_bounds WHERE parse_ok"""
FIXTURES["step_errors"] = "SELECT variant, domain, node_idx, t_start, h, (p - t) * (vmax - vmin) AS err FROM record_steps"
FIXTURES["scored"] = """
SELECT r.variant, r.t_start, r.node_idx, r.node_id, r.domain, r.parse_ok, x_hist[12] * (vmax - vmin) + vmin AS hist_last, r.target, r.pred,
       m.* EXCLUDE (variant, t_start, node_idx), (list_max(r.target) - list_min(r.target)) * (vmax - vmin) AS target_range
FROM records r CROSS JOIN norm_bounds LEFT JOIN (
  SELECT variant, t_start, node_idx, avg(abs(p - t)) AS mae, sqrt(avg((p - t) * (p - t))) AS rmse, avg(CAST(sign(p - pp) = sign(t - tp) AS DOUBLE)) AS direction_accuracy,
         first(h ORDER BY p DESC, h) - first(h ORDER BY t DESC, h) AS peak_time_error_steps, abs(max(p) - max(t)) AS peak_abs_error, max(p) - min(p) AS prediction_range FROM (
    SELECT variant, t_start, node_idx, h, p, t, coalesce(lag(p) OVER w, x0) AS pp, coalesce(lag(t) OVER w, x0) AS tp FROM (
      SELECT s.variant, s.t_start, s.node_idx, h, p * (s.vmax - s.vmin) + s.vmin AS p, t * (s.vmax - s.vmin) + s.vmin AS t, x.x_hist[12] * (s.vmax - s.vmin) + s.vmin AS x0
      FROM record_steps s JOIN windows x ON x.t_start = s.t_start AND x.node_idx = s.node_idx)
    WINDOW w AS (PARTITION BY variant, t_start, node_idx ORDER BY h)) GROUP BY ALL) m
  ON m.variant = r.variant AND m.t_start = r.t_start AND m.node_idx = r.node_idx"""
FIXTURES["paired"] = """
SELECT a.t_start, a.node_idx, a.domain, avg(abs(a.p - b.p)) AS variant_gap_mae, avg(abs(a.p - a.t)) AS full_mae, avg(abs(b.p - b.t)) AS wo_mae,
       avg(abs(b.p - b.t)) - avg(abs(a.p - a.t)) AS full_advantage
FROM record_steps a JOIN record_steps b ON b.variant = 'mean' AND b.t_start = a.t_start AND b.node_idx = a.node_idx AND b.h = a.h
WHERE a.variant = 'seasonal' GROUP BY a.t_start, a.node_idx, a.domain"""
FIXTURES["market_long"] = " UNION ALL ".join(f"SELECT series, pos, day, ts, '{c}' AS feature, {c} AS value FROM market" for c in MARKET_COLUMNS)
FIXTURES["pair_table"] = "SELECT series, day, day_idx, slot, lag_a AS prediction_base, lag_b AS prediction_seq, target FROM pred_both WHERE day_idx >= 7"


def day_metrics_sql(source: str, pred: str, floor: float, cap: float, keys: str = "series, day") -> str:
    return f"""
SELECT {keys}, mae, rmse, relative_mape, greatest(0.0, 1 - relative_mape) AS relative_accuracy, greatest(0.0, 1 - mae / {cap - floor}) AS range_accuracy,
       greatest(0.0, 1 - abs(pred_mean - true_mean) / greatest(abs(true_mean), {floor})) AS daily_mean_accuracy, CAST(ps = ts AS INT) AS peak_slot_hit,
       pred_mean, true_mean, pred_max, true_max
FROM (SELECT {keys}, avg(abs({pred} - target)) AS mae, sqrt(avg(({pred} - target) * ({pred} - target))) AS rmse,
        avg(abs({pred} - target) / greatest(abs(target), {floor})) AS relative_mape, avg({pred}) AS pred_mean, avg(target) AS true_mean, max({pred}) AS pred_max, max(target) AS true_max,
        first(slot ORDER BY {pred} DESC, slot) AS ps, first(slot ORDER BY target DESC, slot) AS ts
      FROM {source} GROUP BY {keys})"""


FIXTURES["days_a"] = day_metrics_sql("pred_a", "prediction", 5.0, 200.0)

# --- retrieval inputs -------------------------------------------------------
FIXTURES["axis_feats"] = """
SELECT t_idx, temperature, humidity, sin(2 * pi() * hour(ts) / 24) AS hs, cos(2 * pi() * hour(ts) / 24) AS hc, sin(2 * pi() * (isodow(ts) - 1) / 7) AS ds,
       cos(2 * pi() * (isodow(ts) - 1) / 7) AS dc FROM axis_weather"""


def _stats_sql(p: int, col: str, w: str) -> list[tuple[int, str]]:
    half = f"avg({col}) OVER (o ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) - avg({col}) OVER (o ROWS BETWEEN 28 PRECEDING AND 15 PRECEDING)"
    return [(p, f"avg({col}) OVER ({w})"), (p + 1, f"stddev_pop({col}) OVER ({w})"), (p + 2, f"min({col}) OVER ({w})"), (p + 3, f"max({col}) OVER ({w})"), (p + 4, half)]


def vectors_sql(version: str) -> str:
    """Long-form window vectors: plain window aggregates over the raw rows."""
    h, f, c = "o ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING", "o ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING", "o ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING"
    node = [(0, f"avg(value) OVER ({h})"), (1, f"stddev_pop(value) OVER ({h})")]
    axis = [(5, i, f"avg({x}) OVER ({h})") for i, x in enumerate(("hs", "hc", "ds", "dc"))]
    lo = 28 if version == "context" else 12
    if version != "legacy":
        node += [(2, "lag(value) OVER (o)"), (3, "lag(value) OVER (o) - lag(value, 2) OVER (o)"), (4, "lag(value) OVER (o) - lag(value, 4) OVER (o)")]
        for i, x in enumerate(("temperature", "humidity")):
            axis += [(6, i, f"avg({x}) OVER ({h})"), (7, i, f"stddev_pop({x}) OVER ({h})"), (8, i, f"lag({x}) OVER (o)"), (9, i, f"avg({x}) OVER ({f})"),
                     (10, i, f"min({x}) OVER ({f})"), (11, i, f"max({x}) OVER ({f})"), (12, i, f"lead({x}, 5) OVER (o) - {x}")]
    if version == "context":
        node += _stats_sql(13, "value", c)
        for i, x in enumerate(("temperature", "humidity")):
            axis += [(p, i, e) for p, e in _stats_sql(18, x, c)]
    keep = f"WHERE t_idx >= {lo} AND t_idx <= n * 4 - 6"
    return f"""
SELECT t_idx AS t_start, unnest([{", ".join(str(p) for p, _ in node)}]) AS part, node_idx AS idx, unnest(vals) AS v FROM (
  SELECT t_idx, node_idx, [{", ".join(e for _, e in node)}] AS vals FROM load_norm WINDOW o AS (PARTITION BY node_idx ORDER BY t_idx)) CROSS JOIN ev_days {keep}
UNION ALL
SELECT t_idx, unnest([{", ".join(str(p) for p, _, _ in axis)}]), unnest([{", ".join(str(i) for _, i, _ in axis)}]), unnest(vals) FROM (
  SELECT t_idx, [{", ".join(e for _, _, e in axis)}] AS vals FROM axis_feats WINDOW o AS (ORDER BY t_idx)) CROSS JOIN ev_days {keep}"""


FIXTURES["legacy_parts"] = vectors_sql("legacy")
FIXTURES["neighbours"] = """
SELECT q_t, p_t, dist, row_number() OVER (PARTITION BY q_t ORDER BY dist, p_t) AS rank FROM (
  SELECT a.t_start AS q_t, b.t_start AS p_t, round(sum((a.v - b.v) * (a.v - b.v)), 6) AS dist
  FROM legacy_parts a JOIN legacy_parts b ON a.part = b.part AND a.idx = b.idx AND b.t_start < a.t_start GROUP BY ALL)
QUALIFY rank <= 3"""
FIXTURES["facts"] = """
SELECT w.t_start, w.node_idx, list_avg(x_hist) AS occ, t.temperature AS temp, t.ghi, t.wind_speed_10m AS wind, coalesce(p.price, m.price) AS price
FROM windows w LEFT JOIN weather t ON t.ts = w.history_end_ts LEFT JOIN node_price p ON p.ts = w.history_end_ts AND p.node_idx = w.node_idx
LEFT JOIN (SELECT ts, avg(price) AS price FROM node_price GROUP BY ts) m ON m.ts = w.history_end_ts"""
FIXTURES["diffs"] = """
SELECT q.t_start, q.node_idx, h.retrieved, round_even(q.occ - h.occ, 4) AS diff_occ, round_even(q.temp - coalesce(h.temp, 0), 4) AS diff_temp,
       round_even(q.price - coalesce(h.price, 0), 4) AS diff_price, round_even(q.ghi - coalesce(h.ghi, 0), 4) AS diff_ghi, round_even(q.wind - coalesce(h.wind, 0), 4) AS diff_wind
FROM facts q JOIN (SELECT q_t, node_idx, count(*) AS retrieved, avg(occ) AS occ, avg(temp) AS temp, avg(price) AS price, avg(ghi) AS ghi, avg(wind) AS wind
  FROM neighbours JOIN facts ON t_start = p_t GROUP BY q_t, node_idx) h ON h.q_t = q.t_start AND h.node_idx = q.node_idx"""

# --- curves -----------------------------------------------------------------
FIXTURES["day_curves"] = """
SELECT series, day, list(prediction_base / 500.0 ORDER BY slot) AS cand, list(prediction_seq / 500.0 ORDER BY slot) AS model, list(target / 500.0 ORDER BY slot) AS truth
FROM pair_table GROUP BY ALL"""
FIXTURES["curve_mask"] = """
SELECT series, day, slot, greatest(hit, coalesce(lag(hit) OVER w, 0), coalesce(lead(hit) OVER w, 0)) AS mask FROM (
  SELECT *, CAST(v >= 0.45 OR abs(v - p) >= 0.08 OR abs(x - v) >= 0.08 OR abs(x - 2.0 * v + p) >= 0.05 AS INT) AS hit FROM (
    SELECT series, day, slot, prediction_base / 500.0 AS v, coalesce(lag(prediction_base / 500.0) OVER d, prediction_base / 500.0) AS p, coalesce(lead(prediction_base / 500.0) OVER d, prediction_base / 500.0) AS x
    FROM pair_table WINDOW d AS (PARTITION BY series, day ORDER BY slot)))
WINDOW w AS (PARTITION BY series, day ORDER BY slot)"""
FIXTURES["step_pairs"] = """
SELECT node_idx, domain, t_start - 12 + i - 1 AS step, max(truth) AS truth, max(p) FILTER (variant = 'seasonal') AS full_p, max(p) FILTER (variant = 'mean') AS other_p FROM (
  SELECT variant, node_idx, domain, t_start, generate_subscripts(target, 1) AS i, unnest(target) AS truth, unnest(coalesce(pred, [NULL, NULL, NULL, NULL, NULL, NULL])) AS p
  FROM records WHERE (t_start - 12) % 6 = 0) GROUP BY ALL"""
