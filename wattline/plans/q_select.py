"""Queries: scoring, ranking, case selection and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.operators import calibrate, metrics, select, windows
from wattline.plans.registry import query
from wattline.sources.fixtures import PRICE_CAP, PRICE_FLOOR
from wattline.sources.sinks import written

_PARTS = """parts AS MATERIALIZED (SELECT node_idx, t_start, history_end_ts, x_hist, y, list_max(x_hist || y) AS top, list_avg(x_hist) AS xm, list_stddev_pop(x_hist) AS xs, list_stddev_pop(y) AS ys,
  list_stddev_pop(x_hist || y) AS bs, list_avg(list_transform(y, lambda v: abs(v - 0.04))) AS gap FROM windows)"""


@query(
    "active_source",
    "t_start:i node_idx:i score:f pos:i",
    f"""
WITH {_PARTS}, s AS (SELECT t_start, node_idx, round(xs + ys + abs(x_hist[12] - x_hist[9]) + abs(y[6] - y[1]) + 0.001 * greatest(0, coalesce(ghi, 0)), 9) AS score
  FROM parts LEFT JOIN weather ON ts = history_end_ts)
SELECT *, row_number() OVER (ORDER BY score DESC, t_start, node_idx) AS pos FROM s QUALIFY pos <= greatest(1, ceil((SELECT count(*) FROM s) * CAST(0.5 AS DOUBLE)))""",
)
def _(fx):
    w = fx.windows.join(fx.weather.select(F.col("ts").alias("history_end_ts"), "ghi"), "history_end_ts", "left")
    scored = w.select("t_start", "node_idx", select.source_score(F.col("x_hist"), F.col("y"), F.coalesce("ghi", F.lit(0.0))).alias("score"))
    return select.keep_best(scored, ["t_start", "node_idx"], 0.5)


@query(
    "active_price",
    "t_start:i node_idx:i score:f pos:i",
    f"""
WITH {_PARTS}, s AS (SELECT t_start, node_idx, round(2.0 * ys + 1.5 * (list_max(y) - list_min(y)) + gap + 0.5 * greatest(0, list_max(y) - 0.04) + 0.5 * xs + 0.5 * abs(y[6] - y[1]), 9) AS score FROM parts)
SELECT *, row_number() OVER (ORDER BY score DESC, t_start, node_idx) AS pos FROM s QUALIFY pos <= greatest(1, ceil((SELECT count(*) FROM s) * CAST(0.7 AS DOUBLE)))""",
)
def _(fx):
    scored = fx.windows.select("t_start", "node_idx", select.price_score(F.col("x_hist"), F.col("y")).alias("score"))
    return select.keep_best(scored, ["t_start", "node_idx"], 0.7)


def _chain(k: int) -> str:
    ctes = []
    for i in range(6):
        used = " UNION ALL ".join(f"SELECT node_idx, t_start FROM c{j}" for j in range(i))
        free = f"AND NOT EXISTS (SELECT 1 FROM ({used}) u WHERE u.node_idx = r.node_idx AND u.t_start = r.t_start)" if i else ""
        ctes.append(
            f"c{i} AS MATERIALIZED (SELECT node_idx, t_start, '{select.SCENARIOS[i]}' AS scenario, row_number() OVER (PARTITION BY node_idx ORDER BY k{i} DESC, t_start) AS pick FROM ranked r WHERE true {free} QUALIFY pick <= {k})"
        )
    return ", ".join(ctes)


_SCEN = f"""WITH {_PARTS}, ranked AS MATERIALIZED (SELECT node_idx, p.t_start, round(-xm, 9) AS k0, round(y[6] - y[1], 9) AS k1, round(top, 9) AS k2, round(-(y[6] - y[1]), 9) AS k3, round(bs, 9) AS k4,
  round(abs(b.temperature - a.temperature), 9) AS k5 FROM parts p JOIN axis_weather a ON a.t_idx = p.t_start JOIN axis_weather b ON b.t_idx = p.t_start + 5),
{_chain(3)} {" UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(6))}"""


def _scenario_windows(fx):
    temp = fx.axis_weather.select("t_idx", "temperature")
    start = temp.select(F.col("t_idx").alias("t_start"), F.col("temperature").alias("_a"))
    end = temp.select((F.col("t_idx") - 5).alias("t_start"), F.col("temperature").alias("_b"))
    return fx.windows.join(start, "t_start").join(end, "t_start").withColumn("temp_delta", F.col("_b") - F.col("_a"))


@query("scenario_select", "node_idx:i scenario:s t_start:i pick:i", _SCEN)
def _(fx):
    return select.select_scenarios(_scenario_windows(fx), 3)


@query(
    "scenario_summary",
    "variant:s scenario:s records:i parsed:i mae:f rmse:f",
    f"SELECT variant, scenario, count(*) AS records, sum(CAST(parse_ok AS INT)) AS parsed, avg(mae) AS mae, avg(rmse) AS rmse FROM ({_SCEN}) p JOIN scored s ON s.node_idx = p.node_idx AND s.t_start = p.t_start GROUP BY ALL",
)
def _(fx):
    picked = select.select_scenarios(_scenario_windows(fx), 3)
    return fx.scored.join(picked, ["node_idx", "t_start"]).groupBy("variant", "scenario").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("parse_ok").cast("long")).alias("parsed"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse")
    )


def _label(s: str, m: str) -> str:
    return f"CASE WHEN abs({s}) >= 0.01 THEN CASE WHEN {s} > 0 THEN 'rising' ELSE 'falling' END WHEN abs({m}) >= 0.01 THEN CASE WHEN {m} > 0 THEN 'rising' ELSE 'falling' END ELSE 'flat' END"


_TREND = "trend AS MATERIALIZED (SELECT t_start, node_idx, x_hist[12] AS lv, x_hist[12] - x_hist[11] AS ss, x_hist[12] - x_hist[9] AS ms FROM windows)"


@query("trend_summary", "t_start:i node_idx:i last_value:f short_slope:f medium_slope:f trend_label:s",
       f"WITH {_TREND} SELECT t_start, node_idx, lv AS last_value, ss AS short_slope, ms AS medium_slope, {_label('ss', 'ms')} AS trend_label FROM trend")
def _(fx):
    return fx.windows.select("t_start", "node_idx", *select.trend_columns(F.col("x_hist")))


@query(
    "trend_summary_retrieved",
    "t_start:i node_idx:i retrieved_last_value:f retrieved_short_slope:f retrieved_medium_slope:f retrieved_trend_label:s",
    f"""WITH {_TREND}, m AS (SELECT q_t AS t_start, node_idx, avg(lv) AS a, avg(ss) AS b, avg(ms) AS c FROM neighbours JOIN trend ON trend.t_start = p_t GROUP BY ALL)
SELECT t_start, node_idx, a AS retrieved_last_value, b AS retrieved_short_slope, c AS retrieved_medium_slope, {_label('b', 'c')} AS retrieved_trend_label FROM m""",
)
def _(fx):
    return select.retrieved_trends(fx.windows, fx.neighbours)


@query(
    "downsample_anchors",
    "node_idx:i t_start:i i:i v:f",
    """
SELECT node_idx, t_start, unnest(range(28)) AS i, unnest(list_transform(range(28), lambda j: c[CASE WHEN j = 27 THEN 40 ELSE CAST(floor(j * (39 / 27.0::DOUBLE)) AS BIGINT) + 1 END])) AS v FROM (
  SELECT node_idx, t_idx AS t_start, list(value) OVER (PARTITION BY node_idx ORDER BY t_idx ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS c FROM load_norm) WHERE len(c) = 40""",
)
def _(fx):
    w = windows.sliding_windows(fx.load_norm.drop("value_raw"), ["node_idx"], "t_idx", "value", history=12, horizons=[], context=40, stride=1)
    return w.select("node_idx", "t_start", F.posexplode(select.downsample(F.col("x_context"))).alias("i", "v"))


@query("refine_mask", "series:s day:d slot:i mask:i", "SELECT * FROM curve_mask")
def _(fx):
    return fx.day_curves.select("series", "day", F.posexplode(select.refine_mask(F.col("cand"))).alias("slot", "mask"))


@query(
    "combine_candidate",
    "series:s day:d slot:i absolute:f residual:f selective:f chunk:f",
    """
SELECT series, day, slot, least(greatest(m, 0.01), 0.5) AS absolute, least(greatest(c + rc, 0.01), 0.5) AS residual, least(greatest(c + rc * mask, 0.01), 0.5) AS selective,
       least(greatest(c + avg(rc) OVER (PARTITION BY series, day), 0.01), 0.5) AS chunk FROM (
  SELECT series, day, slot, prediction_base / 500.0 AS c, prediction_seq / 500.0 AS m, least(greatest(prediction_seq / 500.0 - prediction_base / 500.0, -0.2), 0.2) AS rc, mask
  FROM pair_table JOIN curve_mask USING (series, day, slot))""",
)
def _(fx):
    cand, model = F.col("cand"), F.col("model")
    residual = F.zip_with(model, cand, lambda a, b: a - b)
    base = fx.day_curves.withColumn("mask", select.refine_mask(cand)).withColumn("r", residual)
    args = (F.col("cand"), F.col("mask"))
    out = base.select(
        "series", "day",
        F.posexplode(F.arrays_zip(
            select.combine_candidate(F.col("model"), *args, "absolute", None, (0.01, 0.5)).alias("absolute"),
            select.combine_candidate(F.col("r"), *args, "residual", 0.2, (0.01, 0.5)).alias("residual"),
            select.combine_candidate(F.col("r"), *args, "selective_residual", 0.2, (0.01, 0.5)).alias("selective"),
            select.combine_candidate(F.col("r"), *args, "chunk_offset", 0.2, (0.01, 0.5)).alias("chunk"),
        )).alias("slot", "x"),
    )
    return out.select("series", "day", "slot", "x.*")


@query(
    "residual_targets",
    "series:s day:d slot:i plain:f selective:f chunk:f",
    """
SELECT series, day, slot, least(greatest(r, -0.2), 0.2) AS plain, least(greatest(r * mask, -0.2), 0.2) AS selective, least(greatest(avg(r) OVER (PARTITION BY series, day), -0.2), 0.2) AS chunk
FROM (SELECT series, day, slot, target / 500.0 - prediction_base / 500.0 AS r, mask FROM pair_table JOIN curve_mask USING (series, day, slot))""",
)
def _(fx):
    base = fx.day_curves.withColumn("mask", select.refine_mask(F.col("cand")))
    args = (F.col("truth"), F.col("cand"), F.col("mask"))
    modes = (("plain", "residual"), ("selective", "selective_residual"), ("chunk", "chunk_offset"))
    zipped = F.arrays_zip(*[select.residual_targets(*args, m).alias(n) for n, m in modes])
    return base.select("series", "day", F.posexplode(zipped).alias("slot", "x")).select("series", "day", "slot", "x.*")


@query(
    "rank_variant_cases",
    "mode:s t_start:i node_idx:i full_mae:f",
    " UNION ALL ".join(
        f"(SELECT '{m}' AS mode, t_start, node_idx, full_mae FROM paired ORDER BY round({a}, 9) DESC, round({b}, 9) DESC, t_start, node_idx LIMIT 20)" for m, (a, b) in select.PAIR_MODES.items()
    ),
)
def _(fx):
    out = None
    for mode in select.PAIR_MODES:
        rows = select.rank_pairs(fx.paired, mode, 20).withColumn("mode", F.lit(mode)).select("mode", "t_start", "node_idx", "full_mae")
        out = rows if out is None else out.unionByName(rows)
    return out


_OK = "ok AS MATERIALIZED (SELECT *, round(mae, 9) AS m, round(rmse, 9) AS r, round(prediction_range, 9) AS pr, round(target_range, 9) AS tr, median(mae) OVER () AS mid FROM scored WHERE parse_ok AND variant = 'seasonal')"
_BUCKETS = f"""buckets AS MATERIALIZED (
SELECT 'best' AS bucket, row_number() OVER (ORDER BY m, r, t_start, node_idx) AS rank, t_start, node_idx FROM ok QUALIFY rank <= 20
UNION ALL SELECT 'dynamic_good', row_number() OVER (ORDER BY m, -pr, r, t_start, node_idx) AS rank, t_start, node_idx FROM ok WHERE prediction_range > 1e-6 QUALIFY rank <= 20
UNION ALL SELECT 'good_and_dynamic', row_number() OVER (ORDER BY m, r, -pr, t_start, node_idx) AS rank, t_start, node_idx FROM ok WHERE prediction_range > 1e-6 AND target_range > 1e-6 QUALIFY rank <= 20
UNION ALL SELECT 'representative', row_number() OVER (ORDER BY round(abs(mae - mid), 9), -pr, t_start, node_idx) AS rank, t_start, node_idx FROM ok QUALIFY rank <= 20)"""


def _seasonal(fx):
    """The scores that cases are ranked by, computed once: ranks, median and spare cases read them again."""
    scores = ("t_start", "node_idx", "parse_ok", "mae", "rmse", "prediction_range", "target_range")
    return written(fx.scored.where("variant = 'seasonal'").select(*scores), "scores")


@query("case_buckets", "bucket:s rank:i t_start:i node_idx:i", f"WITH {_OK}, {_BUCKETS} SELECT * FROM buckets")
def _(fx):
    return select.case_buckets(_seasonal(fx))


@query(
    "curated_cases",
    "t_start:i node_idx:i source:s priority:i",
    f"""
WITH {_OK}, {_BUCKETS}, tagged AS (SELECT t_start, node_idx, min(CASE bucket WHEN 'best' THEN rank - 1 WHEN 'dynamic_good' THEN rank + 3 WHEN 'good_and_dynamic' THEN rank + 9 ELSE rank + 15 END) AS priority
  FROM buckets WHERE rank <= CASE bucket WHEN 'best' THEN 4 WHEN 'representative' THEN 3 ELSE 6 END GROUP BY ALL)
SELECT t_start, node_idx, source, priority FROM (
  SELECT t_start, node_idx, 'tagged' AS source, priority, 0 AS a, 0 AS b, 0 AS c FROM tagged
  UNION ALL SELECT t_start, node_idx, 'fallback', 1000000, m, -pr, -tr FROM ok WHERE NOT EXISTS (SELECT 1 FROM tagged t WHERE t.t_start = ok.t_start AND t.node_idx = ok.node_idx))
ORDER BY priority, a, b, c, t_start, node_idx LIMIT 20""",
)
def _(fx):
    s = _seasonal(fx)
    return select.curated_cases(s, select.case_buckets(s))


_CASES = """base AS MATERIALIZED (SELECT domain, node_idx, t_start - 12 AS win, round(full_advantage, 9) AS adv FROM paired),
tops AS MATERIALIZED (SELECT domain, node_idx, best, row_number() OVER (PARTITION BY domain ORDER BY m DESC, node_idx DESC) AS rank FROM (
  SELECT domain, node_idx, round(avg(adv), 9) AS m, first(win ORDER BY adv DESC, win) AS best FROM base GROUP BY ALL) QUALIFY rank <= 3),
anchors AS (SELECT domain, first(win ORDER BY m DESC, win DESC) AS anchor FROM (SELECT domain, win, round(avg(adv), 9) AS m FROM base CROSS JOIN ev_days WHERE win + 12 <= n * 4 - 18 GROUP BY ALL) GROUP BY domain),
cases AS (SELECT domain, 'single' AS kind, node_idx, best AS win FROM tops UNION ALL SELECT domain, 'collage', node_idx, anchor + unnest([0, 6, 12]) FROM tops JOIN anchors USING (domain))"""


def _cases(fx):
    return select.window_case_select(fx.paired, (fx.n_steps - 18).cast("long"))


@query("window_case_select", "domain:s kind:s node_idx:i win:i", f"WITH {_CASES} SELECT * FROM cases")
def _(fx):
    return _cases(fx)


@query(
    "case_union",
    "domain:s node_idx:i t_start:i target_ts:t hist_last:f y_sum:f",
    f"WITH {_CASES} SELECT domain, w.node_idx, t_start, target_ts, x_hist[12] AS hist_last, list_sum(y) AS y_sum FROM (SELECT DISTINCT domain, node_idx, win FROM cases) c JOIN windows w ON w.node_idx = c.node_idx AND w.t_start = c.win + 12",
)
def _(fx):
    from wattline.functions.arrays import asum

    out = select.case_union(_cases(fx), fx.windows)
    return out.withColumn("hist_last", F.col("x_hist")[11]).withColumn("y_sum", asum(F.col("y")))


@query(
    "best_gap_segment",
    "node_idx:i start:i mean_gap:f",
    """
SELECT node_idx, first(step ORDER BY g DESC, step) AS start, max(g) AS mean_gap FROM (
  SELECT node_idx, step, round(avg(abs(full_p - other_p)) OVER w, 9) AS g, count(*) OVER w AS n FROM step_pairs WINDOW w AS (PARTITION BY node_idx ORDER BY step ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
WHERE n = 12 AND g IS NOT NULL GROUP BY node_idx""",
)
def _(fx):
    return select.best_gap_segment(fx.step_pairs, ["node_idx"], "step", "full", "other", 12)


@query("nonoverlap_clips", "domain:s node_idx:i start:i gain:f")
def _(fx):
    return select.nonoverlap_clips(fx.step_pairs, ["domain", "node_idx"], "step", "truth", "full", "other")


@query(
    "dynamic_nodes",
    "zone_type:s node_idx:i value_range:f rank:i",
    """SELECT zone_type, node_idx, r AS value_range, row_number() OVER (PARTITION BY zone_type ORDER BY r DESC, node_idx) AS rank FROM (
  SELECT node_idx, max(value) - min(value) AS r FROM load_fill CROSS JOIN ev_days WHERE t_idx >= floor(n * 4 * CAST(0.8 AS DOUBLE)) GROUP BY node_idx) JOIN user_nodes USING (node_idx) QUALIFY rank <= 3""",
)
def _(fx):
    return select.dynamic_nodes(fx.load_fill.where(F.col("t_idx") >= F.floor(fx.n_steps * 0.8)), fx.user_nodes)


@query(
    "profile_nodes",
    "section:s name:s value:f",
    """
WITH o AS (SELECT count(DISTINCT t_idx)::DOUBLE AS steps, count(DISTINCT node_idx)::DOUBLE AS nodes, avg(CAST(value IS NULL AS DOUBLE)) AS missing, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std FROM load_raw),
m AS MATERIALIZED (SELECT node_idx, avg(value) AS v FROM load_raw GROUP BY node_idx)
SELECT 'overall' AS section, name, value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'zone', zone_type, count(*) FROM user_nodes GROUP BY zone_type
UNION ALL SELECT 'graph', 'density', (SELECT count(*) FROM user_edges) / power((SELECT count(*) FROM user_nodes), 2)
UNION ALL (SELECT 'top', CAST(node_idx AS VARCHAR), v FROM m ORDER BY v DESC, node_idx LIMIT 5)
UNION ALL (SELECT 'bottom', CAST(node_idx AS VARCHAR), v FROM m ORDER BY v, node_idx LIMIT 5)""",
)
def _(fx):
    return select.profile_nodes(fx.load_raw, fx.user_nodes, fx.user_edges)


# --- calibration ---
VAL, TEST = "day_idx BETWEEN 7 AND 23", "day_idx >= 24"


def _score_sql(src: str, pred: str, keys: str, by: str) -> str:
    return f"""SELECT {by}, avg(greatest(0.0, 1 - e)) AS score, avg(mae) AS mae FROM (
  SELECT {keys}, day, avg(abs({pred} - target) / greatest(abs(target), {PRICE_FLOOR})) AS e, avg(abs({pred} - target)) AS mae FROM {src} GROUP BY {keys}, day) GROUP BY {by}"""


def _blend_error(i: int) -> str:
    w = f"({i} / 10.0::DOUBLE)"
    return f"avg(abs({w} * prediction_base + (1 - {w}) * prediction_seq - target) / greatest(abs(target), {PRICE_FLOOR})) AS e{i}"


@query(
    "blend_search",
    "series:s day:d slot:i weight:f score:f prediction:f target:f",
    f"""
WITH d AS MATERIALIZED (SELECT series, day, {", ".join(_blend_error(i) for i in range(11))} FROM pair_table WHERE {VAL} GROUP BY series, day),
best AS (SELECT series, weight, score FROM ({" UNION ALL ".join(f"SELECT series, {i} / 10.0::DOUBLE AS weight, avg(greatest(0.0, 1 - e{i})) AS score FROM d GROUP BY series" for i in range(11))}) QUALIFY row_number() OVER (PARTITION BY series ORDER BY score DESC, weight) = 1)
SELECT series, day, slot, weight, score, weight * prediction_base + (1 - weight) * prediction_seq AS prediction, target FROM pair_table JOIN best USING (series) WHERE {TEST}""",
)
def _(fx):
    best = calibrate.blend_search(fx.pair_table.where(VAL), floor=PRICE_FLOOR)
    return fx.pair_table.where(TEST).join(best, "series").withColumn("prediction", calibrate.blend(F.col("weight")))


@query(
    "slot_offset_learn",
    "series:s slot_group:i offset_value:f",
    f"SELECT series, slot // 4 AS slot_group, least(greatest(avg(target - prediction), -120.0), 120.0) AS offset_value FROM pred_a WHERE {VAL} GROUP BY ALL",
)
def _(fx):
    return calibrate.slot_offsets(fx.pred_a.where(VAL), 4, 120.0).withColumnRenamed("offset", "offset_value")


@query(
    "slot_offset_apply",
    "series:s day:d slot:i slot_group:i point_offset:f candidate_prediction:f prediction:f residual:f calibrated_error:f",
    f"""
WITH o AS (SELECT series, slot // 4 AS slot_group, least(greatest(avg(target - prediction), -120.0), 120.0) AS off FROM pred_a WHERE {VAL} GROUP BY ALL)
SELECT *, target - candidate_prediction AS residual, prediction - target AS calibrated_error FROM (
  SELECT p.series, day, slot, slot // 4 AS slot_group, coalesce(off, 0) * 0.5 AS point_offset, p.prediction AS candidate_prediction, least(greatest(p.prediction + coalesce(off, 0) * 0.5, 5.0), 200.0) AS prediction, target
  FROM pred_a p LEFT JOIN o ON o.series = p.series AND o.slot_group = slot // 4 WHERE {TEST})""",
)
def _(fx):
    offsets = calibrate.slot_offsets(fx.pred_a.where(VAL), 4, 120.0)
    return calibrate.apply_slot_offsets(fx.pred_a.where(TEST), offsets, F.lit(4), F.lit(0.5), PRICE_FLOOR, PRICE_CAP)


GROUPS, SHRINKS = (1, 2, 4, 8, 16, 32, 96), (0.25, 0.5, 0.75, 1.0)


@query(
    "slot_offset_search",
    "series:s group_size:i shrink:f score:f mae:f rank:i",
    f"""
WITH v AS MATERIALIZED (SELECT series, day, slot, prediction, target, g AS group_size FROM pred_a CROSS JOIN (SELECT unnest([{", ".join(map(str, GROUPS))}]) AS g) WHERE {VAL}),
o AS MATERIALIZED (SELECT series, group_size, slot // group_size AS sg, least(greatest(avg(target - prediction), -120.0), 120.0) AS off FROM v GROUP BY ALL),
p AS MATERIALIZED (SELECT v.series, v.day, v.group_size, shrink, target, least(greatest(prediction + off * shrink, 5.0), 200.0) AS b
  FROM v JOIN o ON o.series = v.series AND o.group_size = v.group_size AND o.sg = slot // v.group_size CROSS JOIN (SELECT unnest([{", ".join(map(str, SHRINKS))}])::DOUBLE AS shrink))
SELECT *, row_number() OVER (PARTITION BY series ORDER BY score DESC, mae, group_size, shrink) AS rank FROM ({_score_sql('p', 'b', 'series, group_size, shrink', 'series, group_size, shrink')})""",
)
def _(fx):
    return calibrate.slot_offset_search(fx.pred_a.where(VAL), GROUPS, SHRINKS, 120.0, PRICE_FLOOR, PRICE_CAP)


_EDGES = ", ".join(f"quantile_cont(off_true, {i / 5}) AS e{i}" for i in range(6))
_BIN = "CAST(off_true >= e1 AS INT) + CAST(off_true >= e2 AS INT) + CAST(off_true >= e3 AS INT) + CAST(off_true >= e4 AS INT)"
_BINS_SQL = f"""q AS MATERIALIZED (SELECT {_EDGES} FROM offsets WHERE day_idx < 20),
bins AS MATERIALIZED (SELECT b AS bin, lo, hi, coalesce(center, (lo + hi) / 2) AS center FROM (SELECT unnest(range(5)) AS b, unnest([e0, e1, e2, e3, e4]) AS lo, unnest([e1, e2, e3, e4, e5]) AS hi FROM q)
  LEFT JOIN (SELECT {_BIN} AS b, avg(off_true) AS center FROM offsets CROSS JOIN q WHERE day_idx < 20 GROUP BY 1) c USING (b)),
assigned AS (SELECT series, day, day_idx, {_BIN} AS bin FROM offsets CROSS JOIN q)"""


@query("offset_bins", "bin:i lo:f hi:f center:f test_rows:i",
       f"WITH {_BINS_SQL} SELECT bin, lo, hi, center, (SELECT count(*) FROM assigned a WHERE a.bin = bins.bin AND day_idx >= 20) AS test_rows FROM bins")
def _(fx):
    bins = calibrate.fit_offset_bins(fx.offsets.where("day_idx < 20"), "off_true", 5)
    counts = _assigned(fx, bins).where("day_idx >= 20").groupBy("bin").agg(F.count(F.lit(1)).alias("test_rows"))
    return bins.join(counts, "bin", "left").fillna(0, ["test_rows"])


def _assigned(fx, bins):
    edges = bins.agg(F.sort_array(F.collect_list("lo"))).scalar()
    top = bins.agg(F.max("hi")).scalar()
    rows = fx.offsets.withColumn("_e", F.concat(edges, F.array(top)))
    return rows.withColumn("bin", calibrate.assign_bin(F.col("off_true"), F.col("_e"), 5)).drop("_e")


@query(
    "apply_offset",
    "series:s day:d slot:i by_offset:f by_bin:f",
    f"""
WITH {_BINS_SQL} SELECT p.series, p.day, p.slot, least(greatest(p.prediction + least(greatest(o.off_pred, -0.2), 0.2) * 500, 5.0), 200.0) AS by_offset,
  least(greatest(p.prediction + least(greatest(b.center, -0.2), 0.2) * 500, 5.0), 200.0) AS by_bin
FROM pred_a p JOIN offsets o ON o.series = p.series AND o.day = p.day JOIN assigned a ON a.series = p.series AND a.day = p.day JOIN bins b ON b.bin = a.bin""",
)
def _(fx):
    bins = calibrate.fit_offset_bins(fx.offsets.where("day_idx < 20"), "off_true", 5)
    days = _assigned(fx, bins).join(bins.select("bin", "center"), "bin").select("series", "day", "off_pred", "center")
    rows = fx.pred_a.join(days, ["series", "day"])
    apply = lambda c: calibrate.apply_day_offset(F.col("prediction"), F.col(c), 0.2, 500.0, PRICE_FLOOR, PRICE_CAP)
    return rows.select("series", "day", "slot", apply("off_pred").alias("by_offset"), apply("center").alias("by_bin"))


@query(
    "linear_calibration",
    "series:s day:d slope:f intercept:f calibrated:f",
    """SELECT series, day, s AS slope, i AS intercept, s * off_pred + i AS calibrated FROM offsets CROSS JOIN (SELECT regr_slope(off_true, off_pred) AS s, regr_intercept(off_true, off_pred) AS i FROM offsets WHERE day_idx < 20) WHERE day_idx >= 20""",
)
def _(fx):
    return calibrate.linear_calibration(fx.offsets.where("day_idx < 20"), fx.offsets.where("day_idx >= 20"), "off_pred", "off_true")


_REGIME = "CASE WHEN slot >= 78 OR slot <= 17 THEN 'floor' WHEN slot <= 39 THEN 'solar' WHEN slot <= 65 THEN 'mid' ELSE 'evening' END"


@query("regime_tag", "series:s pos:i regime:s", f"SELECT series, pos, {_REGIME} AS regime FROM market")
def _(fx):
    return fx.market.select("series", "pos", calibrate.regime_tag(F.col("slot")).alias("regime"))


_PROBS = f"SELECT series, day, day_idx, slot, {_REGIME} AS regime, prediction_base AS prediction, target, 50 / (50 + prediction_seq) AS fp, prediction_seq / (prediction_seq + 150) AS pp FROM pair_table"


def _with_probabilities(fx):
    """Stand-in class probabilities from the second forecast: low means floor, high means peak."""
    s = F.col("prediction_seq")
    return fx.pair_table.select(
        "series", "day", "day_idx", "slot", calibrate.regime_tag(F.col("slot")).alias("regime"), F.col("prediction_base").alias("prediction"), "target",
        (50 / (50 + s)).alias("floor_p"), (s / (s + 150)).alias("peak_p"),
    )


def _two(f: str, p: str) -> str:
    return f"CASE WHEN fp >= {f} THEN 5.0 WHEN pp >= {p} THEN 200.0 ELSE least(greatest(prediction, 5.0), 200.0) END"


@query("two_stage_rules", "series:s day:d slot:i final:f", f"SELECT series, day, slot, {_two('0.5', '0.6')} AS final FROM ({_PROBS})")
def _(fx):
    rows = _with_probabilities(fx)
    final = calibrate.two_stage(F.col("prediction"), F.col("floor_p"), F.col("peak_p"), 0.5, 0.6, PRICE_FLOOR, PRICE_CAP)
    return rows.withColumn("final", final)


FLOORS, PEAKS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8), (0.2, 0.3, 0.4, 0.5, 0.6)


@query(
    "threshold_search",
    "regime:s floor_at:f peak_at:f score:f",
    f"""
WITH g AS MATERIALIZED (SELECT *, {_two('fa', 'pa')} AS b FROM ({_PROBS}) CROSS JOIN (SELECT unnest({list(FLOORS)})::DOUBLE AS fa) CROSS JOIN (SELECT unnest({list(PEAKS)})::DOUBLE AS pa) WHERE {VAL})
SELECT regime, fa AS floor_at, pa AS peak_at, score FROM ({_score_sql('g', 'b', 'regime, fa, pa, series', 'regime, fa, pa')}) QUALIFY row_number() OVER (PARTITION BY regime ORDER BY score DESC, fa, pa) = 1""",
)
def _(fx):
    return calibrate.threshold_search(_with_probabilities(fx).where(VAL), FLOORS, PEAKS, PRICE_FLOOR, PRICE_CAP)


@query("persistence_forecast", "series:s day:d slot:i day_before:f week_before:f",
       "SELECT series, day, slot, lag_a AS day_before, lag_b AS week_before FROM pred_both WHERE lag_b IS NOT NULL")
def _(fx):
    return fx.pred_both.where("lag_b is not null").select("series", "day", "slot", F.col("lag_a").alias("day_before"), F.col("lag_b").alias("week_before"))


@query(
    "persistence_scores",
    "series:s day:d mae:f rmse:f relative_accuracy:f daily_mean_accuracy:f peak_slot_hit:i",
    "SELECT series, day, mae, rmse, relative_accuracy, daily_mean_accuracy, peak_slot_hit FROM days_a",
)
def _(fx):
    return metrics.day_metrics(fx.pred_a, floor=PRICE_FLOOR, cap=PRICE_CAP)
