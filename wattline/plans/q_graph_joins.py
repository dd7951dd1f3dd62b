"""Queries: graphs and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.operators import graph, joins, metrics
from wattline.plans.fixtures_sql import day_metrics_sql
from wattline.plans.registry import query
from wattline.sources.fixtures import PRICE_CAP, PRICE_FLOOR

_TOP3 = "SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM user_edges WHERE src <> dst QUALIFY rank <= 3"


@query(
    "corr_graph",
    "src:s dst:s weight:f",
    """
WITH train AS MATERIALIZED (SELECT node_id, t_idx, value FROM daily_fill WHERE t_idx < floor((SELECT count(DISTINCT t_idx) FROM daily_raw) * CAST(0.6 AS DOUBLE)))
SELECT a.node_id AS src, b.node_id AS dst, abs(corr(a.value, b.value)) AS weight FROM train a JOIN train b ON a.t_idx = b.t_idx AND a.node_id <> b.node_id GROUP BY ALL
HAVING abs(corr(a.value, b.value)) > 0""",
)
def _(fx):
    cut = F.floor((fx.daily_raw.agg(F.max("t_idx")).scalar() + 1) * 0.6)
    return graph.corr_graph(fx.daily_fill.where(F.col("t_idx") < cut), "node_id", "t_idx", "value")


@query(
    "corr_topk",
    "src:s rank:i weight:f",
    """
WITH train AS MATERIALIZED (SELECT node_id, t_idx, value FROM daily_fill WHERE t_idx < floor((SELECT count(DISTINCT t_idx) FROM daily_raw) * CAST(0.6 AS DOUBLE)))
SELECT src, rank, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC) AS rank FROM (
  SELECT a.node_id AS src, b.node_id AS dst, abs(corr(a.value, b.value)) AS weight FROM train a JOIN train b ON a.t_idx = b.t_idx AND a.node_id <> b.node_id GROUP BY ALL)) WHERE rank <= 4""",
)
def _(fx):
    cut = F.floor((fx.daily_raw.agg(F.max("t_idx")).scalar() + 1) * 0.6)
    return graph.corr_topk(fx.daily_fill.where(F.col("t_idx") < cut), "node_id", "t_idx", "value", 4)


@query("topk_neighbours", "src:i dst:i weight:f rank:i", _TOP3)
def _(fx):
    return graph.topk_neighbours(fx.user_edges, 3)


@query(
    "neighbour_mean",
    "node_idx:i t_idx:i nbr:f",
    f"""
WITH top AS ({_TOP3}), cut AS (SELECT * FROM top WHERE src % 7 <> 3),
m AS (SELECT e.src AS node_idx, t_idx, sum(weight * value) / (any_value(total) + 1e-8) AS nbr
  FROM (SELECT *, sum(weight) OVER (PARTITION BY src) AS total FROM cut) e JOIN load_norm l ON l.node_idx = e.dst GROUP BY e.src, t_idx)
SELECT node_idx, t_idx, coalesce(nbr, 0) AS nbr FROM load_norm LEFT JOIN m USING (node_idx, t_idx)""",
)
def _(fx):
    # every seventh node's edges become self loops, which leaves it without neighbours
    edges = graph.topk_neighbours(fx.user_edges, 3).withColumn("dst", F.when(F.col("src") % 7 == 3, F.col("src")).otherwise(F.col("dst")))
    return graph.neighbour_mean(edges, fx.load_norm, "node_idx", "t_idx", "value")


@query("mask_nodes", "node_idx:i t_idx:i value:f",
       "SELECT l.node_idx, t_idx, CASE WHEN zone_type = 'CBD' THEN value ELSE 0.0 END AS value FROM load_norm l JOIN user_nodes USING (node_idx)")
def _(fx):
    return graph.mask_nodes(fx.load_norm, fx.user_nodes.where("zone_type = 'CBD'"), "node_idx", "value")


@query(
    "mask_nodes_edges",
    "src:i dst:i weight:f",
    "SELECT e.* FROM user_edges e WHERE src IN (SELECT node_idx FROM user_nodes WHERE zone_type = 'CBD') AND dst IN (SELECT node_idx FROM user_nodes WHERE zone_type = 'CBD')",
)
def _(fx):
    return graph.mask_edges(fx.user_edges, fx.user_nodes.where("zone_type = 'CBD'"), "node_idx")


@query(
    "lookup_history_end",
    "t_start:i node_idx:i temperature:f humidity:f",
    """
WITH fr AS (SELECT * REPLACE (CASE WHEN temperature > 25.5 THEN ts ELSE ts + INTERVAL 1 MINUTE END AS ts), row_number() OVER (ORDER BY ts) - 1 AS r FROM weather)
SELECT t_start, node_idx, coalesce(e.temperature, c.temperature) AS temperature, coalesce(e.humidity, c.humidity) AS humidity
FROM windows LEFT JOIN fr e ON e.ts = history_end_ts LEFT JOIN fr c ON c.r = least(greatest(t_start - 1, 0), (SELECT max(r) FROM fr))""",
)
def _(fx):
    # cool hours are a minute late, so that some windows find no row of their time
    late = F.when(F.col("temperature") > 25.5, F.col("ts")).otherwise(F.col("ts") + F.expr("interval 1 minute"))
    frame = fx.weather.withColumn("ts", late).withColumnRenamed("temperature", "air_temp").withColumnRenamed("humidity", "Humid_pct")
    return joins.lookup_history_end(fx.windows, frame, ["temperature", "humidity"])


@query(
    "price_history_end",
    "t_start:i node_idx:i price:f",
    """
SELECT t_start, w.node_idx, coalesce(p.price, m.price) AS price FROM windows w LEFT JOIN node_price p ON p.ts = history_end_ts AND p.node_idx = w.node_idx
LEFT JOIN (SELECT ts, avg(price) AS price FROM node_price GROUP BY ts) m ON m.ts = history_end_ts""",
)
def _(fx):
    return joins.price_history_end(fx.windows, fx.node_price)


@query(
    "asof_fill_join",
    "event_id:i user_id:i price:f",
    """
WITH b AS (SELECT e.event_id, e.user_id, e.ts, p.price FROM events e ASOF LEFT JOIN node_price p ON p.node_idx = e.user_id AND e.ts >= p.ts)
SELECT b.event_id, b.user_id, coalesce(b.price, p.price) AS price FROM b ASOF LEFT JOIN node_price p ON p.node_idx = b.user_id AND b.ts <= p.ts""",
)
def _(fx):
    left = fx.table("events").select("user_id", "ts", "event_id")
    right = fx.node_price.select(F.col("node_idx").alias("user_id"), "ts", "price")
    return joins.asof_join(left, right, ["user_id"], "ts", ["price"])


@query("merge_weather", "day:d temperature:f humidity:f rain:f",
       "SELECT day, avg(temperature) AS temperature, avg(humidity) AS humidity, max(rain) AS rain FROM feed GROUP BY day")
def _(fx):
    return joins.merge_feeds(fx.feed, "day", ["temperature", "humidity"], ["rain"])


_SIDE = """(SELECT c_nationkey, o_orderdate::DATE AS day, sum(o_totalprice) / 1000 AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = '{0}' GROUP BY ALL)"""


@query(
    "outer_add",
    "c_nationkey:i day:d v:f4",
    f"""SELECT c_nationkey, day, coalesce(a.v, 0) + coalesce(b.v, 0) + coalesce(c.v, 0) AS v FROM {_SIDE.format('O')} a FULL OUTER JOIN {_SIDE.format('F')} b USING (c_nationkey, day)
FULL OUTER JOIN {_SIDE.format('P')} c USING (c_nationkey, day)""",
)
def _(fx):
    paid = fx.table("orders").join(fx.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    def side(status):
        return paid.where(F.col("o_orderstatus") == status).groupBy("c_nationkey", F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1000).alias("v"))
    keys = ["c_nationkey", "day"]
    return joins.outer_add(joins.outer_add(side("O"), side("F"), keys, "v"), side("P"), keys, "v")


@query(
    "attach_candidate",
    "series:s day:d slot:i steps:i first:f last:f total:f",
    """
WITH st AS (SELECT series, day, slot, unnest(range(24)) AS step FROM market),
j AS (SELECT st.*, c.prediction, count(*) OVER (PARTITION BY st.series, st.day, st.slot) AS n FROM st JOIN candidate c
  ON c.series = st.series AND c.slot = (st.slot + step) % 96 AND c.day = CASE WHEN st.slot + step >= 96 THEN st.day + 1 ELSE st.day END)
SELECT series, day, slot, count(*) AS steps, arg_min(prediction, step) AS first, arg_max(prediction, step) AS last, sum(prediction) AS total FROM j WHERE n = 24 GROUP BY ALL""",
)
def _(fx):
    curves = joins.attach_candidate(fx.market.select("series", "day", "slot"), fx.candidate, 24)
    c = F.col("candidate_future")
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return curves.select("series", "day", "slot", F.size(c).alias("steps"), c[0].alias("first"), F.element_at(c, -1).alias("last"), total.alias("total"))


@query(
    "candidate_map",
    "series:s day:d slot:i prediction:f",
    """
SELECT series, day + 1 AS day, slot, coalesce(CASE WHEN lead(day) OVER w = day + 1 AND day_idx + 1 >= 20 THEN lead(lag_b) OVER w END, target) / 500.0 AS prediction
FROM pred_both WINDOW w AS (PARTITION BY series, slot ORDER BY day)""",
)
def _(fx):
    early = fx.pred_a.where("day_idx >= 20").withColumn("arrival", F.lit(0))
    late = fx.pred_b.where("day_idx >= 20").withColumn("arrival", F.lit(1))
    return joins.candidate_map(fx.market, early.unionByName(late), 0.0, 500.0)


@query("pair_predictions", "series:s day:d slot:i prediction_base:f prediction_seq:f target:f",
       "SELECT series, day, slot, CASE WHEN slot < 8 THEN prediction_base + 5 ELSE prediction_base END AS prediction_base, prediction_seq, target FROM pair_table")
def _(fx):
    twice = fx.pred_a.unionByName(fx.pred_a.where("slot < 8").withColumn("prediction", F.col("prediction") + 10))
    return joins.pair_predictions(twice, fx.pred_b)


@query("pair_variants", "t_start:i node_idx:i domain:s variant_gap_mae:f full_mae:f wo_mae:f full_advantage:f", "SELECT * FROM paired")
def _(fx):
    return fx.paired


_CM = "mae rmse daily_mean_accuracy relative_accuracy".split()
@query(
    "compare_candidate_model",
    "series:s day:d " + " ".join(f"{t}_{m}:f" for t in ("candidate", "model") for m in _CM),
    f"""
SELECT series, day, {", ".join(f"{t}.{m} AS {t}_{m}" for t in ("candidate_d", "model_d") for m in _CM).replace("candidate_d_", "candidate_").replace("model_d_", "model_")}
FROM days_a candidate_d JOIN ({day_metrics_sql("pred_b", "prediction", PRICE_FLOOR, PRICE_CAP)}) model_d USING (series, day)""",
)
def _(fx):
    out = None
    for tag, pred in (("candidate", fx.pred_a), ("model", fx.pred_b)):
        d = metrics.day_metrics(pred, floor=PRICE_FLOOR, cap=PRICE_CAP).select("series", "day", *[F.col(m).alias(f"{tag}_{m}") for m in _CM])
        out = d if out is None else out.join(d, ["series", "day"])
    return out
