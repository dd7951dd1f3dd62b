"""Queries: scans, sinks, manifests and the boosted-tree model."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.calendar import weekday0
from wattline.operators import calibrate, graph, models, retrieval, splits, windows
from wattline.plans.registry import query
from wattline.sources import readers, sinks
from wattline.sources.fixtures import EXOG, PRICE_CAP, PRICE_FLOOR


@query("scan_csv", "event_id:i label:s value:f",
       "SELECT event_id, CASE event_type WHEN 'click' THEN '电价' WHEN 'view' THEN '负荷' ELSE event_type END AS label, value FROM events")
def _(fx):
    spark, kind = fx.spark, F.col("event_type")
    rows = fx.table("events").select(F.col("event_id").alias(" event_id "), F.when(kind == "click", "电价").when(kind == "view", "负荷").otherwise(kind).alias("label"), "value")
    path = sinks.scratch(spark, "csv")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # for the writer alone
    for k, encoding in enumerate(("UTF-8", "GBK", "GB18030")):
        part = rows.where(F.col(" event_id ") % 3 == k)
        part = part.select("value", " event_id ", "label") if k == 2 else part
        part.write.option("header", "true").option("encoding", encoding).csv(f"{path}/{k}")
    spark.conf.unset("spark.sql.legacy.javaCharsets")
    return readers.scan_csv(spark, path)


@query(
    "scan_wide_matrix",
    "node_id:s ts:t value:f",
    "SELECT series AS node_id, ts, price + CASE WHEN slot % 2 = 0 THEN 1 ELSE 0 END AS value FROM market",
)
def _(fx):
    wide = fx.market.groupBy("ts", "slot").pivot("series").agg(F.first("price"))
    names = [c for c in wide.columns if c not in ("ts", "slot")]
    slash = F.date_format("ts", "yyyy/M/d H:mm")
    text = wide.withColumn("ts", F.when(F.col("slot") % 3 == 0, slash).when(F.col("slot") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    again = text.where("slot % 2 = 0").select("ts", "slot", *[(F.col(n) + 2).alias(n) for n in names])
    broken = text.where("slot = 0").withColumn("ts", F.lit("n/a"))
    path = sinks.scratch(fx.spark, "wide")
    text.unionByName(again).unionByName(broken).drop("slot").write.option("header", "true").csv(path)
    return readers.scan_wide_matrix(fx.spark, path).where("value is not null")


@query("scan_time_parts", "ts:t temperature:f", "SELECT ts, temperature FROM axis_weather")
def _(fx):
    axis = fx.axis_weather
    base = sinks.scratch(fx.spark, "parts")
    sinks.write_time_parts(axis.select("ts"), "ts", f"{base}/time", files=3)
    values = axis.repartitionByRange(2, "ts").sortWithinPartitions("ts").select("temperature")
    values.write.option("header", "true").csv(f"{base}/values")
    return readers.scan_time_parts(fx.spark, f"{base}/time", f"{base}/values")


@query("scan_station_dir", "station:s capacity:f rows:i power:f2",
       "SELECT station, (n_nationkey + 1) * 10 AS capacity, count(*) AS rows, sum(power) AS power FROM stations JOIN nation ON n_name = station GROUP BY ALL")
def _(fx):
    size = fx.table("nation").select(F.col("n_name").alias("station"), ((F.col("n_nationkey") + 1) * 10).alias("mw"))
    rows = fx.stations.join(size, "station").withColumn("file", F.concat(F.lit("x (Nominal capacity-"), "mw", F.lit("MW)"))).drop("mw")
    path = sinks.scratch(fx.spark, "stations")
    both = rows.unionByName(rows.where("power > 1000000"))
    both.write.partitionBy("station", "file").option("header", "true").csv(path)
    got = readers.scan_station_dir(fx.spark, path, "day", "power")
    return got.groupBy("station", "capacity").agg(F.count(F.lit(1)).alias("rows"), F.sum("power").alias("power"))


@query("header_synonyms", "timestamp:t global_horizontal_irradiance:f wind_speed_50m:f temperature:f power_mw:f",
       "SELECT l_shipdate AS timestamp, l_tax AS global_horizontal_irradiance, l_discount AS wind_speed_50m, l_quantity AS temperature, l_extendedprice AS power_mw FROM lineitem")
def _(fx):
    raw = fx.table("lineitem").select(
        F.col("l_shipdate").alias("Time(year-month-day h:m:s)"), F.col("l_tax").alias("Global horicontal irradiance (W/m2)"),
        F.col("l_discount").alias("Wind speed at height of 50 meters (m/s)"), F.col("l_quantity").alias("Air temperature  (C)"), F.col("l_extendedprice").alias("Power (MW)"),
    )
    return readers.canonical_headers(raw)


@query("scan_records_json", "variant:s t_start:i node_idx:i parse_ok:i y_sum:f",
       "SELECT variant, t_start, node_idx, CAST(parse_ok AS INT) AS parse_ok, list_sum(target) AS y_sum FROM records")
def _(fx):
    # one document per variant, window and part of the nodes, so that none is as long as the graph is wide
    nested = fx.records.groupBy("variant", "t_start", F.floor(F.col("node_idx") / 4096)).agg(
        F.collect_list(F.struct("t_start", "node_idx", "domain", "parse_ok", F.col("pred").alias("parsed_prediction"), "target")).alias("records")
    )
    path = sinks.scratch(fx.spark, "records")
    nested.select("variant", "records").write.json(path, compression="lz4")
    got = readers.scan_records_json(fx.spark, path)
    return got.withColumn("y_sum", F.aggregate("target", F.lit(0.0), lambda a, x: a + x))


@query(
    "scan_split_json",
    "split:s ordinal:i t_idx:i",
    """SELECT split, row_number() OVER (PARTITION BY split ORDER BY t_idx) - 1 AS ordinal, t_idx FROM (
  SELECT DISTINCT t_idx, CASE WHEN isodow(ts) >= 6 THEN 'test' WHEN isodow(ts) = 1 THEN 'val' ELSE 'train' END AS split FROM load_raw)""",
)
def _(fx):
    wd = weekday0(F.col("ts"))
    axis = fx.load_raw.select("t_idx", F.when(wd >= 5, "test").when(wd == 0, "val").otherwise("train").alias("split")).distinct()
    lists = axis.agg(*[F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("t_idx")))).alias(s) for s in ("train", "val", "test")])
    path = sinks.scratch(fx.spark, "splits")
    lists.write.json(path)
    return readers.scan_split_json(fx.spark, path)


@query("scan_candidate", "series:s day:d slot:i prediction:f", "SELECT series, day, slot, prediction FROM candidate")
def _(fx):
    path = sinks.scratch(fx.spark, "candidate")
    fx.candidate.write.option("header", "true").csv(path)
    return readers.scan_candidate(fx.spark, path)


@query(
    "scan_adjacency",
    "form:s src:s dst:s weight:f",
    """
SELECT 'list' AS form, e.src::VARCHAR AS src, e.dst::VARCHAR AS dst, weight FROM user_edges e WHERE src IN (SELECT node_idx FROM user_nodes WHERE zone_type = 'CBD') AND dst IN (SELECT node_idx FROM user_nodes WHERE zone_type = 'CBD')
UNION ALL SELECT 'square', a.n_name, b.n_name, count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON b.n_nationkey = o_orderkey % 25 GROUP BY ALL
UNION ALL SELECT 'identity', n_name, n_name, 1 FROM nation""",
)
def _(fx):
    cbd = fx.user_nodes.where("zone_type = 'CBD'").select(F.col("node_idx").alias("node_id"))
    nation = fx.table("nation").select("n_nationkey", F.col("n_name").alias("node_id"))
    flow = fx.table("orders").join(fx.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    to = nation.select((F.col("n_nationkey")).alias("_to"), F.col("node_id").alias("to"))
    square = flow.withColumn("_to", F.col("o_orderkey") % 25).join(to, "_to").groupBy("node_id").pivot("to").count()
    forms = {"list": graph.scan_adjacency(cbd, edge_list=fx.user_edges), "square": graph.scan_adjacency(nation, square=square), "identity": graph.scan_adjacency(nation)}
    out = None
    for form, edges in forms.items():
        rows = edges.withColumn("form", F.lit(form))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("sink_dataset", "node_idx:i rows:i value:f", "SELECT node_idx, count(*) AS rows, sum(value) AS value FROM load_norm GROUP BY node_idx")
def _(fx):
    path = sinks.scratch(fx.spark, "dataset")
    month = fx.load_norm.withColumn("month", F.date_format("ts", "yyyy-MM"))
    sinks.sink_dataset({"obs": month, "nodes": fx.user_nodes, "edges": fx.user_edges}, path, {"obs": ["month"]}, {"history": 12, "horizon": 6, "stride": 1})
    sinks.verify_manifest(fx.spark.read.schema("history string, horizon string, stride string, digest string").json(f"{path}/manifest"), ["history", "horizon", "stride"]).count()
    return fx.spark.read.parquet(f"{path}/obs").groupBy("node_idx").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value"))


@query("sink_windows", "reused:i node_idx:i windows_seen:i", "SELECT 1 AS reused, node_idx, count(*) AS windows_seen FROM windows GROUP BY node_idx")
def _(fx):
    path, parameters = sinks.scratch(fx.spark, "windows"), {"history": 12, "horizon": 6, "stride": 1}
    sinks.load_or_build(fx.spark, path, {**parameters, "stride": 2}, lambda: fx.windows.where("t_start % 2 = 0"))
    sinks.load_or_build(fx.spark, path, parameters, lambda: fx.windows)
    stored, reused = sinks.load_or_build(fx.spark, path, parameters, lambda: fx.windows)
    return stored.groupBy("node_idx").agg(F.count(F.lit(1)).alias("windows_seen")).withColumn("reused", F.lit(int(reused)))


@query("sink_retrieval", "q_id:i p_id:i rank:i",
       """SELECT q_id, p_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, p_id) AS rank FROM (SELECT q.vec_id AS q_id, p.vec_id AS p_id,
  round(power(list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 2), 6) AS dist FROM embeddings q JOIN embeddings p ON p.vec_id < q.vec_id)) WHERE rank <= 2""")
def _(fx):
    path = sinks.scratch(fx.spark, "retrieval")
    made = {"k": 2, "strictly_before": True}
    sinks.sink_retrieval(retrieval.knn(fx.vectors, fx.vectors, 2, strictly_before=True), path, per_file=200, parameters=made)
    return sinks.scan_retrieval(fx.spark, path, made)


@query(
    "manifest_hash",
    "node_idx:i digest:s",
    "SELECT node_idx, sha256(to_json({'label': label, 'node_id': node_id, 'windows': w})) AS digest FROM (SELECT node_idx, node_id, zone_type AS label, count(*) AS w FROM windows JOIN user_nodes USING (node_idx) GROUP BY ALL)",
)
def _(fx):
    rows = fx.windows.select("node_idx").join(fx.user_nodes, "node_idx").groupBy("node_idx", "node_id", F.col("zone_type").alias("label")).agg(F.count(F.lit(1)).alias("windows"))
    made = rows.withColumn("digest", sinks.manifest_hash("windows", "label", "node_id"))
    return sinks.verify_manifest(made, ["label", "node_id", "windows"])


@query("sink_report", "source:s event_type:s n:i total:f2",
       "SELECT 'csv' AS source, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type UNION ALL SELECT 'log', event_type, 2 * count(*), 2 * sum(value) FROM events GROUP BY event_type")
def _(fx):
    path = sinks.scratch(fx.spark, "report")
    table = fx.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    sinks.sink_report(table, path)
    sinks.sink_report(table, path)
    schema = "event_type string, n bigint, total double"
    log = fx.spark.read.schema(schema).json(f"{path}/log").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("source", F.lit("log"))
    return fx.spark.read.schema(schema).option("header", "true").csv(f"{path}/csv").withColumn("source", F.lit("csv")).unionByName(log)


@query("regime_gbt", "series:s day:d slot:i regime:s prediction:f floor_p:f peak_p:f final:f")
def _(fx):
    rows = windows.day_point_features(fx.market, EXOG)
    days = splits.split_days(rows.select("series", "day").distinct(), ["series"], "day", 0.7, 0.15)
    rows = rows.join(days, ["series", "day"]).withColumn("regime", calibrate.regime_tag(F.col("slot")))
    columns = [c for c in rows.columns if c not in ("series", "day", "regime", "split", "target_price")]
    out, _ = models.regime_gbt(rows, columns, 50.0, 150.0)
    final = calibrate.two_stage(F.col("prediction"), F.col("floor_p"), F.col("peak_p"), 0.5, 0.5, PRICE_FLOOR, PRICE_CAP)
    return out.withColumn("final", final)


