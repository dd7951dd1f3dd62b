"""Queries: retrieval and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.nodes import expert_label
from wattline.operators import graph, retrieval, routing, splits, windows
from wattline.plans.fixtures_sql import vectors_sql
from wattline.plans.registry import query

for _key, _version in (("vec_legacy", "legacy"), ("vec_shape", "shape"), ("vec_context", "context")):

    @query(
        _key,
        "t_start:i i:i v:f",
        f"SELECT t_start, row_number() OVER (PARTITION BY t_start ORDER BY part, idx) - 1 AS i, v FROM ({vectors_sql(_version)})",
    )
    def _(fx, _version=_version):
        return retrieval.numbered_vectors(fx.vector_parts(_version))


def _knn_sql(k: int, condition: str, extra: str = "") -> str:
    return f"""
SELECT {extra} q_id, p_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, p_id) AS rank FROM (
  SELECT q.vec_id AS q_id, p.vec_id AS p_id, q.label AS expert, round(power(list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 2), 6) AS dist
  FROM embeddings q JOIN embeddings p ON {condition})) WHERE rank <= {k}"""


_KNN = "q_id:i p_id:i dist:f5 rank:i"


@query("knn_topk", _KNN, _knn_sql(5, "q.label >= 5 AND p.label < 5"))
def _(fx):
    return retrieval.knn(fx.vectors.where("label >= 5"), fx.vectors.where("label < 5"), 5)


@query(
    "knn_windows",
    _KNN,
    f"""WITH v AS MATERIALIZED (SELECT t_start, part, idx, v FROM ({vectors_sql('shape')}))
SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, p_id) AS rank FROM (SELECT q.t_start AS q_id, p.t_start AS p_id, round(sum((q.v - p.v) * (q.v - p.v)), 6) AS dist
FROM v q JOIN v p ON q.part = p.part AND q.idx = p.idx AND p.t_start < q.t_start GROUP BY ALL) QUALIFY rank <= 3""",
)
def _(fx):
    parts = fx.vector_parts("shape").withColumnRenamed("t_start", "id")
    return retrieval.knn_long(parts, parts, 3, strictly_before=True)


@query("knn_asof_join", _KNN, _knn_sql(3, "p.vec_id < q.vec_id"))
def _(fx):
    return retrieval.knn(fx.vectors, fx.vectors, 3, strictly_before=True)


@query("knn_blocked_merge", _KNN, _knn_sql(4, "true"))
def _(fx):
    return retrieval.knn(fx.vectors, fx.vectors, 4, block=128)


@query("knn_per_expert", "expert:i " + _KNN, _knn_sql(2, "p.vec_id < q.vec_id AND p.label = q.label", "expert,"))
def _(fx):
    v = fx.vectors.withColumnRenamed("label", "expert")
    return retrieval.knn(v, v, 2, group="expert", strictly_before=True)


_DIFF = "t_start:i node_idx:i retrieved:i diff_occ:f4 diff_temp:f4 diff_price:f4 diff_ghi:f4 diff_wind:f4"


@query("diff_features", _DIFF, "SELECT * FROM diffs")
def _(fx):
    return retrieval.diff_features(fx.neighbours, fx.facts)


@query(
    "retrieval_entries",
    "entry:s retrieved_list:s diff_occ:f4 diff_temp:f4",
    """SELECT t_start || ':' || node_idx AS entry, lst AS retrieved_list, diff_occ, diff_temp FROM diffs
JOIN (SELECT q_t, string_agg(CAST(p_t AS VARCHAR), ',' ORDER BY rank) AS lst FROM neighbours GROUP BY q_t) ON q_t = t_start""",
)
def _(fx):
    return retrieval.retrieval_entries(fx.neighbours, fx.facts).withColumn("retrieved_list", F.array_join("retrieved_t_starts", ","))


# --- routing and protocols ---
_LABEL = "CASE zone_type WHEN 'CBD' THEN 0 ELSE 1 END"


@query("route_meta", "node_idx:i label:i", f"SELECT node_idx, {_LABEL} AS label FROM user_nodes")
def _(fx):
    # Not every node has a numeric expert id, so the zone decides.
    partial = fx.user_nodes.withColumn("expert_id", F.when(F.col("r_regionkey") == 0, "2").otherwise("n/a"))
    return routing.route_meta(partial)


@query("route_proxy", "node_idx:i mean:f label:i",
       "SELECT node_idx, mean, CASE WHEN mean >= median(mean) OVER () THEN 0 ELSE 1 END AS label FROM (SELECT node_idx, avg(value) AS mean FROM load_norm GROUP BY node_idx)")
def _(fx):
    return routing.route_proxy(fx.load_norm)


@query("route_split", "expert:i items:i nodes:i",
       f"SELECT {_LABEL} AS expert, count(*) AS items, count(DISTINCT node_idx) AS nodes FROM windows JOIN user_nodes USING (node_idx) GROUP BY ALL")
def _(fx):
    items = routing.route_split(fx.windows.select("node_idx", "t_start"), routing.route_meta(fx.user_nodes))
    return items.groupBy("expert").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("node_idx").alias("nodes"))


@query(
    "sample_subset",
    "mode:s t_start:i node_idx:i",
    """(SELECT 'head' AS mode, t_start, node_idx FROM windows ORDER BY t_start, node_idx LIMIT 200)
UNION ALL (SELECT 'random', t_start, node_idx FROM windows ORDER BY md5('7:' || t_start || ':' || node_idx) LIMIT 200)""",
)
def _(fx):
    w = fx.windows.select("t_start", "node_idx")
    head = routing.sample_head(w, ["t_start", "node_idx"], 200).withColumn("mode", F.lit("head"))
    rand = routing.sample_seeded(w, ["t_start", "node_idx"], 200, 7).withColumn("mode", F.lit("random"))
    return head.unionByName(rand)


@query(
    "nodes_balanced",
    "zone_type:s node_idx:i pick:i",
    """SELECT zone_type, node_idx, row_number() OVER (PARTITION BY zone_type ORDER BY md5('11:' || node_idx)) AS pick FROM user_nodes
QUALIFY pick <= least(40, (SELECT min(c) FROM (SELECT count(*) AS c FROM user_nodes GROUP BY zone_type)))""",
)
def _(fx):
    return routing.nodes_balanced(fx.user_nodes, 40, 11)


@query(
    "split_source_nodes",
    "node_idx:i role:s",
    """SELECT node_idx, CASE WHEN row_number() OVER (ORDER BY md5('342:' || node_idx)) <= greatest(1, floor(count(*) OVER () * CAST(0.3 AS DOUBLE))) THEN 'source' ELSE 'target' END AS role FROM users""",
)
def _(fx):
    return routing.split_source_nodes(fx.users, 0.3, 42)


@query(
    "stratified_source_nodes",
    "label:i node_idx:i role:s quota:i",
    f"""
WITH l AS (SELECT node_idx, {_LABEL} AS label FROM user_nodes),
s AS (SELECT label, count(*) AS n, count(*) * CAST(0.35 AS DOUBLE) AS ex, floor(count(*) * CAST(0.35 AS DOUBLE)) AS base FROM l GROUP BY label),
q AS (SELECT label, base + CASE WHEN base < n AND row_number() OVER (ORDER BY ex - base DESC, label) <= greatest(0, greatest(1, floor(sum(n) OVER () * CAST(0.35 AS DOUBLE))) - sum(base) OVER ()) THEN 1 ELSE 0 END AS quota FROM s)
SELECT label, node_idx, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('392:' || node_idx)) <= quota THEN 'source' ELSE 'target' END AS role, quota FROM l JOIN q USING (label)""",
)
def _(fx):
    nodes = routing.route_meta(fx.user_nodes).select("node_idx", "label")
    return routing.stratified_source_nodes(nodes, "label", 0.35, 42)


@query(
    "distribute_cap",
    "expert:s n:i quota:i",
    """
WITH s AS (SELECT segment AS expert, count(*) AS n FROM windows JOIN user_nodes USING (node_idx) GROUP BY ALL),
x AS (SELECT *, 1000.0::DOUBLE * n / sum(n) OVER () AS ex FROM s), b AS (SELECT *, least(n, floor(ex)) AS base FROM x)
SELECT expert, n, base + CASE WHEN base < n AND row_number() OVER (ORDER BY ex - base DESC, expert) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b""",
)
def _(fx):
    sizes = fx.windows.select("node_idx").join(fx.user_nodes, "node_idx").groupBy(F.col("segment").alias("expert")).agg(F.count(F.lit(1)).alias("n"))
    return routing.distribute_cap(sizes, "expert", "n", 1000)


_COUNTS = """FROM (SELECT floor(n * 4 * CAST(0.6 AS DOUBLE)) - 17 AS tr, n * 4 - floor(n * 4 * CAST(0.8 AS DOUBLE)) - 17 AS te, (SELECT count(*) FROM users) AS nodes FROM ev_days)"""


def _counts(fx):
    train = (F.floor(fx.n_steps * 0.6) - 17).cast("long")
    test = (fx.n_steps - F.floor(fx.n_steps * 0.8) - 17).cast("long")
    return train, test, fx.users.agg(F.count(F.lit(1))).scalar()


@query(
    "fewshot_prefix",
    "ratio:f train_window_count:i test_window_count:i node_count:i train_item_count:i",
    f"""SELECT ratio, w AS train_window_count, te AS test_window_count, nodes AS node_count, w * nodes AS train_item_count
FROM (SELECT *, greatest(1, floor(tr * CAST(ratio AS DOUBLE))) AS w {_COUNTS} CROSS JOIN (SELECT unnest([0.01, 0.1, 0.25, 0.5, 1.0]) AS ratio))""",
)
def _(fx):
    train, test, nodes = _counts(fx)
    return routing.fewshot_prefix(train, test, nodes, [0.01, 0.1, 0.25, 0.5, 1.0], fx.spark.range(1).select(F.lit(1).alias("one")))


@query(
    "zeroshot_protocol",
    "source_nodes:i target_nodes:i train_windows:i test_windows:i train_items:i masked_sum:f nbr_sum:f",
    f"""
WITH l AS (SELECT node_idx, {_LABEL} AS label FROM user_nodes),
s AS (SELECT label, count(*) AS n, count(*) * CAST(0.5 AS DOUBLE) AS ex, floor(count(*) * CAST(0.5 AS DOUBLE)) AS base FROM l GROUP BY label),
q AS (SELECT label, base + CASE WHEN base < n AND row_number() OVER (ORDER BY ex - base DESC, label) <= greatest(0, greatest(1, floor(sum(n) OVER () * CAST(0.5 AS DOUBLE))) - sum(base) OVER ()) THEN 1 ELSE 0 END AS quota FROM s),
r AS MATERIALIZED (SELECT node_idx, row_number() OVER (PARTITION BY label ORDER BY md5('542:' || node_idx)) <= quota AS src FROM l JOIN q USING (label)),
w AS MATERIALIZED (SELECT v.node_idx, v.t_start, CASE WHEN src THEN list_sum(v.x_hist) ELSE 0 END AS hs FROM windows v JOIN r USING (node_idx) CROSS JOIN ev_days WHERE v.t_start <= floor(n * 4 * CAST(0.6 AS DOUBLE)) - 6),
c AS (SELECT max(t_start) - 11 AS full_count FROM w), h AS (SELECT greatest(1, full_count // 2) AS kept FROM c)
SELECT (SELECT count(*) FROM r WHERE src) AS source_nodes, (SELECT count(*) FROM r WHERE NOT src) AS target_nodes, kept AS train_windows, (SELECT greatest(1, te // 10) {_COUNTS}) AS test_windows,
       kept * (SELECT count(*) FROM r WHERE src) AS train_items, (SELECT sum(hs) FROM w WHERE t_start - 12 < kept) AS masked_sum,
       (SELECT sum(weight) FROM user_edges WHERE src IN (SELECT node_idx FROM r WHERE src) AND dst IN (SELECT node_idx FROM r WHERE src)) AS nbr_sum FROM h""",
)
def _(fx):
    roles = routing.stratified_source_nodes(routing.route_meta(fx.user_nodes).select("node_idx", "label"), "label", 0.5, 42)
    sources = roles.where("role = 'source'")
    masked = graph.mask_nodes(fx.load_norm.drop("value_raw"), sources, "node_idx", "value")
    train = splits.split_ratio(masked, "t_idx", fx.n_steps).where("split = 'train'").select("node_idx", "t_idx", "value")
    w = windows.sliding_windows(train, ["node_idx"], "t_idx", "value", history=12, horizons=[6])
    full, test, _ = _counts(fx)
    kept = F.greatest(F.lit(1), F.floor(full / 2)).cast("long")
    from wattline.functions.arrays import asum

    total = w.where(F.col("t_start") - 12 < kept).agg(F.sum(asum(F.col("x_hist")))).scalar()
    edges = graph.mask_edges(fx.user_edges, sources, "node_idx").agg(F.sum("weight")).scalar()
    sized = roles.agg(
        F.sum((F.col("role") == "source").cast("long")).alias("source_nodes"), F.sum((F.col("role") == "target").cast("long")).alias("target_nodes")
    )
    return sized.select(
        "*", kept.alias("train_windows"), F.greatest(F.lit(1), F.floor(test / 10)).alias("test_windows"), (kept * F.col("source_nodes")).alias("train_items"),
        total.alias("masked_sum"), edges.alias("nbr_sum"),
    )
