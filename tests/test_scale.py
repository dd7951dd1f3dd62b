"""Hubs, long axes and interrupted writes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattline.operators import graph, grid
from wattline.sources import sinks


def test_a_hub_is_many_keys(spark, monkeypatch):
    """A star: 400 nodes look at one hub; its edges are dealt over blocks, and the means stay right."""
    monkeypatch.setattr(graph, "HUB_EDGES", 50)
    edges = spark.range(1, 401).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(2.0).alias("weight"))
    edges = edges.unionByName(spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (7, 8, 6.0)], edges.schema))
    obs = spark.range(401).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t")).withColumn("v", (F.col("n") + 10 * F.col("t")).cast("double"))
    got = {(r.n, r.t): r.nbr for r in graph.neighbour_mean(edges, obs, "n", "t", "v").collect()}
    assert len(got) == 401 * 3
    for n, t in got:
        want = (1 * (1 + 10 * t) + 3 * (2 + 10 * t)) / 4 if n == 0 else (2 * 10 * t + 6 * (8 + 10 * t)) / 8 if n == 7 else 10.0 * t
        assert got[n, t] == pytest.approx(want, rel=1e-6)


def test_axes_are_made_in_short_arrays(spark):
    lo, hi = datetime(2024, 1, 1, 0, 7), datetime(2024, 1, 9, 3, 0)
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    for step, delta in (("15 minutes", timedelta(minutes=15)), ("7 hours", timedelta(hours=7)), ("2 days", timedelta(days=2))):
        axis = grid.time_axis(keys, "ts", F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"), step, together=10)
        want = [lo + i * delta for i in range(int((hi - lo) / delta) + 1)]
        assert sorted((r.k, r.ts) for r in axis.collect()) == [(k, t) for k in "ab" for t in want]
    assert grid.time_axis(keys, "ts", F.lit(hi).cast("timestamp_ntz"), F.lit(lo).cast("timestamp_ntz"), "1 hour").count() == 0
    with pytest.raises(ValueError, match="fixed length"):
        grid.time_axis(keys, "ts", F.lit(lo), F.lit(hi), "1 month")


def test_a_rewrite_that_stops_midway_leaves_the_old_store_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no finished"):
        sinks.scan_retrieval(spark, path)
    rows = spark.range(10).select("id")
    sinks.sink_retrieval(rows, path, per_file=4, parameters={"k": 1})
    reading = sinks.scan_retrieval(spark, path, {"k": 1})
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("cut")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="cut"):
        sinks.sink_retrieval(broken, path, parameters={"k": 2})
    assert sorted(r.id for r in sinks.scan_retrieval(spark, path, {"k": 1}).collect()) == list(range(10))
    sinks.sink_retrieval(spark.range(3), path, parameters={"k": 2})
    assert sinks.scan_retrieval(spark, path, {"k": 2}).count() == 3 and reading.count() == 10
    with pytest.raises(ValueError, match="k=2"):
        sinks.scan_retrieval(spark, path, {"k": 1})


@pytest.mark.parametrize("parts", [1, 5])
def test_correlations_in_tiles(spark, monkeypatch, parts):
    """23 nodes in several parts, 300 steps in many blocks: every pair as numpy has it, and the top k from the tiles."""
    import numpy as np

    monkeypatch.setattr(graph, "BLOCKS_TOGETHER", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 23)) + rng.normal(size=(300, 23))
    x[:, 22] = 5.0  # a constant node has no correlation
    obs = spark.createDataFrame([(f"n{j:02d}", t, float(x[t, j])) for t in range(300) for j in range(23)], "n string, t int, v double")
    want = np.abs(np.corrcoef(x[:, :22].T))
    got = {(r.src, r.dst): r.weight for r in graph.corr_graph(obs, "n", "t", "v", rows_per_block=16, node_parts=parts).collect()}
    assert len(got) == 22 * 21 and all(got[f"n{i:02d}", f"n{j:02d}"] == pytest.approx(want[i, j]) for i in range(22) for j in range(22) if i != j)
    best = {(r.src, r["rank"]): r.dst for r in graph.corr_topk(obs, "n", "t", "v", 3, rows_per_block=16, node_parts=parts).collect()}
    np.fill_diagonal(want, 0)
    assert best == {(f"n{i:02d}", r + 1): f"n{j:02d}" for i in range(22) for r, j in enumerate(np.argsort(-want[i])[:3])}


def _joins(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_tables_of_the_load_line_are_not_sent_through_the_driver(spark):
    """The files are small enough for Spark to guess a broadcast; rows per step, window and record must not take that way."""
    from wattline.plans.catalog import REGISTRY
    from wattline.sources.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    steps = _joins(fx.load_raw)
    assert "SortMergeJoin" in steps and "BroadcastHashJoin" not in steps
    window_columns = [line for line in _joins(fx.paired).splitlines() if "Join" in line and "t_start" in line]
    assert window_columns and all("SortMergeJoin" in line for line in window_columns)
    picks = [line for line in _joins(REGISTRY["case_union"].build(fx)).splitlines() if "Join" in line][0]
    assert "BroadcastHashJoin" in picks and "BuildRight" in picks  # the few picks go to the windows


def test_scores_are_computed_once(spark):
    from wattline.operators import metrics

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    scored = spark.range(9).select(F.lit("a").alias("variant"), F.lit(True).alias("parse_ok"), counted(F.col("id").cast("double")).alias("mae"), F.col("id").cast("double").alias("prediction_range"))
    got = metrics.flat_ratio_quantiles(scored, ["variant"], "mae").collect()
    assert [(r.min, r.p25, r.median, r.p75, r.max, round(r.flat_ratio, 6)) for r in got] == [(0.0, 2.0, 4.0, 6.0, 8.0, 0.111111)]
    assert made.value == 9


def test_ranked_cases_read_stored_scores(spark):
    from wattline.plans import q_select
    from wattline.sources.fixtures import Fixtures

    files = q_select._seasonal(Fixtures(spark, "/root/testdata/sf0.001")).inputFiles()
    assert files and all("wattline-scores" in f for f in files)


def test_result_documents_hold_a_part_of_the_nodes(spark, tmp_path, monkeypatch):
    """Nodes far apart lie in documents of their own, and the files are compressed."""
    from types import SimpleNamespace

    from wattline.plans.catalog import REGISTRY

    made = str(tmp_path / "records")
    monkeypatch.setattr(sinks, "scratch", lambda *_: made)
    rows = [("mean", t, n, "d", True, [0.5], [1.0, 2.0]) for t in (12, 13) for n in (1, 2, 5000, 9000)]
    records = spark.createDataFrame(rows, "variant string, t_start long, node_idx long, domain string, parse_ok boolean, pred array<double>, target array<double>")
    got = REGISTRY["scan_records_json"].build(SimpleNamespace(records=records, spark=spark))
    assert sorted((r.t_start, r.node_idx, r.y_sum) for r in got.collect()) == [(t, n, 3.0) for t in (12, 13) for n in (1, 2, 5000, 9000)]
    assert spark.read.json(made).count() == 6
    assert all(f.name.endswith(".json.lz4") for f in (tmp_path / "records").glob("part-*"))
