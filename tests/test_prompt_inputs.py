"""What prompts and answers are made from: numbers travel, texts do not."""

import re

import pytest
from pyspark.sql import functions as F

from wattline.operators import graph, retrieval, select, text
from wattline.plans import q_text
from wattline.plans.catalog import REGISTRY
from wattline.sources.fixtures import Fixtures

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("span", [256, 16])
def test_rows_equal_those_joined_by_window_and_node(spark, monkeypatch, span):
    """Neighbour means, retrieved windows and differentials by their own operators, also where windows lie in several blocks."""
    monkeypatch.setattr(q_text, "SPAN", span)
    fx = Fixtures(spark, SMALL)
    names = ["x_hist", "y", "nbr", "retrieved_block", "diff_text", "diff_occ", "retrieved_last_value", "retrieved_short_slope", "retrieved_mean", "retrieved_trend_label"]
    got = {(r.t_start, r.node_idx): r for r in q_text._rows(fx).select("t_start", "node_idx", *names, F.size("x_context").alias("n")).collect()}
    n = fx.neighbours
    nbr = graph.neighbour_mean(graph.topk_neighbours(fx.user_edges, 7), fx.load_norm, "node_idx", "t_idx", "value")
    want = fx.windows.where("t_start >= 40").join(fx.user_nodes.select("node_idx"), "node_idx").join(nbr.select("node_idx", (F.col("t_idx") + 1).alias("t_start"), "nbr"), ["t_start", "node_idx"], "left")
    diffs = retrieval.diff_features(n, fx.facts).select("t_start", "node_idx", "diff_occ", text.diff_block(list(q_text.nd_fields())).alias("diff_text"))
    for part in (text.retrieved_block(n, fx.windows), select.retrieved_trends(fx.windows, n), diffs):
        want = want.join(part, ["t_start", "node_idx"], "left")
    rows = want.select("t_start", "node_idx", *names).collect()
    assert rows and len(got) == len(rows)
    for r in rows:
        mine = got[r.t_start, r.node_idx]
        assert mine.n == 40
        for c in names:
            assert mine[c] == (pytest.approx(r[c], abs=1e-12) if isinstance(r[c], float) else r[c]), (c, mine, r)


@pytest.mark.parametrize("key", ["prompt_rows", "target_rows"])
def test_no_rendered_text_or_window_is_shuffled(spark, key):
    plan = REGISTRY[key].run(spark, SMALL)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sent and not [c for c in sent if re.search(r"x_hist|x_context|long_text|candidate_text|aux_text|retrieved_block|_line#|user_text|target_text", c)]
