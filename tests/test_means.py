"""Means on a threshold."""

import pytest
from pyspark.sql import functions as F

from wattline.functions.means import exact_mean

CENTS = [1234, 8807, 3, 4999, 9957]  # 250.00 in all


def test_a_mean_on_a_threshold_is_the_same_for_any_order(spark):
    import itertools

    rows = [(i, v / 100) for i, order in enumerate(itertools.permutations(CENTS)) for v in order]
    got = spark.createDataFrame(rows, "k int, v double").coalesce(1).groupBy("k").agg(exact_mean(F.col("v")).alias("m"), F.avg("v").alias("plain")).collect()
    assert {r.m for r in got} == {50.0}
    assert {r.plain for r in got} != {50.0}  # what the plain mean does with them


def test_values_that_are_no_short_decimals_keep_the_plain_mean(spark):
    def mean(*values):
        return spark.createDataFrame([(v,) for v in values], "v double").agg(exact_mean(F.col("v"))).first()[0]

    assert mean(1 / 3, 2 / 3) == pytest.approx(0.5)
    assert mean(1e300, 1e300) == 1e300
    assert mean(float("inf"), 1.0) == float("inf")
    assert mean(None, 2.5) == 2.5 and mean(None) is None


def test_the_price_line_uses_it(spark):
    from wattline.sources.fixtures import Fixtures

    plan = Fixtures(spark, "/root/testdata/sf0.001").market_raw._jdf.queryExecution().analyzed().toString()
    assert "decimal(18,6)" in plan


def test_pooled_errors_are_added_up_before_the_combinations(spark):
    from wattline.operators import metrics

    rows = [("a", 1, 3.0), ("a", 1, -1.0), ("a", 2, 2.0), ("a", 2, None), ("b", 1, None)]
    out = metrics.pooled(spark.createDataFrame(rows, "variant string, h int, err double"), ["variant"], ["h"])
    got = {(r.variant, r.h): (r.rmse, r.mae) for r in out.collect()}
    assert got[("a", 1)] == pytest.approx((5**0.5, 2.0)) and got[("a", 2)] == pytest.approx((2.0, 2.0))
    assert got[("a", None)] == pytest.approx(((14 / 3) ** 0.5, 2.0)) and got[("b", 1)] == got[("b", None)] == (None, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Expand") :]


def test_a_window_is_read_by_offsets(spark):
    """No list is gathered anew for every row; nulls keep their places."""
    from wattline.operators import windows

    df = spark.createDataFrame([("k", t, None if t == 3 else float(t), 10.0 * t) for t in range(9)], "k string, t long, v double, e double")
    out = windows.sliding_windows(df, ["k"], "t", "v", history=2, horizons=[1, 3], context=4, extra=["e"], width=4)
    got = {r.t_start: (r.x_hist, r.y_1, r.y_3, r.x_context, r.e_hist, r.e_future) for r in out.collect()}
    val = lambda t: None if t == 3 else float(t)
    assert got == {t: ([val(t - 2), val(t - 1)], [val(t)], [val(t + i) for i in range(3)], [val(t - i) for i in (4, 3, 2, 1)],
                       [10.0 * (t - 2), 10.0 * (t - 1)], [10.0 * (t + i) for i in range(3)]) for t in (4, 5, 6)}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
