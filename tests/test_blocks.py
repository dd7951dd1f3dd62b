"""Block-wise series helpers against plain Python, with blocks far smaller than the series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions.blocks import carry, framed, prev_row, row_index
from wattline.functions.quantile import exact_quantiles, order_bin
from wattline.operators import clean, joins, quality, windows


def series(seed, n=60, nodes=("a", "b"), gap=0.6):
    rng = random.Random(seed)
    return [(k, i, None if rng.random() < gap else round(rng.uniform(-5, 5), 3)) for k in nodes for i in range(n)]


@pytest.mark.parametrize("width", [3, 7, 1000])
def test_carry_crosses_empty_blocks(spark, width):
    rows = series(1, gap=0.9)
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {(r.k, r.i): r for r in carry(df, ["k"], "i", {"x": F.col("v")}, width).collect()}
    for k in ("a", "b"):
        known = [(i, v) for kk, i, v in rows if kk == k and v is not None]
        for i in range(60):
            before = max((x for x in known if x[0] <= i), default=(None, None))
            after = min((x for x in known if x[0] >= i), default=(None, None))
            r = got[(k, i)]
            assert (r.x_prev_pos, r.x_prev, r.x_next_pos, r.x_next) == (*before, *after)


@pytest.mark.parametrize("width", [4, 1000])
def test_interpolation_matches_numpy_and_keeps_known_values(spark, width):
    rows = series(2)
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = {(r.k, r.i): r.v for r in clean.interp_pos(df, ["k"], "i", ["v"], width).collect()}
    for k in ("a", "b"):
        known = [(i, v) for kk, i, v in rows if kk == k and v is not None]
        want = np.interp(range(60), [i for i, _ in known], [v for _, v in known])
        assert np.allclose([got[(k, i)] for i in range(60)], want)
    assert all(got[(k, i)] == v for k, i, v in rows if v is not None)


def test_all_null_series_stays_null(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(5)], "k string, i long, v double")
    assert [r.v for r in clean.interp_pos(df, ["k"], "i", ["v"]).collect()] == [None] * 5


@pytest.mark.parametrize("width", [1, 9])
def test_windows_do_not_depend_on_block_width(spark, width):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(40)], "k string, i long, v double")
    w = windows.sliding_windows(df, ["k"], "i", "v", history=4, horizons=[2, 3], stride=2, context=6, width=width).orderBy("t_start").collect()
    assert [r.t_start for r in w] == list(range(6, 38, 2))  # range(ctx, T - max_h + 1, stride)
    for r in w:
        t = r.t_start
        assert r.x_hist == [float(x) for x in range(t - 4, t)] and r.x_context == [float(x) for x in range(t - 6, t)]
        assert r.y_2 == [float(t), float(t + 1)] and len(r.y_3) == 3


def test_framed_and_row_index_and_prev_row(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "i long, v double")
    out = framed(df, [], "i", 2, 1, {"s": lambda w: F.sum("v").over(w.rowsBetween(-2, 1))}, width=3)
    got = {r.i: r.s for r in out.collect()}
    assert got == {i: float(sum(j % 5 for j in range(max(0, i - 2), min(50, i + 2)))) for i in range(50)}
    odd = df.where("i % 3 = 1")
    assert sorted(r.n for r in row_index(odd, [], ["i"], F.floor(F.col("i") / 7), "n").collect()) == list(range(odd.count()))
    before = {r.i: r.i_before for r in prev_row(odd, [], "i", F.floor(F.col("i") / 4), ["i"]).collect()}
    ids = sorted(before)
    assert before[ids[0]] is None and all(before[b] == a for a, b in zip(ids, ids[1:]))


def test_exact_quantiles_match_numpy_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", round(rng.gauss(0, 50), 2)) for _ in range(900)] + [("tie", 7.0)] * 40 + [("one", -3.5), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    for k in ("hot", "tie", "one"):
        vals = [v for kk, v in rows if kk == k and v is not None]
        assert np.allclose([got[k].a, got[k].b, got[k].c], np.quantile(vals, [0.1, 0.5, 0.99]))


def test_order_bin_never_decreases(spark):
    vals = sorted([0.0, 1e-15, -1e-15, *[s * 10.0**e for s in (-1, 1, 2.5, -2.5) for e in range(-12, 13)]])
    df = spark.createDataFrame([(v,) for v in vals], "v double").select("v", order_bin(F.col("v")).alias("b"))
    bins = [r.b for r in df.orderBy("v").collect()]
    assert bins == sorted(bins)


def test_asof_takes_earlier_then_first_later(spark):
    left = spark.sql("select 'k' k, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) ts, h from (select explode(sequence(0, 9)) h)")
    right = spark.sql("select 'k' k, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) ts, h * 10 p from (select explode(array(3, 6)) h)")
    got = {r.h: r.p for r in joins.asof_join(left, right, ["k"], "ts", ["p"], width_s=3600).collect()}
    assert got == {h: 60 if h >= 6 else 30 for h in range(10)}


def test_missing_ranges_join_across_blocks(spark):
    df = spark.createDataFrame([("a", i, None if i in (0, 4, 5, 6, 9) else 1.0) for i in range(12)], "k string, i long, v double").withColumn("ts", F.col("i"))
    runs = {(r.row_start, r.row_end): r.n_missing for r in quality.missing_ranges(df, ["k"], "i", "ts", "v", width=2).collect()}
    assert runs == {(0, 0): 1, (4, 6): 3, (9, 9): 1}


def test_quantiles_of_values_in_a_narrow_range(spark, monkeypatch):
    """10^5 distinct values within 0.1 %: no task sorts them all, and the ranks are exact, also beside a second group."""
    import numpy as np

    from wattline.functions import quantile

    n = 100_000
    wide = [(-1) ** k * 10.0 ** (k % 7) for k in range(101)]
    rows = spark.range(n).select(F.lit("narrow").alias("g"), (1000 + F.pmod(F.col("id") * 7919, F.lit(n)) / n).alias("v")).unionByName(spark.createDataFrame([("wide", x) for x in wide], "g string, v double"))
    probs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.g: r for r in quantile.exact_quantiles(rows, ["g"], "v", probs).collect()}
    values = {"narrow": 1000 + np.arange(n) / n, "wide": np.array(wide)}
    for g, v in values.items():
        assert all(abs(got[g][name] - np.quantile(v, p)) < 1e-9 * max(1, abs(np.quantile(v, p))) for name, p in probs.items())
    # the bins that are sorted at the end are small
    sizes = []
    isempty = type(rows).isEmpty
    monkeypatch.setattr(type(rows), "isEmpty", lambda self: sizes.append(self.agg(F.max("_k")).first()[0]) or isempty(self))
    quantile.exact_quantiles(rows, ["g"], "v", probs).collect()
    assert sizes[0] > quantile.SMALL and sizes[-1] is None and len(sizes) <= 4
    alone = quantile.exact_quantiles(rows, [], "v", {"m": 0.5}).collect()
    assert len(alone) == 1 and quantile.exact_quantiles(rows.limit(0), [], "v", {"m": 0.5}).count() == 0
