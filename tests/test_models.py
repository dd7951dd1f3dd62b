import numpy as np
from pyspark.sql import functions as F

from wattline.functions import boosting
from wattline.operators import models


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[rng.random((n, 4)) < 0.05] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) > 0.3, 120.0, 40.0) + 20 * np.nan_to_num(x[:, 1]) + rng.normal(size=n)
    return x, y


def binned(x, bins=32):
    cuts = [np.unique(np.nanquantile(c, np.arange(1, bins - 1) / (bins - 1))) for c in x.T]
    return boosting.bin_numbers(list(x.T), cuts)


def brute_split(b, g, leaf, bins):
    """The best single split by looking at every one."""
    best = (-np.inf, None)
    for f in range(b.shape[1]):
        for last in range(bins - 1):
            left = b[:, f] <= last
            if left.sum() >= leaf and (~left).sum() >= leaf:
                gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(g)
                best = max(best, (gain, (f, last)), key=lambda t: t[0])
    return best


def test_first_split_and_leaf_values():
    x, y = data(300)
    b, g = binned(x), y - y.mean()
    tree = boosting.grow_tree(b.astype(np.int64) + np.arange(4) * 32, 32, 4, g, None, 3, 10, 0.0, 1.0)
    gain, (f, last) = brute_split(b, g, 10, 32)
    assert (tree["feature"][0], tree["bin"][0]) == (f, last) and abs(tree["gain"][0] - gain) < 1e-6 * gain
    # the children, whose histograms are counted or subtracted, and the leaves
    for child, rows in ((1, b[:, f] <= last), (2, b[:, f] > last)):
        gain, at = brute_split(b[rows], g[rows], 10, 32)
        assert (tree["feature"][child], tree["bin"][child]) == at
    values = boosting.drop_through(tree, b)
    for v in np.unique(values):
        assert abs(g[values == v].mean() - v) < 1e-9 and (values == v).sum() >= 10


def test_losses_fall_and_the_lowest_is_kept():
    x, y = data(1500)
    b = binned(x)
    model, losses = boosting.fit(b[:1000], y[:1000], b[1000:], y[1000:], 32, False, 4, 10, 200, patience=30)
    assert min(losses) < 0.2 * losses[0] and len(model.trees) == int(np.argmin(losses))
    assert abs(boosting.loss_of(model.predict(b[1000:]), y[1000:], False) - min(losses)) < 1e-9
    peak = (y > 100).astype(float)
    model, losses = boosting.fit(b[:1000], peak[:1000], b[1000:], peak[1000:], 32, True, 4, 10, 100)
    p = model.predict(b[1000:])
    assert p.min() >= 0 and p.max() <= 1 and min(losses) < 0.3 * losses[0]


def test_constant_labels_and_no_validation_rows():
    x, y = data(50)
    b, none = binned(x), (np.zeros((0, 4), np.uint8), np.zeros(0))
    model, losses = boosting.fit(b, np.ones(50), *none, 32, True, 4, 10, 20)
    assert (model.predict(b) == 1).all() and losses == [0.0]
    model, losses = boosting.fit(b, y, *none, 32, False, 2, 5, 20, patience=2)
    assert len(model.trees) == 20 and losses[-1] < losses[0]


def test_the_grid_is_fitted_and_its_best_point_predicts(spark):
    x, y = data(900, 3)
    rows = [(("solar", "mid")[i % 2], ("train", "train", "val", "test")[i // 2 % 4], float(p), *[None if np.isnan(v) else float(v) for v in r]) for i, (r, p) in enumerate(zip(x, y, strict=True))]
    table = spark.createDataFrame(rows, "regime string, split string, target_price double, a double, b double, c double, d double").withColumn("note", F.lit("kept"))
    grid = dict(depths=(2, 4), leaves=(5, 20), rounds=60, class_rounds=40)
    fits, _ = models.fit_grid(table, ["a", "b", "c", "d"], 30.0, 110.0, **grid, patience=10, bins=32, most_rows=1000, seed=1)
    tried = fits.groupBy("regime", "target").agg(F.count("*").alias("n"), F.min("loss").alias("least")).collect()
    assert len(tried) == 6 and {r.n for r in tried} == {4}
    least = {(r.regime, r.target): r.least for r in tried}
    out, weights = models.regime_gbt(table, ["a", "b", "c", "d"], 30.0, 110.0, **grid, patience=10, bins=32, most_rows=1000)
    got = out.collect()
    assert len(got) == sum(r[1] == "test" for r in rows) and all(r.note == "kept" and 0 <= r.floor_p <= 1 and 0 <= r.peak_p <= 1 for r in got)
    assert all(abs(r.val_mae - least[r.regime, "price"]) < 1e-6 for r in got)
    assert np.mean([abs(r.prediction - r.target_price) for r in got]) < 12
    assert {(r.regime, r.feature) for r in weights.collect()} == {(g, f) for g in ("solar", "mid") for f in "abcd"}


def test_a_bound_on_rows_draws_about_so_many(spark):
    x, y = data(2000, 5)
    rows = [("mid", "train", float(p), *map(float, np.nan_to_num(r))) for r, p in zip(x, y, strict=True)]
    table = spark.createDataFrame(rows, "regime string, split string, target_price double, a double, b double, c double, d double")
    fits, cuts = models.fit_grid(table, ["a", "b", "c", "d"], 30.0, 110.0, (3,), (5,), 5, 5, None, 16, 500, 1)
    assert fits.count() == 3 and all(len(c) == 14 for c in cuts)
