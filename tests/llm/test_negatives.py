import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import negatives as N
from wattline.llm.blockwise import Best
from wattline.llm.catalog import QUERIES

from .conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        row = (label, [math.floor(256 * x) for x in v])
        good[i] = min(good.get(i, row), row)
    out = set()
    for a, (label, v) in good.items():
        if not is_anchor(a):
            continue
        score = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))), i, g == label) for i, (g, w) in good.items() if i != a and len(w) == len(v))
        for s, p, _ in [t for t in score if t[2]][:positives]:
            fit = [(n, -t) for t, n, same in score if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            out |= {(a, p, rank, n, -s, t) for rank, (n, t) in enumerate(fit, 1)}
    return out


def answer(df):
    rows = df.collect()
    assert df.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = {tuple(r)[:6] for r in rows}
    assert len(found) == len(rows)
    return found


def test_annuli_and_ranges_lose_no_row():
    rng = np.random.default_rng(4)
    centres = rng.normal(scale=100, size=(9, 6))
    x = np.floor(np.repeat(centres, 150, axis=0) + rng.normal(scale=8, size=(1350, 6)))
    x[200:500] = x[200]
    square = float((x**2).sum(axis=1).max())
    y, ids, labels = N.lifted(x, square), np.arange(len(x)), rng.integers(0, 3, len(x))
    tree = N.grow(y, np.arange(len(x)), 32, ranges=True)
    assert isinstance(tree, N.Node)
    scored = []

    class Counting(N.Anchors):
        def score(self, at, rows, *rest):
            scored.append(len(at) * len(rows))
            super().score(at, rows, *rest)

    at = np.arange(0, len(x), 27)
    s = x @ x.T
    of, low = np.repeat(np.arange(len(at)), 2), np.repeat(np.percentile(s[at], 97, axis=1), 2).astype(np.int64)
    a = Counting(x[at], ids[at], labels[at], of, low, low + 3000, 4, False, square)
    N.search(a, {"x": x, "ids": ids, "labels": labels, "path": [], "tree": tree}, np.abs(x).max())
    a.best.settle()
    for w, anchor in enumerate(at[of]):
        fit = [j for j in ids if labels[j] != labels[anchor] and low[w] <= s[anchor, j] <= low[w] + 3000]
        assert a.best.id[a.best.query == w].tolist() == sorted(fit, key=lambda j: (-s[anchor, j], j))[:4]
    assert sum(scored) < 0.5 * len(at) * len(x), "no subtree was left out"


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    for ids in ([9, 3, 7], [1, 8, 2]):
        q = np.zeros(3, np.int64)
        fit = best.better(q, np.array([5, 5, 5]), np.array(ids))
        best.add(q[fit], np.full(fit.sum(), 5), np.array(ids)[fit])
        best.settle()
    assert best.id.tolist() == [1, 2] and best.floor.tolist() == [5, np.iinfo(np.int64).min]


def test_products_are_exact():
    a = np.array([[3.0e9, 1.0], [2.0**60, 2.0**10]])
    assert N.products(a, a, 2.0**60).tolist() == [[9 * 10**18 + 1, 2**63 - 1], [2**63 - 1, 2**63 - 1]]


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.normal(size=4)], int(rng.integers(0, 3))) for k in range(60)]
    rows += [(60 + k, rows[3][1], k % 3) for k in range(20)] + [rows[3], (3, rows[8][1], 2), (4, rows[4][1], 0)]
    rows += [(90, None, 1), (91, [float("nan"), 1.0, 1.0, 1.0], 1), (92, [None, 1.0, 1.0, 1.0], 1), (93, [1e306, 1.0, 1.0, 1.0], 1), (94, [1.0, 2.0], 1), (95, [2.0, 1.0], 2), (96, [1.0, 1.0], 1), (97, [], 1), (98, [], 1), (99, [], 2)]
    rows += [(100, rows[0][1], None), (None, rows[0][1], 1), (102, [0.0] * 4, 1), (103, [1e10, 1e10, 1.0, 1.0], 1), (104, [1e9, 2e9, 1.0, 1.0], 2), (105, [9e9, 1.0, 1.0, 1.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"anchor_id": F.lit("clash"), "rank": F.lit(1), "id": F.lit(2)})
    got = answer(N.hard_negatives(table, F.col("vec_id") % 2 == 0))
    assert got and got == brute(rows, lambda i: i % 2 == 0)
    assert N.hard_negatives(table.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_many_blocks_and_cells(spark, monkeypatch):
    for name, value in (("SAMPLE", 200), ("BLOCK", 30), ("LEAF", 8), ("ROWS_TOGETHER", 60), ("ANCHORS_TOGETHER", 25)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(7, 5))
    rows = [(k, [float(x) for x in base[k % 7] + rng.normal(scale=0.1, size=5)], int(rng.integers(0, 4))) for k in range(500)]
    rows = [(k, rows[0][1], g) if k % 3 == 0 else (k, v, g) for k, v, g in rows]  # a third are copies
    got = answer(N.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0))
    assert got == brute(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.1"])
def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = answer(QUERIES["op11_gnat_negatives"](spark, sf))
    assert got and got == brute(rows, lambda i: i % 100 == 0)
