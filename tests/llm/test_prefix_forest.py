import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import prefix_forest as P
from wattline.llm.blockwise import Best
from wattline.llm.catalog import QUERIES

from .conftest import SMALL


def brute(rows, asked, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, tuple(v)), tuple(v))
    ids = sorted(good)
    unit = {i: np.array(good[i]) / max(map(abs, good[i])) for i in ids}
    unit = {i: u / math.sqrt(u @ u) for i, u in unit.items()}
    out = {}
    for q in filter(asked, ids):
        near = sorted((-round(float(unit[q] @ unit[i]), 13), i) for i in ids if i != q and len(good[i]) == len(good[q]))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def answer(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def recall(got, want):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in rows}) for q, rows in want.items())
    return hit / sum(map(len, want.values()))


def test_ranges_are_the_rows_that_share_a_prefix():
    rng = np.random.default_rng(1)
    x = P.scaled(rng.normal(size=(300, 6)))
    planes = P.directions(6)
    block = P.Block(np.arange(300), x, planes)
    asked = P.strings(P.scaled(rng.normal(size=(7, 6))), planes)
    s = P.strings(x, planes)
    for bits in (0, 1, 3, 7, 32):
        start, stop = P._ranges(block.sorted[2], asked[2], bits)
        for q in range(7):
            want = [i for i in range(300) if bits == 0 or s[2, i] >> (32 - bits) == asked[2, q] >> (32 - bits)]
            assert sorted(block.order[2, start[q] : stop[q]]) == want
    longest = [max(32 - int(s[t, i] ^ asked[t, q]).bit_length() for t in range(P.TREES) for i in range(300)) for q in range(7)]
    assert P.descend(block, asked).tolist() == longest


def test_a_near_row_ends_the_way_up_early():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x[:8] = x[0] + rng.normal(scale=0.02, size=(8, 64))
    x = P.scaled(x)
    planes = P.directions(64)
    best = Best(1, 5, np.float64)
    scored = P.ascend(P.Block(np.arange(4000), x, planes), x[:1], np.array([0]), P.strings(x[:1], planes), best, np.array([0]))
    assert sorted(best.id) == sorted(np.argsort(-(x @ x[0]) / P.norms(x))[1:6]) and scored < 400


def test_stop_rule():
    assert P.bits_kept(np.array([1.0, -1.0])).tolist() == [P.BITS, 0]
    x = P.bits_kept(np.array([0.5]))[0]
    p = 2 / 3
    assert (1 - p**x) ** P.TREES <= P.MISS < (1 - p ** (x + 1)) ** P.TREES


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.normal(size=8)]) for k in range(40)]
    rows += [(50 + k, rows[4][1]) for k in range(10)] + [rows[4], (6, rows[9][1]), (70, [x * 2.0**600 for x in rows[4][1]]), (71, [x * 2.0**-600 for x in rows[5][1]])]
    rows += [(80, None), (82, [0.0] * 8), (84, [float("nan"), *[1.0] * 7]), (86, [float("-inf"), *[1.0] * 7]), (88, [None, *[1.0] * 7]), (90, []), (92, [1.0, 2.0]), (94, [2.0, 4.5]), (None, rows[4][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"query_id": F.lit("clash"), "rank": F.lit(1), "score": F.lit(1), "id": F.lit(1)})
    got, want = answer(P.nearest(table, F.col("vec_id") % 2 == 0)), brute(rows, lambda i: i % 2 == 0)
    assert set(got) == set(want) and recall(got, want) > 0.97
    for q, found in want.items():
        assert len(got[q]) == len(found)
        assert all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(got[q], found, strict=True)) or recall({q: got[q]}, {q: found}) < 1
    assert [i for i, _ in got[4]] == [50, 51, 52, 53, 54] and {s for _, s in got[4]} == {got[4][0][1]}
    assert P.nearest(table.limit(0), F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.1"])
def test_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = answer(QUERIES["op12_prefix_forest"](spark, sf)), brute(rows, lambda i: i % 50 == 0)
    value = recall(got, want)
    print("recall", sf, value)
    assert value >= 0.9 and all(len(got[q]) == 5 for q in want)
    exact = {q: dict(found) for q, found in want.items()}
    assert all(abs(s - exact[q][i]) < 1e-12 for q in want for i, s in got[q] if i in exact[q])


def test_reached_rows_share_the_prefix_at_every_length():
    rng = np.random.default_rng(4)
    planes = P.directions(6)
    x, y = (P.scaled(rng.normal(size=(n, 6))) for n in (300, 7))
    block, s, asked = P.Block(np.arange(300), x, planes), P.strings(x, planes), P.strings(y, planes)
    for bits in (0, 1, 5, P.LEAD, P.LEAD + 1, 14, 32):
        want = np.ones((7, 300), bool) if bits == 0 else ((asked[:, :, None] >> (32 - bits)) == (s[:, None, :] >> (32 - bits))).any(axis=0)
        assert (P.reached(block, asked, bits) == want).all()


@pytest.mark.parametrize("dense", [1, 16, 10**9])
def test_scored_rows_do_not_depend_on_how_they_are_multiplied(monkeypatch, dense):
    """Every row that shares a prefix down to where the query stops, whether gathered in pairs or in one product."""
    monkeypatch.setattr(P, "DENSE", dense)
    rng = np.random.default_rng(6)
    x = P.scaled(rng.normal(size=(2000, 16)))
    planes, at = P.directions(16), np.arange(40)
    best = Best(40, 5, np.float64)
    scored = P.ascend(P.Block(np.arange(2000), x, planes), x[:40], np.arange(40), P.strings(x[:40], planes), best, at)
    s = P.strings(x, planes)
    total, found = 0, dict(zip(*(v.tolist() for v in (best.query * 5 + np.tile(np.arange(5), 40), best.id)), strict=True))
    for q in range(40):
        for bits in range(32, -1, -1):
            rows = np.flatnonzero(((s >> (32 - bits)) == (s[:, q : q + 1] >> (32 - bits))).any(axis=0)) if bits else np.arange(2000)
            rows = rows[rows != q]
            near = P.cosines(x[rows], x[q : q + 1].repeat(len(rows), 0))
            if len(rows) >= 5 and P.bits_kept(np.sort(near)[-5:-4])[0] >= bits:
                break
        total += len(rows)
        order = np.lexsort((rows, -near))[:5]
        assert [found[q * 5 + k] for k in range(5)] == rows[order].tolist()
    assert scored == total


def test_pieces_are_dealt_evenly(spark):
    """Blocks of as many tasks, one or three each, into eight groups: none gets twice its share."""
    import pickle

    import pandas as pd

    from wattline.llm.blockwise import MOST_PIECES, meet_all

    def pieces(tasks, each):
        return spark.createDataFrame([(t * MOST_PIECES + k, pickle.dumps({"n": 1})) for t in range(tasks) for k in range(each)], "piece long, payload binary")

    def work(held, blocks):
        yield pd.DataFrame({"n": [sum(b["n"] for b in blocks)]})

    for tasks, each in ((16, 1), (8, 3), (24, 1)):
        got = [r.n for r in meet_all(pieces(1, 1), pieces(tasks, each), 1, 8, work, "n long").collect()]
        assert sorted(got) == [tasks * each // 8] * 8
