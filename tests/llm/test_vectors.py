import math

import numpy as np
from pyspark.sql import functions as F

from wattline.llm.catalog import QUERIES
from wattline.llm.vectors import near_vectors, similar_pairs, spanning, unit_rows

from .conftest import SMALL


def brute(rows, threshold=0.9):
    good = {i: np.array(v, float) / max(map(abs, v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, root, links = sorted(good), {}, dict.fromkeys(good, 0)

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (links.get(i, 0), find(i) if i in good else i, not (i in good and find(i) != i)) for i, _ in rows if i is not None}


def test_early_stops_lose_no_pair():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    x = unit_rows(np.repeat(centres, 9, axis=0) + rng.normal(scale=rng.uniform(0.1, 0.8, (108, 1)), size=(108, 32)))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)}
    assert want and set(zip(*similar_pairs(x, None, 0.9), strict=True)) == want
    assert set(zip(*similar_pairs(x[:50], x[50:], 0.9), strict=True)) == {(i, j - 50) for i, j in want if i < 50 <= j}


def test_spanning_links():
    node, root = spanning(np.array([0, 1, 5, 5]), np.array([1, 2, 6, 7]), 9)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {1: 0, 2: 0, 6: 5, 7: 5}


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = [(int(k), [float(x) for x in base[k % 6] + rng.normal(scale=0.05, size=8)]) for k in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, [x * 1e200 for x in rows[5][1]])]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan"), *[1.0] * 7]), (203, [float("inf"), *[1.0] * 7]), (204, [None, *[1.0] * 7]), (205, []), (206, [1.0, 2.0]), (207, [2.0, 4.0])]
    table = spark.createDataFrame([*rows, (None, rows[0][1])], "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash")).withColumn("label", F.lit(1))
    got = near_vectors(table).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == want
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    assert near_vectors(table.limit(0)).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op8_pca_tiles"](spark, SMALL).collect()} == brute(rows)


def test_a_tile_is_sent_a_few_times_not_once_per_other_tile():
    from wattline.llm import vectors

    for tiles in (1, 9, 26, 101, 293, 1465):
        strip, wide = vectors.layout(tiles, 64)
        strips = -(-tiles // strip)
        assert strip * vectors.TILE * 64 * 8 <= vectors.STRIP_BYTES
        sent = sum(s // strip + (strips - 1) // wide - s // strip // wide + 1 for s in range(tiles)) / tiles
        assert sent <= max(vectors.SIDES + 2, strips)


def test_strips_and_chunks_count_every_link_once(spark, monkeypatch):
    """Many small tiles in strips of one or more, with a cluster that lies in all of them, and rows that no digit of is lost."""
    from wattline.llm import vectors

    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(int(k), [float(x) for x in base[0 if k % 3 == 0 else k % 40] + rng.normal(scale=0.12, size=8)]) for k in range(330)]
    rows += [(1000 + k, rows[k][1]) for k in range(20)]
    want = brute(rows)
    monkeypatch.setattr(vectors, "TILE", 8)
    seen = set()
    for held, kind in ((8 * 8 * 8, "double"), (64 << 20, "double"), (8 * 8 * 8, "float")):
        monkeypatch.setattr(vectors, "STRIP_BYTES", held)
        seen.add(vectors.layout(-(-330 // 8), 8))
        if kind == "float":
            rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
            want = brute(rows)
        got = near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert len(seen) == 2


def test_a_strip_tells_one_link_per_row():
    """A cluster that fills every tile: links between rows of two tiles may be millions."""
    from wattline.llm.vectors import Strip

    x = unit_rows(np.ones((300, 4)) + np.arange(300)[:, None] * 1e-5)
    strip, one = Strip(0.9), np.ones(100, np.int64)
    for k in range(2):
        strip.hold(np.arange(100) + 100 * k, one, x[100 * k : 100 * k + 100], True)
    other = strip.meet(np.arange(200, 300), one, x[200:])
    rest = strip.rest()
    assert len(other) == 200 and set(other["links"].dropna()) == {200} and set(other["root"].dropna()) == {0}
    assert len(rest) == 200 + 199 and set(rest["links"].dropna()) == {299} and set(rest["root"].dropna()) == {0}
