import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm.catalog import QUERIES
from wattline.llm.common import components, small_frames
from wattline.llm.jaccard import block_digests, jaccard_components, keep_one, linked_pairs, shingle_set

from .conftest import SMALL


def brute(rows, width, percent):
    """Components by comparing every pair of documents; rows that share an id are one document."""
    sets = [(i, set(shingle_set(t, width).tolist())) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def texts_with_copies(n=220, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    out = [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 20, 45, 120]))] for _ in range(n)]
    for k in range(n):
        base = list(out[rng.randrange(n)])
        for _ in range(rng.randrange(4)):
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
        out.append(base)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_against_all_pairs(spark, width, percent):
    rows = texts_with_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    want = brute(rows, width, percent)
    assert got == {i: (len(shingle_set(t, width)), want[i]) for i, t in rows}


def test_blocked_product_finds_every_pair():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 10**6, n).astype(np.uint64)) for n in (5, 40, 41, 300, 5000)]
    sets = [np.unique(np.append(b[: len(b) - d], rng.integers(2 * 10**6, 10**7, d).astype(np.uint64))) for b in base for d in (0, 0, 1, 2, len(b) // 12)]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 190 * len(np.intersect1d(sets[i], sets[j])) >= 90 * (len(sets[i]) + len(sets[j]))}
    assert set(linked_pairs(sets, None, 90)) == want
    across = {(i, j) for i, j in want if i < 10 <= j}
    assert {(i, j + 10) for i, j in linked_pairs(sets[:10], sets[10:], 90)} == across
    for i, j in want:
        assert np.intersect1d(block_digests(sets[i], 90), block_digests(sets[j], 90)).size


def test_odd_rows(odd_docs, odd_rows, no_docs):
    clash = odd_docs.withColumn("n_shingles", F.lit("x")).withColumn("component_id", F.lit("y"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(clash, 3, 90).collect()), key=str)
    want = brute([(r[0], r[1]) for r in odd_rows], 3, 90)
    assert got == sorted(((i, len(shingle_set(t, 3)), want.get(i)) for i, t, *_ in odd_rows), key=str)
    assert jaccard_components(no_docs).count() == 0
    left = sorted((r.doc_id for r in keep_one(odd_docs).collect()), key=str)
    gone = {i for i, c in brute([(r[0], r[1]) for r in odd_rows], 5, 80).items() if c != i}
    assert left == sorted((r[0] for r in odd_rows if r[0] not in gone), key=str)


def test_python_gets_small_frames(spark):
    """Long rows come in frames of about the bytes asked for, not 10 000 rows at once, and the session's own bound comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    with small_frames(spark, "1m"):
        most = rows.mapInPandas(lambda frames: (f.assign(text=f["text"].str.len().sum())[:1] for f in frames), "text long").agg(F.max("text")).first()[0]
    assert most <= 2 << 20 and spark.conf.get(name) == before


def test_a_set_has_one_tag_per_class():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9, 400):
        keys, tags = block_digests(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), 80)
        assert len(keys) == len(tags) and len(np.unique(tags)) == 2 and (np.diff(tags) >= 0).all()


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 9), (None, 3), (7, 8), (8, 7), *[(i, i + 1) for i in range(100, 160)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {3: 3, 4: 3, 5: 3, 7: 7, 8: 7, **dict.fromkeys(range(100, 161), 100)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_ngram_jaccard"](spark, SMALL).collect()}
    want = brute(rows, 3, 90)
    assert got == {i: (len(shingle_set(t, 3)), want[i]) for i, t in rows}
