import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators import retrieval


def cells(spark, n=40, nodes=30, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, nodes, 2)).round(3)
    rows = [(t, p, i, float(v[t, i, p])) for t in range(n) for i in range(nodes) for p in range(2)]
    return spark.createDataFrame(rows, "id long, part int, idx long, v double"), v.reshape(n, -1)


@pytest.mark.parametrize("before", [True, False])
def test_node_blocks_give_the_distances_of_whole_vectors(spark, monkeypatch, before):
    table, v = cells(spark)
    for name, value in (("WINDOW_BLOCK", 7), ("NODE_BLOCK", 4), ("BLOCKS_TOGETHER", 2)):
        monkeypatch.setattr(retrieval, name, value)
    got = {}
    for r in retrieval.knn_long(table, table, 3, strictly_before=before).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.p_id, r.dist))
    for q in range(len(v)):
        d = ((v - v[q]) ** 2).sum(1).round(6)
        want = sorted((d[p], p) for p in range(q if before else len(v)))[:3]
        assert [(p, pytest.approx(x, abs=2e-6)) for x, p in want] == [(p, x) for _, p, x in sorted(got.get(q, []))]


def test_missing_cells_count_as_zero_and_big_values_keep_digits(spark):
    rows = [(0, 0, 5, 1e6), (1, 0, 5, 1e6 + 1), (1, 0, 9000, 3.0), (2, 0, 5, 1e6 + 2)]
    table = spark.createDataFrame(rows, "id long, part int, idx long, v double")
    got = {(r.q_id, r.p_id): r.dist for r in retrieval.knn_long(table, table, 5).where("q_id <> p_id").collect()}
    assert got == {(0, 1): 10.0, (1, 0): 10.0, (0, 2): 4.0, (2, 0): 4.0, (1, 2): 10.0, (2, 1): 10.0}
    assert retrieval.knn_long(table.limit(0), table.limit(0), 2).count() == 0


def test_columns_are_numbered_by_part_then_node(spark):
    rows = [(t, p, i, float(t)) for t in range(2) for p, i in ((2, 1), (0, 700), (0, 5), (1, 3))]
    got = retrieval.numbered_vectors(spark.createDataFrame(rows, "t_start long, part int, idx long, v double"))
    assert sorted((r.t_start, r.i) for r in got.collect()) == [(t, i) for t in range(2) for i in range(4)]
    columns = {(r.part, r.idx): r.i for r in retrieval.vector_columns(spark.createDataFrame(rows, "t_start long, part int, idx long, v double")).collect()}
    assert columns == {(0, 5): 0, (0, 700): 1, (1, 3): 2, (2, 1): 3}


def test_a_wide_window_is_many_keys(spark, monkeypatch):
    """50 windows of many nodes, all asking for one past window: no partition gets more than twice the median."""
    monkeypatch.setattr(retrieval, "NODE_BLOCK", 16)
    facts = spark.range(4000).select(F.lit(0).cast("long").alias("p_t"), F.col("id").alias("node_idx"), F.lit(1.0).alias("occ"))
    asked = spark.range(1, 51).select(F.col("id").alias("q_t"), F.lit(0).cast("long").alias("p_t"))
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in options.items():
        spark.conf.set(name, value)
    out = retrieval.retrieved_rows(asked, facts)
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    for name in options:
        spark.conf.unset(name)
    assert out.count() == 50 * 4000 and len(sizes) > 1 and sizes.max() <= 2 * sizes.median()


@pytest.mark.parametrize("before", [True, False])
def test_tiles_and_blocks_give_the_nearest_by_brute_force(spark, monkeypatch, before):
    """Whole-number vectors, so that many distances tie; ids have holes."""
    for name, value in (("TILE", 200), ("QUERY_ROWS", 32), ("FIRST_ROWS", 8)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(3)
    ids = sorted(int(i) for i in rng.choice(900, 500, replace=False))
    v = rng.integers(0, 4, (500, 5)).astype(float)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, vec array<float>")
    got = {}
    for r in retrieval.knn(table, table, 4, strictly_before=before, block=16).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.p_id, r.dist))
    for n, q in enumerate(ids):
        d = ((v - v[n]) ** 2).sum(1)
        want = sorted((d[m], p) for m, p in enumerate(ids) if not before or p < q)[:4]
        assert [(p, x) for x, p in want] == [(p, x) for _, p, x in sorted(got.get(q, []))]


def test_tiles_grow_with_the_ids(spark):
    """600000 ids: a vector is sent to at most ten tiles of the other side, not to thirty-seven; a few ids stay one tile."""
    table = spark.range(0, 600_000, 5000).select("id", F.array(F.col("id").cast("float")).alias("vec")).unionByName(spark.range(599_999, 600_000).select("id", F.array(F.lit(1.0).cast("float")).alias("vec")))
    for side, key in zip(retrieval.paired_tiles(table, table, [], False), ("q_id", "p_id"), strict=True):
        assert 6 <= side.groupBy(key).count().agg(F.max("count")).first()[0] <= 10
    q, p = (s.count() for s in retrieval.paired_tiles(table, table, [], True))
    assert q + p <= 11 * table.count()
    known = retrieval.paired_tiles(table, table, [], True, F.lit(599_999))
    assert sum(s.count() for s in known) == q + p
    got = {(r.q_id, r["rank"]): r.p_id for r in retrieval.knn(table.where("id % 5000 = 0"), table.where("id % 5000 = 0"), 1, strictly_before=True).collect()}
    assert got == {(i, 1): i - 5000 for i in range(5000, 600_000, 5000)}


def test_a_vector_is_sent_once_per_tile(spark):
    """1000 ids are one tile, also where products take 16 pool rows at a time."""
    table = spark.range(1000).select("id", F.array(F.col("id").cast("float")).alias("vec"))
    for side in retrieval.paired_tiles(table, table, [], False):
        assert side.count() == 1000 and "array<float>" in dict(side.dtypes).values()
    plan = retrieval.knn(table, table, 2, block=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 16.0" not in plan


def test_facts_and_cells_are_read_once(spark):
    """Differences by hand, from one scan of the facts; numbered vectors do not make their cells a second time."""
    fields = ["occ", "temp", "price", "ghi", "dni", "tsi", "wind"]
    rows = [(t, n, float(10 * t + n), None if t < 2 else float(t), *[None] * 5) for t in range(4) for n in range(3) if (t, n) != (3, 2)]
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return v

    table = spark.createDataFrame(rows, "t_start long, node_idx long, " + ", ".join(f"{c} double" for c in fields)).withColumn("occ", counted("occ"))
    asked = spark.createDataFrame([(2, 0), (2, 1), (3, 2), (3, 0)], "q_t long, p_t long")
    got = {(r.t_start, r.node_idx): (r.retrieved, r.diff_occ, r.diff_temp, r.diff_price) for r in retrieval.diff_features(asked, table).collect()}
    want = {(2, n): (2, 15.0, 2.0, None) for n in range(3)} | {(3, n): (2, 20.0, 1.0, None) for n in range(2)}
    assert got == want and made.value == len(rows)
    apart = retrieval.diff_features(asked, table, table)
    assert {(r.t_start, r.node_idx): (r.retrieved, r.diff_occ, r.diff_temp, r.diff_price) for r in apart.collect()} == want

    seen = made.value
    cells = spark.range(20).select(F.col("id").alias("t_start"), F.lit(0).alias("part"), F.lit(5).cast("long").alias("idx"), counted(F.col("id").cast("double")).alias("v"))
    assert retrieval.numbered_vectors(cells).count() == 20 and made.value - seen == 20


def test_pieces_of_a_block_are_not_joined_by_its_number(spark):
    """Few blocks of windows hold a wide graph: a join by the block would send all its pieces to one task."""
    rows = [(t, p, i, float(t * i % 5)) for t in range(4) for p in (0, 1) for i in (3, 5000, 9000)]
    table = spark.createDataFrame(rows, "id long, part int, idx long, v double")
    plan = retrieval.knn_long(table, table, 2, strictly_before=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_windows_that_some_pieces_lack(spark, monkeypatch):
    """Each part and block of nodes knows other windows; what it lacks counts as 0."""
    for name, value in (("WINDOW_BLOCK", 4), ("NODE_BLOCK", 2), ("BLOCKS_TOGETHER", 1)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(5)
    v = np.where(rng.random((9, 2, 7)) < 0.3, rng.normal(0, 3, (9, 2, 7)), 0.0)
    v[4] = 0
    v[4, 0, 0] = 1.5
    rows = [(t, p, i, float(v[t, p, i])) for t, p, i in zip(*np.nonzero(v), strict=True)]
    table = spark.createDataFrame([tuple(int(x) for x in r[:3]) + r[3:] for r in rows], "id long, part int, idx long, v double")
    got = {(r.q_id, r.p_id): r.dist for r in retrieval.knn_long(table, table, 9).collect()}
    flat, known = v.reshape(9, -1), {r[0] for r in rows}
    assert got == {(q, p): pytest.approx(((flat[q] - flat[p]) ** 2).sum(), abs=2e-6) for q in known for p in known}
