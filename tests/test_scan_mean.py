"""Means whose noise is that of a scan."""

import math
import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
from compare import TABLES, compare, connect
from pyspark.sql import functions as F

from wattline.functions.means import scan_mean

SMALL = Path("/root/testdata/sf0.001")


def shown(price: float) -> int:
    return math.floor(price / 500.0 / 0.997 * 1000 + 0.5)


def on_an_edge(seed: int) -> list[float]:
    """Eight prices whose mean lies between two texts, and whose sum by order falls on the other side than the exact sum."""
    rng = random.Random(seed)
    while True:
        cents = [rng.randrange(1, 9000) for _ in range(7)]
        cents.append(997 * (2 * rng.randrange(10, 30) + 1) - sum(cents))
        values = [c / 100 for c in cents]
        total = 0.0
        for v in values:
            total += v
        if cents[-1] >= 0 and shown(total / 8) != shown(sum(cents) / 100 / 8):
            return values


def test_values_are_added_by_order_whatever_the_rows(spark):
    values = on_an_edge(1)
    rows = [(k, i, v) for k in range(2) for i, v in enumerate(values)] + [(0, 99, None), (2, 0, None)]
    want = 0.0
    for v in values:
        want += v
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, i long, v double").repartition(3)
        got = {r.k: r.m for r in df.groupBy("k").agg(scan_mean(F.col("v"), F.col("i")).alias("m")).collect()}
        assert got == {0: want / 8, 1: want / 8, 2: None}


def test_candidate_texts_on_a_rounding_edge_agree_with_sql(spark, tmp_path):
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(SMALL / f"{t}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE e AS SELECT * FROM '{SMALL}/events.parquet' ORDER BY event_id")
    (first, top, user) = con.execute("SELECT min(ts)::DATE, max(event_id), min(user_id) FROM e WHERE user_id IN (SELECT c_custkey FROM '%s/customer.parquet')" % SMALL).fetchone()
    taken = {r[0] for r in con.execute("SELECT date_diff('minute', min(ts) OVER (), ts) // 15 FROM e").fetchall()}
    start = datetime(first.year, first.month, first.day)
    for seed in range(6):
        slot = next(s for s in range(960 + 96 * seed, 2000) if not taken & {s - 1, s, s + 1})
        for v in on_an_edge(seed):
            top += 1
            con.execute("INSERT INTO e VALUES (?, ?, ?, 'view', ?, '{}')", [top, start + timedelta(minutes=15 * slot + 7), user, v])
    con.execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    ok, note = compare(spark, connect(str(tmp_path)), str(tmp_path), "fmt_blocks_candidate")
    assert ok, note
