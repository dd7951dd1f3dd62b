import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm.catalog import QUERIES
from wattline.llm.sharding import permute, row_at, shard_rows, unpermute

from .conftest import SMALL


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_and_inverse(n):
    p = permute(np.arange(n), n, seed=5)
    assert sorted(p.tolist()) == list(range(n)) and unpermute(p, n, seed=5).tolist() == list(range(n))


def test_seeds_differ_and_shuffle_moves():
    a, b = (permute(np.arange(5000), 5000, s) for s in (0, 1))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.1


def check(rows, texts, shards):
    assert sorted(zip((r.size for r in rows), (r.text_crc32 for r in rows), strict=True)) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min((sizes[s] for s in range(shards)), default=0) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        assert row_at(r.shard, r.slot, len(rows), shards) == r.row_number


def test_odd_rows(odd_docs, odd_rows, no_docs):
    clash = odd_docs.withColumn("size", F.lit("x")).withColumn("shard", F.lit("y"))
    check(shard_rows(clash, 3).collect(), [r[1] for r in odd_rows], 3)
    assert shard_rows(no_docs).count() == 0


def test_same_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = ({r.doc_id: (r.shard, r.slot) for r in shard_rows(d).collect()} for d in (docs, docs.repartition(7)))
    assert a == b


def test_query(spark):
    rows = QUERIES["op2_feistel_shards"](spark, SMALL).collect()
    check(rows, [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()], 16)
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
