import pytest
from pyspark.sql import functions as F

from wattline.functions.ranking import global_rank, sorted_ranges
from wattline.operators.select import keep_best


@pytest.mark.parametrize("score", ["sin(id)", "1.5", "id % 3"])
def test_ranks_of_many_rows(spark, score):
    """10^5 rows with distinct, equal or few scores: right ranks, and no range that holds most of the rows."""
    n = 100_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(n, numPartitions=4).select("id", F.expr(f"cast({score} as double)").alias("score"))
    got = global_rank(rows, [F.desc("score"), F.asc("id")])
    found = got.toPandas().sort_values("pos")
    want = rows.toPandas().sort_values(["score", "id"], ascending=[False, True])
    assert found["id"].tolist() == want["id"].tolist() and found["pos"].tolist() == list(range(1, n + 1)) and set(found["total"]) == {n}
    ranges = sorted_ranges(rows, [F.desc("score"), F.asc("id")]).groupBy("_part").count().toPandas()["count"]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) == 4 and ranges.max() < 0.4 * n


def test_one_task_sees_one_row_per_range_only(spark):
    plan = global_rank(spark.range(1000).select("id"), [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    for window in plan.split("Window")[1:]:
        assert "count(1)" in window and "_n" in window  # below every one-task step lies the count per range


def test_best_share_of_ties_and_of_nothing(spark):
    rows = spark.range(10).select("id", F.lit(2.0).alias("score"))
    assert [r.id for r in keep_best(rows, ["id"], 0.31).orderBy("pos").collect()] == [0, 1, 2, 3]
    assert keep_best(rows.limit(0), ["id"], 0.5).count() == 0
    assert [r.id for r in keep_best(rows, ["id"], 0.0).collect()] == [0]
