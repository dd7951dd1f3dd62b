"""Exact quantiles by narrowing, for groups too big for one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here values are first counted, then binned by an order-preserving function of the value alone. Only the bins that hold a
wanted rank are looked into; while one of them still has many distinct values it is cut again, evenly between its smallest and
largest value, all groups and ranks in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 64


def order_bin(v: Column) -> Column:
    """A non-decreasing integer function of ``v``; about 1 % wide away from 0."""
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(1e-12))) * BINS_PER_OCTAVE).cast("long") + F.lit(4000)
    size = F.greatest(size, F.lit(1).cast("long"))
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


#: Distinct values that one task sorts at the end, and cells of one narrowing; the rounds that separate any two doubles.
SMALL, CELLS, MOST_ROUNDS = 4096, 4096, 12


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (linear interpolation).

    NULL values are left out, and so are groups that hold no value. ``weight`` names a column that says how often a row
    counts, so that counted values can be used again. The counts are written once; each narrowing reads them again.
    """
    from wattline.sources.sinks import written

    given, keys = list(keys), [*keys, "_all"]  # the constant key makes a table without keys no special case
    counts = df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0)).groupBy(*keys, F.col(value).cast("double").alias("_v"))
    counts = written(counts.agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")), "counts")
    ends = [*keys, "_lo", "_hi"]

    bins = _cells(counts.withColumn("_cell", order_bin(F.col("_v"))), keys)
    every = Window.partitionBy(*keys)
    placed = bins.select("*", F.sum("_n").over(every).alias("_total"))
    wants = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            wants.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.cast("long").alias("rank"), (at - rank).alias("part")))
    wanted = placed.withColumn("w", F.explode(F.array(*wants)))
    inside = (F.col("w.rank") >= F.col("_ahead")) & (F.col("w.rank") < F.col("_ahead") + F.col("_n"))
    wanted = wanted.where(inside).select(*ends, "_k", "w.name", "w.side", (F.col("w.rank") - F.col("_ahead")).alias("rank"), "w.part")
    wanted = written(wanted, "ranks")
    for _ in range(MOST_ROUNDS):
        large = (F.col("_k") > SMALL) & (F.col("_lo") < F.col("_hi"))
        if wanted.where(large).isEmpty():
            break
        within = counts.join(wanted.where(large).select(*ends).distinct(), keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        cells = _cells(within.withColumn("_cell", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("long")).withColumnsRenamed({"_lo": "_from", "_hi": "_to"}), [*keys, "_from", "_to"])
        asked = wanted.where(large).drop("_k").withColumnsRenamed({"_lo": "_from", "_hi": "_to"}).join(cells, [*keys, "_from", "_to"])
        inside = (F.col("rank") >= F.col("_ahead")) & (F.col("rank") < F.col("_ahead") + F.col("_n"))
        narrowed = asked.where(inside).select(*ends, "_k", "name", "side", (F.col("rank") - F.col("_ahead")).alias("rank"), "part")
        wanted = written(wanted.where(~large).unionByName(narrowed), "ranks")
    hits = wanted.groupBy(*ends).agg(F.collect_list(F.struct("name", "side", "rank", "part")).alias("_wants"))
    running = Window.partitionBy(*ends).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.join(hits, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi"))).withColumn("_end", F.sum("_c").over(running))
    mine = F.filter("_wants", lambda x: (x["rank"] < F.col("_end")) & (x["rank"] >= F.col("_end") - F.col("_c")))
    chosen = found.select(*given, "_all", "_v", F.explode(mine).alias("w"))

    def pick(name: str, side: str, col: Column) -> Column:
        return F.max(F.when((F.col("w.name") == name) & (F.col("w.side") == side), col))

    out = []
    for name in probs:
        lo, hi = (pick(name, side, F.col("_v")) for side in ("lo", "hi"))
        out.append((lo + pick(name, "lo", F.col("w.part")) * (hi - lo)).alias(name))
    return chosen.groupBy(*keys).agg(*out).drop("_all")


def _cells(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``_cell``: rows (``_n``), distinct values (``_k``), its ends, and the rows of the cells before it (``_ahead``)."""
    per = binned.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_cell")
