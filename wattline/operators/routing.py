"""Routing labels, seeded samples and protocol tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.blocks import row_index
from wattline.functions.nodes import FIELD_ALIASES, expert_label
from wattline.functions.quantile import exact_quantiles
from wattline.functions.ranking import seeded_order


def route_meta(nodes: DataFrame) -> DataFrame:
    """Labels from metadata: a numeric ``expert_id`` if every node has one, else the first zone-like column."""
    zone = next((c for c in FIELD_ALIASES["zone_type"] if c in nodes.columns), None)
    by_zone = expert_label(F.col(zone).cast("string")) if zone else F.lit(None).cast("int")
    if "expert_id" not in nodes.columns:
        return nodes.withColumn("label", by_zone)
    number = F.col("expert_id").cast("string").try_cast("double")
    complete = nodes.agg(F.min(number.isNotNull())).scalar()
    return nodes.withColumn("label", F.when(complete, number.cast("int")).otherwise(by_zone))


def route_proxy(obs: DataFrame, node: str = "node_idx", value: str = "value") -> DataFrame:
    """Without metadata: nodes whose mean reaches the median of means get label 0, the rest 1."""
    means = obs.groupBy(node).agg(F.avg(value).alias("mean"))
    mid = exact_quantiles(means, [], "mean", {"mid": 0.5}).select("mid").scalar()
    return means.withColumn("label", F.when(F.col("mean") >= mid, 0).otherwise(1))


def route_split(items: DataFrame, labels: DataFrame, node: str = "node_idx") -> DataFrame:
    return items.join(labels.select(node, F.col("label").alias("expert")), node)


def sample_head(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_seeded(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    return df.orderBy(seeded_order(seed, *key)).limit(n)


def seeded_rank(df: DataFrame, keys: Sequence[str], ident: str, seed: int, out: str = "pick") -> DataFrame:
    """1-based seeded rank per key, numbered by hash prefix so that a big group is not one task."""
    h = df.withColumn("_h", seeded_order(seed, ident))
    return row_index(h, keys, ["_h", ident], F.substring("_h", 1, 2), out).withColumn(out, F.col(out) + 1).drop("_h")


def nodes_balanced(nodes: DataFrame, cap: int, seed: int, domain: str = "zone_type") -> DataFrame:
    """The same number of nodes from each domain: the smallest domain's size, at most ``cap``."""
    sizes = nodes.groupBy(domain).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n")).scalar()
    limit = F.least(smallest, F.lit(cap)) if cap > 0 else smallest
    return seeded_rank(nodes, [domain], "node_idx", seed).where(F.col("pick") <= limit)


def _source_total(total: Column, ratio: float) -> Column:
    n = F.greatest(F.lit(1), F.floor(total * F.lit(ratio)))
    return F.when(n >= total, total - 1).otherwise(n).cast("long")


def split_source_nodes(nodes: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Seeded source / target split with at least one target."""
    total = nodes.agg(F.count(F.lit(1))).scalar()
    ranked = seeded_rank(nodes, [], "node_idx", seed + int(ratio * 1000))
    return ranked.withColumn("role", F.when(F.col("pick") <= _source_total(total, ratio), "source").otherwise("target"))


def apportion(counts: DataFrame, label: str, size: str, exact: Column, budget: Column) -> DataFrame:
    """Largest-remainder quotas of ``budget`` over a small table of groups; never above a group's size."""
    base = counts.withColumn("_exact", exact).withColumn("_base", F.least(F.col(size), F.floor("_exact")))
    everything = Window.partitionBy(F.lit(0))
    open_first = everything.orderBy(F.desc(F.when(F.col("_base") < F.col(size), F.col("_exact") - F.col("_base")).otherwise(-1.0)), F.asc(label))
    left = F.greatest(F.lit(0), budget - F.sum("_base").over(everything))
    extra = (F.col("_base") < F.col(size)) & (F.row_number().over(open_first) <= left)
    return base.withColumn("quota", (F.col("_base") + extra.cast("int")).cast("long")).drop("_exact", "_base")


def stratified_source_nodes(nodes: DataFrame, label: str, ratio: float, seed: int) -> DataFrame:
    """Source nodes by largest-remainder quotas per label, picked in seeded order."""
    sizes = nodes.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = nodes.agg(F.count(F.lit(1))).scalar()
    quotas = apportion(sizes, label, "n", F.col("n") * F.lit(ratio), _source_total(total, ratio))
    ranked = seeded_rank(nodes, [label], "node_idx", seed + round(ratio * 1000))
    return ranked.join(quotas.drop("n"), label).withColumn("role", F.when(F.col("pick") <= F.col("quota"), "source").otherwise("target"))


def distribute_cap(counts: DataFrame, label: str, size: str, cap: int) -> DataFrame:
    """Split a total budget over groups in proportion; no cap, or one that is not reached, keeps all."""
    total = F.sum(size).over(Window.partitionBy(F.lit(0)))
    sized = counts.withColumn("_total", total)
    out = apportion(sized, label, size, F.lit(float(cap)) * F.col(size) / F.col("_total"), F.lit(cap))
    free = (F.lit(cap) <= 0) | (F.col("_total") <= cap)
    return out.withColumn("quota", F.when(free, F.col(size)).otherwise(F.col("quota")).cast("long")).drop("_total")


def fewshot_prefix(n_windows: Column, n_test: Column, n_nodes: Column, ratios: Sequence[float], spark_one: DataFrame) -> DataFrame:
    """Window and item counts per ratio: the first ``max(1, int(n * ratio))`` windows."""
    base = spark_one.select(F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio"))
    count = F.greatest(F.lit(1), F.floor(n_windows * F.col("ratio"))).cast("long")
    return base.select("ratio", count.alias("train_window_count"), n_test.alias("test_window_count"), n_nodes.alias("node_count"), (count * n_nodes).alias("train_item_count"))


def windows_by_ratio(starts: DataFrame, n_windows: Column, ratios: Sequence[float]) -> DataFrame:
    """Member windows of every ratio, from ``starts(win, …)`` numbered from 0."""
    tagged = starts.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return tagged.where(F.col("win") < F.greatest(F.lit(1), F.floor(n_windows * F.col("ratio"))))
