"""Blending, offset calibration, rules and threshold searches.

Small grids (weights, shrinks, thresholds) become aggregate columns, so one
pass over the rows scores the whole grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.arrays import clip
from wattline.functions.quantile import exact_quantiles

# First and last slot of each price regime; the first one wraps at midnight.
REGIMES = {"floor": (78, 17), "solar": (18, 39), "mid": (40, 65), "evening": (66, 77)}


def regime_tag(slot: Column) -> Column:
    expr = None
    for name, (lo, hi) in REGIMES.items():
        inside = ((slot >= lo) | (slot <= hi)) if lo > hi else slot.between(lo, hi)
        expr = F.when(inside, name) if expr is None else expr.when(inside, name)
    return expr


def relative_mape(pred: Column, target: Column, floor: float) -> Column:
    return F.avg(F.abs(pred - target) / F.greatest(F.abs(target), F.lit(floor)))


def score_grid(df: DataFrame, candidates: dict[tuple, Column], names: Sequence[str], by: Sequence[str], floor: float, target: str = "target") -> DataFrame:
    """Mean daily relative accuracy of every candidate forecast: ``(by…, names…, score)``."""
    points = list(candidates)
    cols = [relative_mape(candidates[p], F.col(target), floor).alias(f"_c{i}") for i, p in enumerate(points)]
    extra = [] if "day" in by else ["day"]
    days = df.groupBy(*by, *extra).agg(*cols)
    means = days.groupBy(*by).agg(*[F.avg(F.greatest(F.lit(0.0), 1 - F.col(f"_c{i}"))).alias(f"_c{i}") for i in range(len(points))])
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, p, strict=True)], F.col(f"_c{i}").alias("score")) for i, p in enumerate(points)]
    return means.select(*by, F.explode(F.array(*rows)).alias("g")).select(*by, "g.*")


def first_best(grid: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The first point in grid order with the highest score."""
    point = F.struct(*names)
    best = F.max_by(point, F.struct("score", *[(-F.col(n)).alias(f"_m{n}") for n in names]))
    return grid.groupBy(*by).agg(best.alias("g"), F.max("score").alias("score")).select(*by, "g.*", "score")


def blend(weight: Column, a: str = "prediction_base", b: str = "prediction_seq") -> Column:
    return weight * F.col(a) + (1 - weight) * F.col(b)


def blend_search(val: DataFrame, by: Sequence[str] = ("series",), floor: float = 40.0, steps: int = 10) -> DataFrame:
    """Weight of the first model, 0 to 1, with the first best mean relative accuracy."""
    grid = {(i / steps,): blend(F.lit(i / steps)) for i in range(steps + 1)}
    return first_best(score_grid(val, grid, ["weight"], by, floor), by, ["weight"])


def slot_offsets(val: DataFrame, group: int, limit: float, by: Sequence[str] = ("series",)) -> DataFrame:
    """Mean residual per slot group, clipped to ``±limit``."""
    if 96 % group:
        raise ValueError("the slot group must divide 96")
    mean = F.avg(F.col("target") - F.col("prediction"))
    return val.groupBy(*by, F.floor(F.col("slot") / group).alias("slot_group")).agg(clip(mean, -limit, limit).alias("offset"))


def apply_slot_offsets(df: DataFrame, offsets: DataFrame, group: Column, shrink: Column, floor: float, cap: float, on: Sequence[str] = ("series", "slot_group")) -> DataFrame:
    out = df.withColumn("slot_group", F.floor(F.col("slot") / group)).join(offsets, list(on), "left")
    out = out.withColumn("point_offset", F.coalesce("offset", F.lit(0.0)) * shrink).withColumnRenamed("prediction", "candidate_prediction")
    out = out.withColumn("prediction", clip(F.col("candidate_prediction") + F.col("point_offset"), floor, cap))
    return out.select(
        *[c for c in df.columns if c != "prediction"], "slot_group", "point_offset", "candidate_prediction", "prediction",
        (F.col("target") - F.col("candidate_prediction")).alias("residual"), (F.col("prediction") - F.col("target")).alias("calibrated_error"),
    )


def slot_offset_search(
    val: DataFrame, groups: Sequence[int], shrinks: Sequence[float], limit: float, floor: float, cap: float, by: Sequence[str] = ("series",)
) -> DataFrame:
    """Scores of every (group size, shrink), best first per key: ``rank`` 1 is the choice.

    Ranked by relative accuracy, then lower error, then smaller group, then smaller shrink.
    """
    sizes = F.explode(F.array(*[F.lit(g) for g in groups]))
    sized = val.withColumn("group_size", sizes).withColumn("slot_group", F.floor(F.col("slot") / F.col("group_size")))
    mean = F.avg(F.col("target") - F.col("prediction"))
    offsets = sized.groupBy(*by, "group_size", "slot_group").agg(clip(mean, -limit, limit).alias("offset"))
    rows = sized.join(offsets, [*by, "group_size", "slot_group"])
    t = F.col("target")
    aggs = []
    for i, s in enumerate(shrinks):
        p = clip(F.col("prediction") + F.col("offset") * F.lit(s), floor, cap)
        aggs += [relative_mape(p, t, floor).alias(f"_r{i}"), F.avg(F.abs(p - t)).alias(f"_e{i}")]
    days = rows.groupBy(*by, "group_size", "day").agg(*aggs)
    means = days.groupBy(*by, "group_size").agg(
        *[F.avg(F.greatest(F.lit(0.0), 1 - F.col(f"_r{i}"))).alias(f"_r{i}") for i in range(len(shrinks))],
        *[F.avg(f"_e{i}").alias(f"_e{i}") for i in range(len(shrinks))],
    )
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("shrink"), F.col(f"_r{i}").alias("score"), F.col(f"_e{i}").alias("mae")) for i, s in enumerate(shrinks)]))
    out = means.select(*by, "group_size", grid.alias("g")).select(*by, "group_size", "g.*")
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("mae"), F.asc("group_size"), F.asc("shrink"))
    return out.withColumn("rank", F.row_number().over(w))


def fit_offset_bins(train: DataFrame, value: str, bins: int) -> DataFrame:
    """One row per bin: quantile edges and the mean of the values inside (midpoint if empty)."""
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(train, [], value, names)
    edge = edges.select(F.array(*names).alias("edges")).scalar()
    marked = train.select(F.col(value).alias("_x"), edge.alias("_e"))
    inside = marked.select("_x", assign_bin(F.col("_x"), F.col("_e"), bins).alias("bin")).groupBy("bin").agg(F.avg("_x").alias("_mean"))
    frame = edges.select(F.posexplode(F.array(*[F.struct(F.col(f"e{i}").alias("lo"), F.col(f"e{i + 1}").alias("hi")) for i in range(bins)])).alias("bin", "r"))
    return frame.join(inside, "bin", "left").select(
        "bin", "r.lo", "r.hi", F.coalesce("_mean", (F.col("r.lo") + F.col("r.hi")) / 2).alias("center")
    )


def assign_bin(x: Column, edges: Column, bins: int) -> Column:
    """Number of inner edges at or below ``x``."""
    return sum(((edges[i] <= x).cast("int") for i in range(1, bins)), F.lit(0))


def apply_day_offset(candidate: Column, offset: Column, limit: float, scale: float, floor: float, cap: float) -> Column:
    return clip(candidate + clip(offset, -limit, limit) * F.lit(scale), floor, cap)


def two_stage(pred: Column, floor_p: Column, peak_p: Column, floor_at: Column | float, peak_at: Column | float, floor: float, cap: float) -> Column:
    """Clip, then a likely floor slot takes the floor price, else a likely peak the cap."""
    return F.when(floor_p >= floor_at, F.lit(floor)).when(peak_p >= peak_at, F.lit(cap)).otherwise(clip(pred, floor, cap))


def threshold_search(
    val: DataFrame, floors: Sequence[float], peaks: Sequence[float], floor: float, cap: float, by: Sequence[str] = ("regime",)
) -> DataFrame:
    """First best pair of probability thresholds per key by mean daily relative accuracy.

    A "day" is one (series, day); rows need ``prediction, floor_p, peak_p, target``.
    """
    grid = {
        (f, p): two_stage(F.col("prediction"), F.col("floor_p"), F.col("peak_p"), f, p, floor, cap) for f in floors for p in peaks
    }
    scored = score_grid(val.withColumn("day", F.struct("series", "day")), grid, ["floor_at", "peak_at"], by, floor)
    return first_best(scored, by, ["floor_at", "peak_at"])


def linear_calibration(train: DataFrame, rows: DataFrame, pred: str, truth: str, out: str = "calibrated") -> DataFrame:
    """Least-squares ``truth = slope * pred + intercept`` on ``train``, applied to ``rows``; one aggregate, as a scalar subquery."""
    fit = train.agg(F.struct(F.regr_slope(truth, pred).alias("slope"), F.regr_intercept(truth, pred).alias("intercept")).alias("f")).scalar()
    fitted = rows.withColumn("slope", fit["slope"]).withColumn("intercept", fit["intercept"])
    return fitted.withColumn(out, F.col("slope") * F.col(pred) + F.col("intercept"))
