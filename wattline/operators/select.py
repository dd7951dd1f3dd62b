"""Scoring, ranking and case selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.arrays import afirst, alast, amean, astd, clamped_delta, clip
from wattline.functions.blocks import framed
from wattline.functions.quantile import exact_quantiles
from wattline.functions.ranking import global_rank, top_per_group
from wattline.operators.retrieval import retrieved_rows
from wattline.sources.sinks import written

NOISE = 9  # ranking keys are rounded, so that float noise does not order equal windows


def source_score(x: Column, y: Column, irradiance: Column, weight: float = 0.001) -> Column:
    """How informative a renewable source window is: spread, ramps and sunshine."""
    score = astd(x) + astd(y) + F.abs(clamped_delta(x, 4)) + F.abs(alast(y) - afirst(y)) + F.lit(weight) * F.greatest(F.lit(0.0), irradiance)
    return F.round(F.nanvl(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), NOISE)


def price_score(x: Column, y: Column, floor: float = 0.04) -> Column:
    """How informative a price window is: range, peaks and departures from the price floor."""
    gap = F.aggregate(y, F.lit(0.0), lambda acc, v: acc + F.abs(v - floor)) / F.size(y)
    score = (
        2.0 * astd(y) + 1.5 * (F.array_max(y) - F.array_min(y)) + gap + 0.5 * F.greatest(F.lit(0.0), F.array_max(y) - floor)
        + 0.5 * astd(x) + 0.5 * F.abs(alast(y) - afirst(y))
    )
    return F.round(F.nanvl(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), NOISE)


def keep_best(scored: DataFrame, arrival: Sequence[str], ratio: float, most: int = 0) -> DataFrame:
    """The best ``ceil(total * ratio)`` items (or ``most``), score first, then arrival; adds ``pos``.

    Items are dealt into sampled ranges of (score, arrival), so no task sorts them all, also where all scores are equal.
    """
    order = [F.desc("score"), *[F.asc(c) for c in arrival]]
    if most > 0:
        # a list of a given length: the top-k is found per partition before one task numbers it
        top = scored.orderBy(*order).limit(most)
        return top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    ranked = global_rank(scored, order)
    return ranked.where(F.col("pos") <= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(ratio)))).drop("total")


SCENARIOS = ("low_valley", "rapid_rise", "peak_plateau", "rapid_drop", "high_volatility", "weather_shift")


def scenario_scores(windows: DataFrame) -> DataFrame:
    """One sort key per scenario (higher is better) from ``x_hist, y, temp_delta``."""
    x, y = F.col("x_hist"), F.col("y")
    both = F.concat(x, y)
    slope = alast(y) - afirst(y)
    keys = (-amean(x), slope, F.array_max(both), -slope, astd(both), F.abs("temp_delta"))
    parts = [F.struct(F.lit(i).alias("priority"), F.lit(s).alias("scenario"), F.round(k, NOISE).alias("key")) for i, (s, k) in enumerate(zip(SCENARIOS, keys, strict=True))]
    return windows.select("node_idx", "t_start", F.explode(F.array(*parts)).alias("s")).select("node_idx", "t_start", "s.*")


def select_scenarios(windows: DataFrame, k: int) -> DataFrame:
    """``k`` windows per scenario and node; a window serves the first scenario that takes it.

    Only the best ``6 k`` windows of a scenario can be needed, so the ordered
    choice sees a bounded list per node.
    """
    shortlist = top_per_group(scenario_scores(windows), ["node_idx", "scenario"], [F.desc("key"), F.asc("t_start")], len(SCENARIOS) * k)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for scenario, rows in frame.sort_values(["priority", "rank"]).groupby("priority"):
            free = rows[~rows["t_start"].isin(used)].head(k)
            used.update(free["t_start"])
            out.append(free.assign(pick=range(1, len(free) + 1)))
        return pd.concat(out)[["node_idx", "scenario", "t_start", "pick"]]

    return shortlist.groupBy("node_idx").applyInPandas(choose, "node_idx long, scenario string, t_start long, pick long")


def trend_label(short: Column, medium: Column, eps: float = 0.01) -> Column:
    def sign(v: Column) -> Column:
        return F.when(v > 0, "rising").otherwise("falling")

    return F.when(F.abs(short) >= eps, sign(short)).when(F.abs(medium) >= eps, sign(medium)).otherwise("flat")


def trend_columns(x: Column) -> list[Column]:
    short, medium = clamped_delta(x, 2), clamped_delta(x, 4)
    return [alast(x).alias("last_value"), short.alias("short_slope"), medium.alias("medium_slope"), trend_label(short, medium).alias("trend_label")]


def retrieved_trends(windows: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Mean level and trend of the retrieved windows per (window, node)."""
    base = windows.select("t_start", "node_idx", *trend_columns(F.col("x_hist")), amean(F.col("x_hist")).alias("mean"))
    past = retrieved_rows(neighbours.select("q_t", "p_t"), base.withColumnRenamed("t_start", "p_t"))
    out = past.groupBy(F.col("q_t").alias("t_start"), "node_idx").agg(*[F.avg(c).alias(f"retrieved_{c}") for c in ("last_value", "short_slope", "medium_slope", "mean")])
    return out.withColumn("retrieved_trend_label", trend_label(F.col("retrieved_short_slope"), F.col("retrieved_medium_slope")))


def downsample(a: Column, points: int = 28) -> Column:
    """At most ``points`` evenly spaced values, first and last included."""
    step = (F.size(a) - 1) / F.lit(float(points - 1))
    spots = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.element_at(a, F.when(i == points - 1, F.size(a)).otherwise(F.floor(i * step).cast("int") + 1)))
    return F.when(F.size(a) <= points, a).otherwise(spots)


def refine_mask(c: Column, level: float = 0.45, ramp: float = 0.08, curvature: float = 0.05) -> Column:
    """1.0 for steps worth refining (high, steep or bent) and their neighbours, else 0.0."""
    n = F.size(c)
    at = lambda i: F.element_at(c, F.greatest(F.lit(1), F.least(n, i)).cast("int"))

    def hit(i: Column) -> Column:
        v, prev, nxt = at(i + 1), at(i), at(i + 2)
        return (v >= level) | (F.abs(v - prev) >= ramp) | (F.abs(nxt - v) >= ramp) | (F.abs(nxt - 2.0 * v + prev) >= curvature)

    # Neighbours are looked up by position: referring to a mapped array inside a
    # lambda would build it again for every element.
    return F.transform(c, lambda v, i: (hit(i) | ((i > 0) & hit(i - 1)) | ((i < n - 1) & hit(i + 1))).cast("double"))


def _bounded(a: Column, lo: float | None, hi: float | None) -> Column:
    if lo is None or hi is None:
        return a
    return F.transform(a, lambda v: clip(v, float(lo), float(hi)))


def combine_candidate(parsed: Column, candidate: Column, mask: Column, mode: str, residual_limit: float | None, value_clip: tuple[float, float] | None) -> Column:
    """Final curve from a model output: the output itself, or the candidate plus a (masked, averaged) residual."""
    lo, hi = value_clip if value_clip else (None, None)
    if mode == "absolute":
        return _bounded(parsed, lo, hi)
    r = parsed if residual_limit is None else _bounded(parsed, -residual_limit, residual_limit)
    if mode == "chunk_offset":
        r = F.array_repeat(amean(r), F.size(parsed))
    elif mode == "selective_residual":
        r = F.zip_with(r, F.slice(mask, 1, F.size(r)), lambda v, m: v * m)
    elif mode != "residual":
        raise ValueError(f"unknown mode {mode!r}")
    return _bounded(F.zip_with(F.slice(candidate, 1, F.size(parsed)), r, lambda c, v: c + v), lo, hi)


def residual_targets(y: Column, candidate: Column, mask: Column, mode: str, limit: float = 0.2) -> Column:
    """Training target of a residual model."""
    r = F.zip_with(y, candidate, lambda a, b: a - b)
    if mode == "chunk_offset":
        r = F.array_repeat(amean(r), F.size(y))
    elif mode == "selective_residual":
        r = F.zip_with(r, mask, lambda v, m: v * m)
    return _bounded(r, -limit, limit)


# Sort keys of each ranking of paired cases.
PAIR_MODES = {
    "largest_variant_gap": ("variant_gap_mae", "full_advantage"),
    "largest_full_advantage": ("full_advantage", "variant_gap_mae"),
    "worst_full": ("full_mae", "variant_gap_mae"),
}


def rank_pairs(paired: DataFrame, mode: str, k: int) -> DataFrame:
    order = [F.desc(F.round(c, NOISE)) for c in PAIR_MODES[mode]]
    return paired.orderBy(*order, "t_start", "node_idx").limit(k)


def case_buckets(scored: DataFrame, k: int = 20) -> DataFrame:
    """Four ranked lists of parsed records ``(bucket, rank, …)``, ``k`` each."""
    ok = scored.where("parse_ok").select("*", *[F.round(c, NOISE).alias(f"_{c}") for c in ("mae", "rmse", "prediction_range", "target_range")])
    mid = exact_quantiles(ok, [], "mae", {"mid": 0.5}).select("mid").scalar()
    moving = F.col("prediction_range") > 1e-6
    rules = {
        "best": (F.lit(True), (F.col("_mae"), F.col("_rmse"), F.lit(0.0))),
        "dynamic_good": (moving, (F.col("_mae"), -F.col("_prediction_range"), F.col("_rmse"))),
        "good_and_dynamic": (moving & (F.col("target_range") > 1e-6), (F.col("_mae"), F.col("_rmse"), -F.col("_prediction_range"))),
        "representative": (F.lit(True), (F.round(F.abs(F.col("mae") - F.col("_mid")), NOISE), -F.col("_prediction_range"), F.lit(0.0))),
    }
    lists = [F.when(cond, F.struct(F.lit(n).alias("bucket"), *[k_.alias(f"k{i}") for i, k_ in enumerate(keys)])) for n, (cond, keys) in rules.items()]
    rows = ok.withColumn("_mid", mid).select("*", F.explode(F.array_compact(F.array(*lists))).alias("_b"))
    flat = rows.select(*scored.columns, "_b.*")
    return top_per_group(flat, ["bucket"], [F.asc("k0"), F.asc("k1"), F.asc("k2"), F.asc("t_start"), F.asc("node_idx")], k).drop("k0", "k1", "k2")


# How many leading ranks of each list are wanted, in order of preference.
WANTED = {"best": 4, "dynamic_good": 6, "good_and_dynamic": 6, "representative": 3}


def curated_cases(scored: DataFrame, buckets: DataFrame, count: int = 20) -> DataFrame:
    """Tagged cases in order of their best tag, filled up with the next best records."""
    offset, wanted, shift = F.lit(None).cast("int"), F.lit(False), 0
    for name, n in WANTED.items():
        here = F.col("bucket") == name
        offset = F.when(here, F.lit(shift) + F.col("rank") - 1).otherwise(offset)
        wanted = wanted | (here & (F.col("rank") <= n))
        shift += n
    tagged = buckets.where(wanted).groupBy("t_start", "node_idx").agg(F.min(offset).alias("priority"))
    pool = scored.where("parse_ok").join(tagged, ["t_start", "node_idx"], "left_anti")
    order = [F.round("mae", NOISE), F.desc(F.round("prediction_range", NOISE)), F.desc(F.round("target_range", NOISE)), F.col("t_start"), F.col("node_idx")]
    spare = pool.orderBy(*order).limit(count).select(
        "t_start", "node_idx", F.lit("fallback").alias("source"), F.lit(10**6).alias("priority"),
        F.round("mae", NOISE).alias("a"), (-F.round("prediction_range", NOISE)).alias("b"), (-F.round("target_range", NOISE)).alias("c"),
    )
    zero = F.lit(0.0)
    chosen = tagged.select("t_start", "node_idx", F.lit("tagged").alias("source"), "priority", zero.alias("a"), zero.alias("b"), zero.alias("c"))
    return chosen.unionByName(spare).orderBy("priority", "a", "b", "c", "t_start", "node_idx").limit(count)


def window_case_select(paired: DataFrame, max_index: Column, nodes: int = 3, gap: int = 6) -> DataFrame:
    """Nodes and windows where the first variant gains most: ``(domain, kind, node_idx, win)``.

    ``win`` is the window number. ``single``: the best window of each top node.
    ``collage``: for each top node the anchor window with the highest mean gain and the two that follow it.
    """
    base = paired.select("domain", "node_idx", (F.col("t_start") - 12).alias("win"), F.round("full_advantage", NOISE).alias("adv"))
    by_node = base.groupBy("domain", "node_idx").agg(
        F.round(F.avg("adv"), NOISE).alias("mean_adv"), F.max_by("win", F.struct("adv", -F.col("win"))).alias("best")
    )
    top = top_per_group(by_node, ["domain"], [F.desc("mean_adv"), F.desc("node_idx")], nodes)
    anchors = base.where(F.col("win") + 2 * gap <= max_index).groupBy("domain", "win").agg(F.round(F.avg("adv"), NOISE).alias("m"))
    anchors = anchors.groupBy("domain").agg(F.max_by("win", F.struct("m", "win")).alias("anchor"))
    collage = top.join(anchors, "domain").select(
        "domain", F.lit("collage").alias("kind"), "node_idx", F.explode(F.array(*[F.col("anchor") + i * gap for i in range(3)])).alias("win")
    )
    return top.select("domain", F.lit("single").alias("kind"), "node_idx", F.col("best").alias("win")).unionByName(collage)


def case_union(cases: DataFrame, windows: DataFrame) -> DataFrame:
    """The distinct picks with their history and target arrays.

    There are at most four picks per top node of a domain, so they go to the windows, which are not shuffled.
    """
    unique = cases.select("domain", "node_idx", (F.col("win") + 12).alias("t_start")).distinct()
    return windows.join(F.broadcast(unique), ["node_idx", "t_start"])


def best_gap_segment(curve: DataFrame, keys: Sequence[str], pos: str, a: str, b: str, length: int) -> DataFrame:
    """The segment of ``length`` steps with the largest mean ``|a - b|`` (NULLs skipped), the first of equals."""
    gap = curve.withColumn("_gap", F.abs(F.col(a) - F.col(b)))
    out = framed(
        gap, keys, pos, 0, length - 1,
        {
            "mean_gap": lambda w: F.round(F.avg("_gap").over(w.rowsBetween(0, length - 1)), NOISE),
            "_full": lambda w: F.count(F.lit(1)).over(w.rowsBetween(0, length - 1)),
        },
    ).where((F.col("_full") == length) & F.col("mean_gap").isNotNull())
    return out.groupBy(*keys).agg(F.max_by(pos, F.struct("mean_gap", -F.col(pos))).alias("start"), F.max("mean_gap").alias("mean_gap"))


def nonoverlap_clips(curve: DataFrame, keys: Sequence[str], pos: str, truth: str, full: str, other: str, length: int = 12, best: int = 12) -> DataFrame:
    """The ``best`` clips with the largest positive gain that do not overlap inside a key.

    Only the ``best`` keys with the best first clips can give one of the result, since each of them is ahead of all clips of
    the other keys. A chosen clip rules out at most ``2 * length - 1`` starts, so the choice per
    key needs only its best ``best * (2 * length - 1)`` clips: a bounded list.
    """
    gain = F.abs(F.col(other) - F.col(truth)) - F.abs(F.col(full) - F.col(truth))
    rows = curve.withColumn("_gain", gain)
    clips = framed(
        rows, keys, pos, 0, length - 1,
        {
            "gain": lambda w: F.round(F.avg("_gain").over(w.rowsBetween(0, length - 1)), NOISE),
            "_known": lambda w: F.count("_gain").over(w.rowsBetween(0, length - 1)),
        },
    ).where((F.col("_known") == length) & (F.col("gain") > 0)).select(*keys, F.col(pos).alias("start"), "gain")
    clips = written(clips, "clips")
    first = clips.groupBy(*keys).agg(F.max(F.struct("gain", (-F.col("start")).alias("_s"))).alias("_f"))
    first = first.orderBy(F.desc("_f.gain"), *keys, F.desc("_f._s")).limit(best).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    clips = clips.join(F.broadcast(first), same, "left_semi")
    order = [F.desc("gain"), F.asc("start")]
    short = top_per_group(clips, keys, order, best * (2 * length - 1))
    types = dict(short.dtypes)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        for start in frame.sort_values("rank")["start"]:
            if all(abs(start - t) >= length for t in taken):
                taken.append(start)
            if len(taken) == best:
                break
        return frame[frame["start"].isin(taken)][[*keys, "start", "gain"]]

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "start", "gain"])
    picked = short.groupBy(*keys).applyInPandas(choose, schema)
    return picked.orderBy(F.desc("gain"), *keys, "start").limit(best)


def dynamic_nodes(obs: DataFrame, nodes: DataFrame, k: int = 3, domain: str = "zone_type") -> DataFrame:
    span = obs.groupBy("node_idx").agg((F.max("value") - F.min("value")).alias("value_range"))
    return top_per_group(span.join(nodes.select("node_idx", domain), "node_idx"), [domain], [F.desc("value_range"), F.asc("node_idx")], k)


def profile_nodes(obs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Shape, missing share, spread, zone counts, edge density and extreme node means as ``(section, name, value)``."""
    stats = obs.agg(
        F.countDistinct("t_idx").cast("double").alias("steps"), F.countDistinct("node_idx").cast("double").alias("nodes"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )
    overall = stats.unpivot([], stats.columns, "name", "value").select(F.lit("overall").alias("section"), "name", "value")
    zones = nodes.groupBy(F.col("zone_type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("zone").alias("section"), "name", "value")
    count = nodes.agg(F.count(F.lit(1))).scalar()
    density = edges.agg((F.count(F.lit(1)) / (count * count)).alias("value")).select(F.lit("graph").alias("section"), F.lit("density").alias("name"), "value")
    means = obs.groupBy("node_idx").agg(F.avg("value").alias("value"))
    ends = [
        means.orderBy(order, "node_idx").limit(5).select(F.lit(s).alias("section"), F.col("node_idx").cast("string").alias("name"), "value")
        for s, order in (("top", F.desc("value")), ("bottom", F.asc("value")))
    ]
    return overall.unionByName(zones).unionByName(density).unionByName(ends[0]).unionByName(ends[1])


