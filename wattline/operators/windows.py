"""Sliding windows and day curves over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.blocks import BLOCK, with_halo

SLOTS = 96


def sliding_windows(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    history: int,
    horizons: Sequence[int],
    context: int = 0,
    stride: int = 1,
    extra: Sequence[str] = (),
    width: int = BLOCK,
) -> DataFrame:
    """One row per (key, ``t_start``): history, context and one target per horizon.

    ``pos`` must be dense and zero-based per key and the values filled. Every
    horizon keeps the same windows: a start needs ``max(horizons)`` steps ahead.
    With no horizon only the history is needed (inference windows); a
    ``stride`` of 0 means the horizon. The columns of ``extra`` get a history
    (``{c}_hist``), future (``{c}_future``) and context slice too.
    """
    h_max = max(horizons, default=0)
    ctx = max(context, history)
    if context and context < history:
        raise ValueError("context must be at least as long as the history")
    step = stride or h_max
    near = with_halo(df, pos, ctx, max(h_max - 1, 0), width)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    # One offset per place: a frame's list would be gathered anew for every row.
    cell = F.struct(F.col(value).alias("v"), *[F.col(c).alias(c) for c in extra])
    back = {f"_b{i}": F.lag(cell, i).over(w) for i in range(ctx, 0, -1)}
    ahead = {f"_a{i}": (F.lead(cell, i).over(w) if i else cell) for i in range(h_max)}
    out = near.select("*", *[c.alias(n) for n, c in (back | ahead).items()])
    out = out.where(F.col("_own") & F.col(f"_b{ctx}").isNotNull() & ((F.col(pos) - ctx) % step == 0))
    if h_max:
        out = out.where(F.col(f"_a{h_max - 1}").isNotNull())

    def list_of(names: Sequence[str], field: str) -> Column:
        return F.array(*[F.col(n)[field] for n in names])

    recent = list(back)[ctx - history :]
    cols = [F.col(c) for c in df.columns if c not in (value, pos, *extra)]
    cols += [F.col(pos).alias("t_start"), list_of(recent, "v").alias("x_hist")]
    cols += [list_of(list(ahead)[:h], "v").alias(f"y_{h}") for h in horizons]
    if context:
        cols.append(list_of(list(back), "v").alias("x_context"))
    for c in extra:
        cols.append(list_of(recent, c).alias(f"{c}_hist"))
        if h_max:
            cols.append(list_of(list(ahead), c).alias(f"{c}_future"))
        if context:
            cols.append(list_of(list(back), c).alias(f"{c}_context"))
    return out.select(*cols)


def long_targets(windows: DataFrame, target: str, keep: Sequence[str]) -> DataFrame:
    """Explode a target array to rows ``(…, h, y)`` with ``h`` from 1."""
    return windows.select(*keep, F.posexplode(target).alias("_h", "y")).withColumn("h", F.col("_h") + 1).drop("_h")


def concat_windows(windows: DataFrame, horizon: int, target: str, keep: Sequence[str], first: int = 0) -> DataFrame:
    """Every ``horizon``-th window, laid end to end: one row per step of the joined curve."""
    picked = windows.where((F.col("t_start") - first) % horizon == 0)
    rows = long_targets(picked, target, [*keep, "t_start"])
    return rows.withColumn("step", F.col("t_start") - first + F.col("h") - 1)


def rolling_origins(series: DataFrame, keys: Sequence[str], pos: str, context: int, chunk: int, slots: int = SLOTS) -> DataFrame:
    """Day origins and their chunks with the bounds of each chunk's history.

    Origins run from ``context`` in steps of ``slots`` while a whole day is left.
    """
    length = series.groupBy(*keys).agg((F.max(pos) + 1).alias("_t"))
    starts = F.sequence(F.lit(context).cast("long"), (F.col("_t") - slots).cast("long"), F.lit(slots).cast("long"))
    origins = length.where(F.col("_t") - slots >= context).select(*keys, F.explode(starts).alias("origin"))
    n = slots // chunk
    out = origins.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.col("origin") + F.col("chunk") * chunk
    return out.select(
        *keys, "origin", "chunk", start.alias("chunk_start"), (start + chunk).alias("chunk_end"),
        (start - context).alias("hist_start"), start.alias("hist_end"),
    )


def tag_nodes(
    starts: DataFrame, nodes: DataFrame, node: str = "node_idx", cap: int | None = None, seed: int | None = None
) -> DataFrame:
    """Every (window, node) item in window-major order, or in seeded order, up to ``cap`` (all without one).

    ``starts`` holds ``win`` (dense, from 0); ``nodes`` one row per node, whose ids may have holes: nodes are numbered in
    the order of their ids. Each task expands the windows of its own nodes. With a cap only the windows that it reaches
    are expanded; the seeded head is a top-k.
    """
    from wattline.functions.blocks import row_index
    from wattline.functions.ranking import seeded_order

    ids = nodes.select(node).distinct()
    size, last = ids.count(), starts.agg(F.max("win")).first()[0]
    if not size or last is None:
        return starts.withColumn(node, F.lit(None).cast(nodes.schema[node].dataType)).withColumn("item", F.lit(None).cast("long")).where("false")
    if seed is None and cap is not None:
        last = min(last, (cap - 1) // size)
    numbered = row_index(ids, [], [node], F.floor(F.col(node) / 4096) if dict(nodes.dtypes)[node] in ("int", "bigint") else F.substring(F.col(node), 1, 4), "_n")
    grid = numbered.withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    items = grid.join(starts, "win").withColumn("item", F.col("win") * size + F.col("_n")).drop("_n")
    if seed is None:
        return items if cap is None else items.where(F.col("item") < cap)
    key = seeded_order(seed, "win", node)
    return items.orderBy(key) if cap is None else items.orderBy(key).limit(cap)


def day_pivot(long: DataFrame, keys: Sequence[str], value: str, slots: int = SLOTS) -> DataFrame:
    """One row per (key, day) with a column per slot; the slot list is fixed, so no extra pass finds it."""
    wide = long.groupBy(*keys).pivot("slot", list(range(slots))).agg(F.first(value))
    return wide.toDF(*keys, *[f"s{i}" for i in range(slots)])


def day_stats(market: DataFrame, keys: Sequence[str], columns: Sequence[str], sample: bool = True) -> DataFrame:
    """Per day mean, deviation, max and min of each column (``sample`` picks n-1 or n)."""
    dev = F.stddev_samp if sample else F.stddev_pop
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), dev(c).alias(f"{c}_std"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    return market.groupBy(*keys).agg(*aggs)


def day_point_features(
    market: DataFrame, exog: Sequence[str], slow: DataFrame | None = None, monthly: DataFrame | None = None, history_days: int = 7
) -> DataFrame:
    """Tabular features per (series, day, slot) for a day-ahead price model.

    "Previous day" is the previous day present in the table. Same-slot lags run
    per (series, slot), so a group holds one row per day and a hot series is cut
    into 96 parts; day statistics live in a table of one row per day.
    """
    from wattline.functions.calendar import cyclic, weekday0

    stats = day_stats(market, ["series", "day"], ["price", *exog])
    rank = F.row_number().over(Window.partitionBy("series").orderBy("day")) - 1
    by_day = Window.partitionBy("series").orderBy("day")
    days = stats.select(
        "series", "day", rank.alias("rank"),
        *[F.lag(f"price_{s}", 1).over(by_day).alias(f"prev_day_price_{s}") for s in ("mean", "std", "max", "min")],
        F.lag("price_mean", 2).over(by_day).alias("prev_2day_price_mean"),
        F.lag("price_mean", 7).over(by_day).alias("prev_7day_price_mean"),
        *[F.col(f"{c}_mean").alias(f"{c}_target_day_mean") for c in exog],
        *[F.col(f"{c}_std").alias(f"{c}_target_day_std") for c in exog],
        *[F.lag(f"{c}_mean", 1).over(by_day).alias(f"{c}_prev_day_mean") for c in exog],
    )
    same_slot = Window.partitionBy("series", "slot").orderBy("day")
    out = market.select(
        "*",
        F.lag("price", 1).over(same_slot).alias("prev_day_same_slot_price"),
        F.lag("price", 2).over(same_slot).alias("prev_2day_same_slot_price"),
        F.lag("price", 7).over(same_slot).alias("prev_7day_same_slot_price"),
        *[F.lag(c, 1).over(same_slot).alias(f"{c}_prev_day_slot") for c in exog],
    )
    out = out.join(days, ["series", "day"]).where(F.col("rank") >= history_days)
    sin, cos = cyclic(F.col("slot"), 96.0)
    out = out.select(
        "series", "day", "slot",
        weekday0(F.col("day")).alias("day_of_week"), F.month("day").alias("month"),
        (weekday0(F.col("day")) >= 5).cast("int").alias("is_weekend"), sin.alias("slot_sin"), cos.alias("slot_cos"),
        "prev_day_same_slot_price", "prev_2day_same_slot_price", "prev_7day_same_slot_price",
        "prev_day_price_mean", "prev_day_price_std", "prev_day_price_max", "prev_day_price_min",
        "prev_2day_price_mean", "prev_7day_price_mean",
        *[
            col
            for c in exog
            for col in (
                F.col(c).alias(f"{c}_target_slot"), F.col(f"{c}_prev_day_slot"),
                (F.col(c) - F.col(f"{c}_prev_day_slot")).alias(f"{c}_slot_delta_vs_prev_day"),
                F.col(f"{c}_target_day_mean"), F.col(f"{c}_target_day_std"), F.col(f"{c}_prev_day_mean"),
            )
        ],
        F.col("price").alias("target_price"),
    )
    if slow is not None:
        names = [c for c in slow.columns if c != "day"]
        out = out.join(slow, "day", "left").select(*out.columns, *[F.coalesce(c, F.lit(0.0)).alias(f"daily_{c}") for c in names])
    if monthly is not None:
        names = [c for c in monthly.columns if c != "month"]
        out = out.join(monthly, "month", "left").select(
            *out.columns, *[F.coalesce(c, F.lit(0.0)).alias(f"priority_month_{c}") for c in names]
        )
    return out


def day_sequence_features(
    market: DataFrame, exog: Sequence[str], price_floor: float, price_cap: float, origin: Column,
    train: Column, low: float, high: float, slow: DataFrame | None = None,
) -> DataFrame:
    """The 96-step frame of every origin, one row per (series, origin, step).

    ``slow`` holds daily features by ``day``; each is scaled to its own range and shown, as ``slow_{name}``, for the day
    that a frame begins (0 for days it does not list).

    ``origin`` says which positions start a frame (any expression over ``pos``);
    672 rows of history and 96 rows ahead are needed. One join on position
    brings every step its lags; per-origin statistics are one aggregate.
    """
    from wattline.functions.calendar import cyclic, slot_of, weekday0

    bounds = market.where(train).agg(
        F.struct(*[F.min(c).alias(f"{c}_lo") for c in exog], *[F.max(c).alias(f"{c}_hi") for c in exog]).alias("b")
    ).scalar()
    scale = price_cap - price_floor
    norm = market.select(
        "series", "pos", "ts", "price", ((F.col("price") - price_floor) / scale).alias("p"),
        *[((F.col(c) - bounds[f"{c}_lo"]) / (bounds[f"{c}_hi"] - bounds[f"{c}_lo"] + 1e-6)).alias(c) for c in exog],
    )
    # Lags of whole days stay inside one residue class of the position.
    daily = Window.partitionBy("series", F.col("pos") % SLOTS).orderBy("pos")
    lagged = norm.select(
        "series", F.col("pos").alias("at"), "ts", F.col("price").alias("target_price"),
        F.lag("p", 1).over(daily).alias("hist_price"), F.lag("price", 1).over(daily).alias("base_price"),
        F.lag("p", 2).over(daily).alias("prev2_price"), F.lag("p", 7).over(daily).alias("prev7_price"),
        *[F.col(c).alias(f"{c}_future") for c in exog], *[F.lag(c, 1).over(daily).alias(f"{c}_prev") for c in exog],
    )
    length = market.groupBy("series").agg((F.max("pos") + 1).alias("_t"))
    origins = (
        market.where(origin).select("series", F.col("pos").alias("origin")).join(length, "series")
        .where((F.col("origin") >= 672) & (F.col("origin") + 96 <= F.col("_t"))).select("series", "origin")
    )
    steps = origins.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(95))))

    out = steps.withColumn("at", F.col("origin") + F.col("step")).join(lagged, ["series", "at"])
    stats = out.groupBy("series", "origin").agg(
        F.avg("hist_price").alias("hist_mean"), F.stddev_pop("hist_price").alias("hist_std"),
        F.max("hist_price").alias("hist_max"), F.min("hist_price").alias("hist_min"),
        F.avg("prev2_price").alias("prev2_mean"), F.avg("prev7_price").alias("prev7_mean"),
        F.avg((F.col("base_price") <= low).cast("double")).alias("floor_share"),
        F.avg((F.col("base_price") >= high).cast("double")).alias("peak_share"),
        *[F.avg(f"{c}_future").alias(f"{c}_day_mean") for c in exog],
        *[F.stddev_pop(f"{c}_future").alias(f"{c}_day_std") for c in exog],
        *[F.avg(f"{c}_prev").alias(f"{c}_prev_mean") for c in exog],
    )
    slot, dow, month = slot_of(F.col("ts")), weekday0(F.col("ts")), F.month("ts")
    cyc = []
    for name, x, period in (("slot", slot, 96.0), ("dow", dow, 7.0), ("month", month, 12.0)):
        s, c = cyclic(x, period)
        cyc += [s.alias(f"{name}_sin"), c.alias(f"{name}_cos")]
    out = out.join(stats, ["series", "origin"]).select(
        "*", *cyc, *[(F.col(f"{c}_future") - F.col(f"{c}_prev")).alias(f"{c}_delta") for c in exog],
        (F.col("target_price") <= low).cast("int").alias("target_floor"),
        (F.col("target_price") >= high).cast("int").alias("target_peak"),
    )
    if slow is None:
        return out
    names = [c for c in slow.columns if c != "day"]
    ends = slow.agg(*[F.min(c).alias(f"{c}_lo") for c in names], *[F.max(c).alias(f"{c}_hi") for c in names]).first()
    lo, hi = ([0.0 if ends[f"{c}_{side}"] is None else float(ends[f"{c}_{side}"]) for c in names] for side in ("lo", "hi"))
    scaled = slow.select("day", *[((F.col(c) - a) / (b - a + 1e-6)).alias(f"slow_{c}") for c, a, b in zip(names, lo, hi, strict=True)])
    first = F.to_date(F.col("ts") - F.make_dt_interval(mins=F.col("step") * 15))
    shown = out.withColumn("day", first).join(scaled, "day", "left")
    return shown.select(*out.columns, *[F.coalesce(f"slow_{c}", F.lit(0.0)).alias(f"slow_{c}") for c in names])


def slow_features(timeline: DataFrame, policy: DataFrame, year: int, key: str = "day") -> DataFrame:
    """Full outer join of two sparse daily tables, one year, forward filled, then 0.

    A row per listed date; the table is bounded by the calendar.
    """
    joined = timeline.join(policy, key, "full_outer").where(F.year(key) == year)
    w = Window.partitionBy(F.year(key)).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    names = [c for c in joined.columns if c != key]
    return joined.select(key, *[F.coalesce(F.last(c, True).over(w), F.lit(0.0)).alias(c) for c in names])


def day_offset_rows(
    market: DataFrame, candidate: DataFrame, exog: Sequence[str], scale: float, clip_at: float = 0.2
) -> DataFrame:
    """One row per day that has a candidate: candidate, lag and exogenous summaries and the clipped mean residual."""
    from wattline.functions.arrays import clip

    days = market.groupBy("series", "day").agg(
        (F.avg("price") / scale).alias("truth_mean"),
        *[F.avg(c).alias(f"{c}_mean") for c in exog], *[F.stddev_pop(c).alias(f"{c}_std") for c in exog],
        *[F.max(c).alias(f"{c}_max") for c in exog],
    )
    w = Window.partitionBy("series").orderBy("day")
    days = days.select(
        "*", F.lag("truth_mean", 1).over(w).alias("_lag1"),
        F.coalesce(F.lag("truth_mean", 7).over(w), F.first("truth_mean").over(w)).alias("prev7_mean"),
    )
    cand = candidate.groupBy("series", "day").agg(
        F.avg("prediction").alias("candidate_mean"), F.min("prediction").alias("candidate_min"),
        F.max("prediction").alias("candidate_max"),
    )
    return days.join(cand, ["series", "day"]).select(
        "series", "day", "candidate_mean", "candidate_min", "candidate_max",
        F.coalesce("_lag1", "candidate_mean").alias("prev_mean"), "prev7_mean",
        *[f"{c}_{s}" for c in exog for s in ("mean", "std", "max")],
        clip(F.col("truth_mean") - F.col("candidate_mean"), -clip_at, clip_at).alias("day_offset"),
    )
