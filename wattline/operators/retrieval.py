"""Similar-window retrieval: feature vectors, exact nearest neighbours, differential features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.arrays import afirst, alast, amean, astd, clamped_delta
from wattline.functions.ranking import global_rank, top_per_group
from wattline.sources.sinks import written

TIME_FEATURES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")


def _half_shift(a: Column) -> Column:
    half = F.greatest(F.lit(1), F.floor(F.size(a) / 2).cast("int"))
    return amean(F.slice(a, F.size(a) - half + 1, half)) - amean(F.slice(a, 1, half))


def _spread(a: Column) -> list[Column]:
    return [amean(a), astd(a), F.array_min(a), F.array_max(a), _half_shift(a)]


def vector_parts(node_windows: DataFrame, axis_windows: DataFrame, version: str, aux: Sequence[str] = ()) -> DataFrame:
    """Window vectors in long form ``(t_start, part, idx, v)``; the vector is the order of (part, idx).

    ``legacy``: node means, node deviations, mean time features. ``shape`` adds
    last values, short and medium deltas and known-covariate summaries.
    ``context`` adds statistics of the long history.
    """
    x = F.col("x_hist")
    node_parts = {0: amean(x), 1: astd(x)}
    axis_parts: dict[int, list[Column]] = {5: [amean(F.col(f"{c}_hist")) for c in TIME_FEATURES]}
    if version in ("shape", "context"):
        node_parts |= {2: alast(x), 3: clamped_delta(x, 2), 4: clamped_delta(x, 4)}
        if aux:
            h = [F.col(f"{c}_hist") for c in aux]
            f = [F.col(f"{c}_future") for c in aux]
            axis_parts |= {
                6: [amean(a) for a in h], 7: [astd(a) for a in h], 8: [alast(a) for a in h], 9: [amean(a) for a in f],
                10: [F.array_min(a) for a in f], 11: [F.array_max(a) for a in f], 12: [alast(a) - afirst(a) for a in f],
            }
    if version == "context":
        node_parts |= {13 + i: c for i, c in enumerate(_spread(F.col("x_context")))}
        per_aux = [_spread(F.col(f"{c}_context")) for c in aux]
        axis_parts |= {18 + i: [p[i] for p in per_aux] for i in range(5) if aux}

    def cell(part: int, idx: Column, v: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), idx.cast("long").alias("idx"), v.cast("double").alias("v"))

    by_node = node_windows.select("t_start", F.explode(F.array(*[cell(p, F.col("node_idx"), v) for p, v in node_parts.items()])).alias("c"))
    cells = [cell(p, F.lit(i), v) for p, vs in axis_parts.items() for i, v in enumerate(vs)]
    by_axis = axis_windows.select("t_start", F.explode(F.array(*cells)).alias("c"))
    return by_node.unionByName(by_axis).select("t_start", "c.*")


#: Windows and nodes of one piece of a vector table: a piece is a small dense matrix.
WINDOW_BLOCK, NODE_BLOCK = 256, 4096
#: Neighbouring node blocks whose products are added up in one task before anything is emitted.
BLOCKS_TOGETHER = 16


def vector_columns(parts: DataFrame) -> DataFrame:
    """(part, idx, i): the columns of a vector table and their place ``i`` (from 0), ordered by part, then idx."""
    ranked = global_rank(parts.select("part", "idx").distinct(), [F.asc("part"), F.asc("idx")], "_at")
    return ranked.select("part", "idx", (F.col("_at") - 1).alias("i"))


def numbered_vectors(parts: DataFrame, key: str = "t_start") -> DataFrame:
    """Vectors in long form, ``(key, i, v)``; no row is as wide as the graph. The cells are made once, then numbered."""
    parts = written(parts, "cells")
    return parts.join(vector_columns(parts), ["part", "idx"]).select(key, "i", "v")


def _vector_pieces(parts: DataFrame) -> DataFrame:
    """(rb, part, nb, ids, cols, m): dense matrices of up to ``WINDOW_BLOCK`` windows by ``NODE_BLOCK`` columns of a part."""
    cells = parts.select(F.col("id").cast("long").alias("id"), "part", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))
    cells = cells.withColumns({"rb": F.floor(F.col("id") / WINDOW_BLOCK), "nb": F.floor(F.col("idx") / NODE_BLOCK)})

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, row = np.unique(frame["id"].to_numpy(), return_inverse=True)
        cols, col = np.unique(frame["idx"].to_numpy(), return_inverse=True)
        m = np.zeros((len(ids), len(cols)))
        m[row, col] = np.nan_to_num(frame["v"].to_numpy(np.float64, na_value=0.0))
        return pd.DataFrame({"rb": [key[0]], "part": [key[1]], "nb": [key[2]], "ids": [ids], "cols": [cols.tobytes()], "m": [m.tobytes()]})

    return cells.groupBy("rb", "part", "nb").applyInPandas(pack, "rb long, part int, nb long, ids array<long>, cols binary, m binary")


def _cells(row, ids: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A piece on the rows ``ids`` and the columns ``cols``; cells that it lacks are 0."""
    out = np.zeros((len(ids), len(cols)))
    if row is not None:
        own = np.frombuffer(row.cols, np.int64)
        out[np.ix_(np.searchsorted(ids, row.ids), np.searchsorted(cols, own))] = np.frombuffer(row.m, np.float64).reshape(-1, len(own))
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows; columns are centred first, which keeps digits."""
    mean = b.mean(axis=0)
    a, b = a - mean, b - mean
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)


def knn_long(queries: DataFrame, pool: DataFrame, k: int, strictly_before: bool = False) -> DataFrame:
    """``knn`` for vectors in long form, ``(id, part, idx, v)``: ``(q_id, p_id, dist, rank)``.

    Windows are cut into blocks and so are the nodes of each part. A task multiplies two blocks of windows over neighbouring
    blocks of nodes and adds the products up; these partial sums are added per pair of window blocks before the top-k is
    taken, so no row, group or task is as wide as the graph. Cells that a window lacks count as 0. Block pairs that hold no
    earlier window are never formed with ``strictly_before``.
    """
    q = written(_vector_pieces(queries), "pieces")
    p = q if pool is queries else written(_vector_pieces(pool), "pieces")
    # which blocks meet is a short list of numbers: no join, which would send all pieces of a block to one task
    listed = p.agg(F.collect_set("rb")).scalar()
    q_side = q.withColumnRenamed("rb", "qb").withColumn("pb", F.explode(listed))
    p_side = p.withColumnRenamed("rb", "pb").withColumn("qb", F.explode(listed if p is q else q.agg(F.collect_set("rb")).scalar()))
    group = F.floor(F.col("nb") / BLOCKS_TOGETHER).alias("ng")
    sides = [side.select("qb", "pb", "part", group, "nb", F.lit(k).alias("side"), "ids", "cols", "m") for k, side in enumerate((q_side, p_side))]
    met = sides[0].unionByName(sides[1])
    met = met.where("pb <= qb") if strictly_before else met
    dealt = met.repartition("qb", "pb", "part", "ng").sortWithinPartitions("qb", "pb", "part", "ng", "nb", "side")

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in frame.itertuples(index=False))
        for (qb, pb, _, _), mine in groupby(rows, key=lambda r: (r.qb, r.pb, r.part, r.ng)):
            total = _Sums()
            for _, block in groupby(mine, key=lambda r: r.nb):
                total.add_block({r.side: r for r in block})
            yield pd.DataFrame({"qb": [qb], "pb": [pb], **{n: [a] for n, a in total.lists().items()}, "sums": [total.cells.tobytes()]})

    partial = dealt.mapInPandas(multiply, "qb long, pb long, q_ids array<long>, p_ids array<long>, q_squares array<double>, p_squares array<double>, sums binary")

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in frame.itertuples(index=False))
        for _, mine in groupby(rows, key=lambda r: (r.qb, r.pb)):
            total = _Sums()
            for r in mine:
                cells = np.frombuffer(r.sums, np.float64).reshape(len(r.q_ids), len(r.p_ids))
                total.add((r.q_ids, r.p_ids), (r.q_squares, r.p_squares), cells)
            q_ids, p_ids = total.ids
            if len(q_ids) and len(p_ids):
                row, at, dist = nearest_cells(total.cells, q_ids, p_ids, k, strictly_before)
                yield pd.DataFrame({"q_id": q_ids[row], "p_id": p_ids[at], "dist": dist})

    found = partial.repartition("qb", "pb").sortWithinPartitions("qb", "pb").mapInPandas(best, "q_id long, p_id long, dist double")
    return top_per_group(found, ["q_id"], [F.asc("dist"), F.asc("p_id")], k)


class _Sums:
    """Squared distances added up over pieces that may know different windows; cells that a piece lacks are 0."""

    def __init__(self):
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.squares = [np.empty(0), np.empty(0)]
        self.cells = np.empty((0, 0))

    def lists(self) -> dict[str, np.ndarray]:
        return {"q_ids": self.ids[0], "p_ids": self.ids[1], "q_squares": self.squares[0], "p_squares": self.squares[1]}

    def add_block(self, found: dict) -> None:
        """The rows of one block of nodes by side (0: queries, 1: pool)."""
        cols = np.unique(np.concatenate([np.frombuffer(r.cols, np.int64) for r in found.values()]))
        ids = [np.asarray(found[k].ids, np.int64) if k in found else np.empty(0, np.int64) for k in (0, 1)]
        a, b = (_cells(found.get(k), ids[k], cols) for k in (0, 1))
        self.add(ids, [(x * x).sum(1) for x in (a, b)], _squares(a, b) if len(a) and len(b) else np.zeros((len(a), len(b))))

    def add(self, ids: Sequence[np.ndarray], squares: Sequence[np.ndarray], cells: np.ndarray) -> None:
        """A window that one side lacks here is all 0: its distances are the squares of the other side."""
        if all(np.array_equal(a, b) for a, b in zip(self.ids, ids, strict=True)):
            self.cells, self.squares = self.cells + cells, [a + b for a, b in zip(self.squares, squares, strict=True)]
            return
        every = [np.union1d(a, b) for a, b in zip(self.ids, ids, strict=True)]
        whole = [_spread_out(every, *x) for x in ((self.ids, self.squares, self.cells), (ids, squares, cells))]
        self.ids, self.squares, self.cells = every, [a + b for a, b in zip(whole[0][0], whole[1][0], strict=True)], whole[0][1] + whole[1][1]


def _spread_out(every: Sequence[np.ndarray], ids: Sequence[np.ndarray], squares: Sequence[np.ndarray], cells: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Squares and distances on the windows ``every`` (per side), of which ``ids`` are known."""
    at = [np.searchsorted(e, i) for e, i in zip(every, ids, strict=True)]
    out = [np.zeros(len(e)) for e in every]
    for o, a, s in zip(out, at, squares, strict=True):
        o[a] = s
    grid = out[0][:, None] + out[1][None, :]  # right where one side is 0
    grid[np.ix_(*at)] = cells
    return out, grid


def nearest_cells(dist: np.ndarray, q_ids: np.ndarray, p_ids: np.ndarray, k: int, strictly_before: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance rounded to 6 places) of the k nearest pool rows per query, ties to the earlier column."""
    dist = np.maximum(dist, 0.0).round(6)
    if strictly_before:
        dist[p_ids[None, :] >= q_ids[:, None]] = np.inf
    width = min(k, dist.shape[1])
    limit = np.partition(dist, width - 1, axis=1)[:, width - 1 : width]
    rows, at = np.nonzero((dist <= limit) & np.isfinite(dist))
    order = np.lexsort((at, dist[rows, at], rows))
    rows, at = rows[order], at[order]
    starts = np.searchsorted(rows, np.arange(len(q_ids)))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], at[keep], dist[rows[keep], at[keep]]


#: Ids of one side of a tile, the unit that is shuffled, at least; query rows of one matrix product inside it.
TILE, QUERY_ROWS = 16384, 2048
#: A tile grows with the ids, so that a side has about ``TILES``, up to ``MOST_TILE`` ids, which bounds the memory of a task.
TILES, MOST_TILE = 6, 65536
#: Pool rows of the first product of a tile, whose k best bound all later ones.
FIRST_ROWS = 256
#: Distances are rounded to 6 places, so a row this much farther than the k-th may tie with it.
ROUNDED = 1e-6


def nearest_in_tile(a: np.ndarray, b: np.ndarray, q_ids: np.ndarray, p_ids: np.ndarray, k: int, strictly_before: bool, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, pool id, distance) of the k nearest rows of ``b`` for every row of ``a``; ``p_ids`` ascend.

    Products of ``QUERY_ROWS`` by ``block`` rows are formed one after the other. Only cells not farther than a query's k-th so
    far are looked at again, so a product costs little more than its multiplication.
    """
    mean = b.mean(axis=0)
    a, b = a - mean, b - mean
    left = np.column_stack([-2.0 * a, (a * a).sum(1), np.ones(len(a))])
    right = np.ascontiguousarray(np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).T)
    edges = sorted({0, min(FIRST_ROWS, block, len(b)), *range(0, len(b), block), len(b)})
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(a), QUERY_ROWS):
        ids = q_ids[at : at + QUERY_ROWS]
        rows, found, dist = (np.empty(0, t) for t in (np.int64, p_ids.dtype, np.float64))
        limit, pending = np.full(len(ids), np.inf), []

        def merge(rows, found, dist, pending):
            rows, found, dist = (np.concatenate([x, *more]) for x, more in zip((rows, found, dist), zip(*pending, strict=True), strict=True))
            order = np.lexsort((found, dist, rows))
            rows, found, dist = rows[order], found[order], dist[order]
            starts = np.searchsorted(rows, np.arange(len(ids)))
            place = np.arange(len(rows)) - starts[rows]
            limit[rows[place == k - 1]] = dist[place == k - 1] + ROUNDED
            return rows[place < k], found[place < k], dist[place < k]

        for lo, hi in zip(edges, edges[1:], strict=False):
            if strictly_before and p_ids[lo] >= ids.max():
                break
            cells = left[at : at + QUERY_ROWS] @ right[:, lo:hi]
            if np.isinf(limit).any():
                r, c, d = nearest_cells(cells, ids, p_ids[lo:hi], k, strictly_before)
            else:
                if strictly_before and p_ids[hi - 1] >= ids.min():
                    cells[p_ids[None, lo:hi] >= ids[:, None]] = np.inf
                r, c = np.nonzero(cells <= limit[:, None])
                d = np.maximum(cells[r, c], 0.0).round(6)
            pending.append((r, p_ids[lo:hi][c], d))
            if np.isinf(limit).any() or sum(len(x[0]) for x in pending) > k * len(ids):
                rows, found, dist = merge(rows, found, dist, pending)
                pending = []
        if pending:
            rows, found, dist = merge(rows, found, dist, pending)
        out.append((rows + at, found, dist))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def knn(
    queries: DataFrame, pool: DataFrame, k: int, group: str | None = None, strictly_before: bool = False, block: int = 2048,
    last_id: Column | None = None,
) -> DataFrame:
    """Exact k nearest pool rows per query by squared L2, rounded to 6 places, ties to the lower id.

    Inputs hold ``id, vec`` (and ``group``). Ids are cut into tiles (``tile_size``); every pair of tiles is one group that
    multiplies small matrices of ``block`` pool rows and keeps ``k`` rows per query, and a second top-k merges the tiles. A
    vector is sent once per tile of the other side, whatever ``block`` is. With ``strictly_before`` only pool ids below the
    query's count, and pairs that cannot hold one are never formed; a query may then get fewer than ``k`` rows. A big group
    only has more tiles. ``last_id`` gives the highest id of either side where it is known; the inputs are then not read a
    second time to list their tiles.
    """
    keys = [group] if group else []
    q, p = paired_tiles(queries, pool, keys, strictly_before, last_id)
    names = [*keys, "qb", "pb"]
    # The two sides may be one table; distinct column names keep their keys apart.
    p = p.select(*[F.col(n).alias(f"_{n}") for n in names], "p_id", "p_vec")
    schema_keys = "".join(f"`{g}` {dict(queries.dtypes)[g]}, " for g in keys)

    def best(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "q_id", "p_id", "dist"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in cols})
        left, right = left.sort_values("q_id"), right.sort_values("p_id")
        a, b = (np.stack(v.to_numpy()).astype(np.float64) for v in (left["q_vec"], right["p_vec"]))
        q_ids = left["q_id"].to_numpy()
        rows, found, dist = nearest_in_tile(a, b, q_ids, right["p_id"].to_numpy(), k, strictly_before, block)
        out = pd.DataFrame({"q_id": q_ids[rows], "p_id": found, "dist": dist})
        for g in keys:
            out[g] = left[g].iloc[0]
        return out[cols]

    partial = q.groupBy(*names).cogroup(p.groupBy(*[f"_{n}" for n in names])).applyInPandas(best, f"{schema_keys}q_id long, p_id long, dist double")
    return top_per_group(partial, [*keys, "q_id"], [F.asc("dist"), F.asc("p_id")], k)


def tile_size(last: Column) -> Column:
    """Ids of one side of a tile, from the highest id: a vector is sent about ``TILES`` times until tiles are as large as a task may
    hold (``MOST_TILE``)."""
    return F.greatest(F.lit(TILE), F.least(F.lit(MOST_TILE), F.ceil((last + 1) / TILES))).cast("long")


def paired_tiles(queries: DataFrame, pool: DataFrame, keys: list[str], strictly_before: bool, last_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a row per vector and pair of tiles (``qb``, ``pb``) that it takes part in; floats stay floats."""
    highest = [t.agg(F.max(F.col("id").cast("long"))).scalar() for t in ([queries] if pool is queries else [queries, pool])]
    size = tile_size(last_id if last_id is not None else highest[0] if pool is queries else F.greatest(*highest))

    def side(df: DataFrame, n: str) -> DataFrame:
        vec = F.col("vec") if dict(df.dtypes)["vec"] == "array<float>" else F.col("vec").cast("array<double>")
        return df.select(*keys, F.col("id").cast("long").alias(f"{n}_id"), vec.alias(f"{n}_vec"), F.floor(F.col("id") / size).alias(f"{n}b"))

    q, p = side(queries, "q"), side(pool, "p")
    if last_id is not None:
        top = F.floor(last_id / size).cast("long")
        zero = F.lit(0).cast("long")
        q = q.withColumn("pb", F.explode(F.sequence(zero, F.col("qb") if strictly_before else top)))
        p = p.withColumn("qb", F.explode(F.sequence(F.col("pb") if strictly_before else zero, top)))
        return q, p
    pairs = _block_pairs(q, p, keys, strictly_before)
    return q.join(pairs, [*keys, "qb"]), p.join(pairs, [*keys, "pb"])


def fill_without_history(found: DataFrame, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Give queries that have no earlier pool row the first ``k`` pool ids, without a distance.

    ``knn`` leaves such queries out; this is the other convention.
    """
    heads = pool.orderBy("id").limit(k).agg(F.sort_array(F.collect_list("id"))).scalar()
    empty = queries.select(F.col("id").cast("long").alias("q_id")).join(found.select("q_id"), "q_id", "left_anti")
    rows = empty.withColumn("_h", heads).select("q_id", F.posexplode("_h").alias("_r", "p_id"))
    return found.unionByName(
        rows.select("q_id", F.col("p_id").cast("long"), F.lit(None).cast("double").alias("dist"), (F.col("_r") + 1).alias("rank"))
    )


def _block_pairs(q: DataFrame, p: DataFrame, keys: list[str], strictly_before: bool) -> DataFrame:
    """The pairs of blocks that exist on both sides; the list of a group's blocks is tiny."""
    q_blocks = q.select(*keys, "qb").distinct()
    p_blocks = p.select(*keys, "pb").distinct()
    if keys:
        listed = q_blocks.join(p_blocks.groupBy(*keys).agg(F.collect_set("pb").alias("_pbs")), keys)
    else:
        listed = q_blocks.withColumn("_pbs", p_blocks.agg(F.collect_set("pb")).scalar())
    pairs = listed.select(*keys, "qb", F.explode("_pbs").alias("pb"))
    return pairs.where(F.col("pb") <= F.col("qb")) if strictly_before else pairs


# Weather columns that carry each differential, in order of preference.
DIFF_ALIASES = {
    "ghi": ("global_horizontal_irradiance", "ghi"),
    "dni": ("direct_normal_irradiance", "dni"),
    "tsi": ("total_solar_irradiance", "solar_rad", "dhi"),
    "wind": ("wind_speed_hub", "wind_speed_50m", "wind_speed_30m", "wind_speed_10m", "wind_speed"),
}


def history_facts(windows: DataFrame) -> DataFrame:
    """What differencing needs per (window, node): mean history, temperature, price and first present aliases."""
    out = [F.col("t_start"), F.col("node_idx"), amean(F.col("x_hist")).alias("occ")]
    for name in ("temperature", "price"):
        out.append((F.col(name) if name in windows.columns else F.lit(None)).cast("double").alias("temp" if name == "temperature" else name))
    for name, aliases in DIFF_ALIASES.items():
        have = [F.col(c) for c in aliases if c in windows.columns]
        out.append((F.coalesce(*have) if have else F.lit(None)).cast("double").alias(name))
    return windows.select(*out)


def retrieved_rows(neighbours: DataFrame, windows: DataFrame) -> DataFrame:
    """Each neighbour (q_t, p_t, …) with the rows (p_t, node_idx, …) of its window.

    The neighbours are a few rows per window, whatever the number of nodes; they go to the rows, which stay where they are.
    A window of many nodes is therefore never one key.
    """
    return windows.join(F.broadcast(neighbours), "p_t").select(*neighbours.columns, *[c for c in windows.columns if c not in neighbours.columns])


def diff_features(neighbours: DataFrame, facts: DataFrame, query_facts: DataFrame | None = None) -> DataFrame:
    """Current minus mean of the retrieved windows, per (window, node), rounded half-even to 4 places.

    ``neighbours(q_t, p_t)`` holds one set per window, shared by all nodes. A
    measure that is absent now gives NULL; absent in every retrieved window it counts as 0.
    Facts hold a row per (window, node). Without ``query_facts`` they are read once: a row goes to its own window and to those
    that retrieved it, and one grouping meets both.
    """
    fields = ["occ", "temp", "price", *DIFF_ALIASES]
    own = F.col("_now")
    if query_facts is None:
        askers = neighbours.groupBy(F.col("p_t").alias("t_start")).agg(F.collect_list("q_t").alias("_askers"))
        rows = facts.join(F.broadcast(askers), "t_start", "left")
        goals = F.concat(F.array(F.struct(F.col("t_start").alias("q_t"), F.lit(True).alias("now"))), F.transform(F.coalesce("_askers", F.array().cast("array<bigint>")), lambda q: F.struct(q.alias("q_t"), F.lit(False).alias("now"))))
        rows = rows.withColumn("_g", F.explode(goals)).select("_g.q_t", "node_idx", F.col("_g.now").alias("_now"), *fields)
    else:
        past = retrieved_rows(neighbours.select("q_t", "p_t"), facts.withColumnRenamed("t_start", "p_t"))
        rows = past.select("q_t", "node_idx", F.lit(False).alias("_now"), *fields)
        rows = rows.unionByName(query_facts.select(F.col("t_start").alias("q_t"), "node_idx", F.lit(True).alias("_now"), *fields))
    met = rows.groupBy("q_t", "node_idx").agg(
        F.count(F.when(~own, 1)).alias("retrieved"), F.count(F.when(own, 1)).alias("_mine"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in fields], *[F.coalesce(F.avg(F.when(~own, F.col(c))), F.lit(0.0)).alias(f"_{c}") for c in fields],
    )
    return met.where("_mine > 0 and retrieved > 0").select(
        F.col("q_t").alias("t_start"), "node_idx", "retrieved", *[F.bround(F.col(c) - F.col(f"_{c}"), 4).alias(f"diff_{c}") for c in fields]
    )


def retrieval_entries(neighbours: DataFrame, facts: DataFrame) -> DataFrame:
    """Keyed entries: ``"t_start:node"``, the retrieved windows in rank order and the differentials."""
    lists = neighbours.groupBy("q_t").agg(F.sort_array(F.collect_list(F.struct("rank", "p_t"))).alias("_r"))
    lists = lists.select(F.col("q_t").alias("t_start"), F.col("_r.p_t").alias("retrieved_t_starts"))
    diffs = diff_features(neighbours, facts)
    return diffs.join(lists, "t_start").withColumn("entry", F.concat_ws(":", F.col("t_start"), F.col("node_idx")))
