"""Hard negatives by a multiway hyperplane tree (GNAT): exact search for scores inside a window.

Vectors are made whole numbers, floor(scale * x), and scored by inner product. One more coordinate, sqrt(M^2 - |x|^2) with M
the largest length, gives all rows the same length; an anchor has 0 there, so d^2 = |a|^2 + M^2 - 2 * score, and a window of
scores is an annulus of distances around the anchor.

Each node of the tree has several split points; a row belongs to the nearest one (the hyperplanes between them part
the space), and every split point stores the range of its distances to each sibling subtree. A subtree is left out
when for some split point the annulus around the anchor cannot meet the stored range. Leaves are scored row by row in whole numbers.

The upper part of the tree has split points from a bounded sample. All rows go down it and are dealt, in the order of (cell,
distance to its split point, id), into blocks of at most ``BLOCK`` rows: each is a subtree that stores its ranges from all split
points on its path, and holds a tree of its own. Blocks are sorted by range, so a group of equal vectors fills many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.blockwise import PIECES, Best, largest_per, meet_all, numbered_pieces
from wattline.llm.common import stash
from wattline.llm.registry import register, table

#: Rows whose vectors place the split points of the upper tree, on any input size.
SAMPLE = 8192
#: Split points per node, rows of a block, rows of a leaf.
FAN, BLOCK, LEAF = 8, 2048, 128
#: Rows and anchors that meet in one task.
ROWS_TOGETHER, ANCHORS_TOGETHER = 65_536, 8192
#: Anchors that go down a tree side by side.
SIDE_BY_SIDE = 512
EXACT = 2.0**53


class Node:
    """Split points, children (nodes or leaves), and lo/hi[i, j]: distances from split point i to the rows of child j."""

    __slots__ = ("points", "children", "lo", "hi")

    def __init__(self, points, children, lo=None, hi=None):
        self.points, self.children, self.lo, self.hi = points, children, lo, hi

    def __reduce__(self):
        return Node, (self.points, self.children, self.lo, self.hi)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def split_points(x: np.ndarray, fan: int) -> np.ndarray:
    """Far-apart rows: each next one is the farthest from those chosen; fewer if the others equal chosen ones."""
    chosen = [0]
    far = distances(x, x[:1])[:, 0]
    while len(chosen) < fan:
        i = int(far.argmax())
        if far[i] <= 1e-5 * (1 + np.abs(x[i]).max()):
            break
        chosen.append(i)
        far = np.minimum(far, distances(x, x[i : i + 1])[:, 0])
    return x[chosen]


def grow(x: np.ndarray, at: np.ndarray, leaf: int, ranges: bool):
    """The tree over rows ``at`` of x: a Node, or the rows of a leaf."""
    if len(at) <= leaf:
        return at
    points = split_points(x[at[:: max(1, len(at) // (16 * FAN))]], FAN)
    if len(points) < 2:
        return at
    d = distances(x[at], points)
    side = d.argmin(axis=1)
    parts = [side == j for j in range(len(points))]
    filled = [j for j, p in enumerate(parts) if p.any()]
    points, d, parts = points[filled], d[:, filled], [parts[j] for j in filled]
    if len(parts) < 2:
        return at
    lo, hi = (np.stack([f(d[p], axis=0) for p in parts], axis=1) for f in (np.min, np.max)) if ranges else (None, None)
    return Node(points, [grow(x, at[p], leaf, ranges) for p in parts], lo, hi)


def number_cells(node: Node, start: int = 0) -> int:
    """Give the leaves below a node numbers from ``start`` instead of rows; the first number that is left."""
    for j, child in enumerate(node.children):
        if isinstance(child, Node):
            start = number_cells(child, start)
        else:
            node.children[j] = start
            start += 1
    return start


def upper_tree(x: np.ndarray, leaf: int):
    """A tree over a sample with numbered cells as its leaves; None if it has one cell only."""
    tree = grow(x, np.arange(len(x)), leaf, ranges=False)
    if not isinstance(tree, Node):
        return None
    number_cells(tree)
    return tree


def down(tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance to its split point) of each row."""
    cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    todo = [(tree, np.arange(len(x)))] if tree is not None else []
    while todo:
        node, at = todo.pop()
        d = distances(x[at], node.points)
        side = d.argmin(axis=1)
        for j, child in enumerate(node.children):
            some = at[side == j]
            if len(some) and isinstance(child, Node):
                todo.append((child, some))
            elif len(some):
                cell[some], near[some] = child, d[side == j, j]
    return cell, near


def path_of(tree, cell: int) -> list[np.ndarray]:
    """The split points of every node above a cell."""
    if tree is None:
        return []
    for child in tree.children:
        if isinstance(child, Node):
            below = path_of(child, cell)
            if below:
                return [tree.points, *below]
        elif child == cell:
            return [tree.points]
    return []


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with the coordinate that gives all of them the length sqrt(square)."""
    return np.hstack([x, np.sqrt(np.maximum(0, square - (x**2).sum(axis=1)))[:, None]])


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products as 64-bit whole numbers; beyond them, the largest or smallest one."""
    if a.shape[1] * most * most < EXACT:
        return (a @ b.T).astype(np.int64)
    big = np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) @ np.array([[int(v) for v in row] for row in b], object).reshape(b.shape).T
    limit = np.iinfo(np.int64)
    return np.array([[min(max(int(v), limit.min), limit.max) for v in row] for row in big], np.int64).reshape(len(a), len(b))


class Anchors:
    """Anchors of one vector length: score windows, the best found in each, and the annulus that can still add to them."""

    def __init__(self, x, ids, labels, of, low, high, k: int, same: bool, square: float):
        self.x, self.ids, self.labels, self.same = x, ids, labels, same
        self.of, self.low, self.high = of, low, high  # windows, ordered by anchor
        self.best = Best(len(of), k)
        self.start = np.searchsorted(of, np.arange(len(ids) + 1))
        self.lifted = np.hstack([x, np.zeros((len(x), 1))])
        own = (x**2).sum(axis=1)
        self.square = own + square
        self.slack = 1e-5 * (np.sqrt(own) + np.sqrt(square)) + 1e-9
        has = self.start[1:] > self.start[:-1]
        self.first = np.where(has, self.start[:-1], 0)
        self.nearest = self._radius(self._per_anchor(high, np.maximum)) - self.slack
        self.nearest[~has] = np.inf

    def _per_anchor(self, values, join) -> np.ndarray:
        out = values[self.first].astype(np.float64)
        np.minimum.at(out, self.of, values) if join is np.minimum else np.maximum.at(out, self.of, values)
        return out

    def _radius(self, score) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.square - 2 * score))

    def farthest(self) -> np.ndarray:
        """The outer radius of each anchor's annulus, which shrinks as better rows are found."""
        self.best.settle()
        return self._radius(self._per_anchor(np.maximum(self.low, self.best.floor), np.minimum)) + self.slack

    def alive(self, at: np.ndarray, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, far: np.ndarray) -> np.ndarray:
        """[anchor, child]: whether the child's rows, lo..hi[point, child] from the points, may lie in the annulus."""
        d = distances(self.lifted[at], points)[:, :, None]
        least = np.maximum(d - hi, lo - d).max(axis=1)
        most = (d + hi).min(axis=1)
        return (least <= far[at, None]) & (most >= self.nearest[at, None])

    def score(self, at: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: float) -> None:
        """Score a leaf's rows against anchors ``at``, window by window."""
        s = products(self.x[at], rows, most)
        ok = (self.labels[at, None] == labels) == self.same
        ok &= self.ids[at, None] != ids
        count = self.start[at + 1] - self.start[at]
        for w in range(int(count.max(initial=0))):
            some = np.flatnonzero(count > w)
            window = self.start[at[some]] + w
            t = s[some]
            fit = ok[some] & (t >= self.low[window, None]) & (t <= self.high[window, None])
            fit &= self.best.better(window[:, None], t, ids)
            i, j = np.nonzero(fit)
            if len(i):
                self.best.add(window[i], t[i, j], ids[j])


def search(anchors: Anchors, block: dict, most: float) -> None:
    """Go down one block's tree with all anchors that its path does not rule out."""
    x = block["x"].astype(np.float64)
    far = anchors.farthest()
    for low in range(0, len(anchors.ids), SIDE_BY_SIDE):
        at = np.arange(low, min(low + SIDE_BY_SIDE, len(anchors.ids)))
        at = at[np.isfinite(anchors.nearest[at])]
        for points, lo, hi in block["path"]:
            if len(at):
                at = at[anchors.alive(at, points, lo[:, None], hi[:, None], far)[:, 0]]
        todo = [(block["tree"], at)]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, Node):
                keep = anchors.alive(at, node.points, node.lo, node.hi, far)
                todo += [(child, at[keep[:, j]]) for j, child in enumerate(node.children)]
            else:
                anchors.score(at, x[node], block["ids"][node], block["labels"][node], most)


def whole_rows(vectors: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, v, dim): one row per id whose vector and label can take part."""
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    exact = F.transform(F.col(vec_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    fit = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()
    fit &= F.coalesce(~F.exists(exact, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    # whole numbers beyond a long keep their double value, which is whole already
    v = F.zip_with(exact, v, lambda e, w: F.when(F.abs(e) < 2.0**53, w).otherwise(e))
    rows = vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).cast("long").alias("label"), v.alias("v")).alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v", F.size("r.v").alias("dim"))


class Forest:
    """The rows of a table as blocks of a GNAT, with what searches need to know about them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        found = rows.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(square).alias("square")).first()
        self.n, self.most, self.square = found["n"], found["most"] or 0.0, found["square"] or 0.0
        if not np.isfinite(self.square):
            self.square = float(np.finfo(np.float64).max) / 8
        h = F.xxhash64("id")
        every = max(1, self.n // (2 * SAMPLE))
        drawn = rows.where(F.pmod(h, F.lit(every)) == 0).orderBy(h).limit(SAMPLE).select("dim", "v").toPandas()
        self.trees = {}
        for dim, part in drawn.groupby("dim"):
            x = lifted(np.stack(part["v"]).astype(np.float64).reshape(len(part), dim), self.square)
            self.trees[dim] = upper_tree(x, max(16, BLOCK * len(drawn) // max(self.n, 1)))
        self.row_groups = max(1, min(-(-self.n // LEAF), max(rows.sparkSession.sparkContext.defaultParallelism, -(-self.n // ROWS_TOGETHER))))
        self.blocks = stash(self._blocks(), "blocks")

    def _blocks(self) -> DataFrame:
        trees, square = self.rows.sparkSession.sparkContext.broadcast(self.trees), self.square

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for dim, part in frame.groupby("dim"):
                    x = lifted(np.stack(part["v"]).astype(np.float64).reshape(len(part), dim), square)
                    cell, near = down(trees.value.get(dim), x)
                    yield part.assign(cell=cell, near=near)

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return numbered_pieces(payloads(frames))

        def payloads(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
            key, held = None, []
            for frame in frames:
                for row in frame[["dim", "cell", "id", "label", "v"]].itertuples(index=False, name=None):
                    if held and (row[:2] != key or len(held) >= BLOCK):
                        yield block(key, held)
                        held = []
                    key = row[:2]
                    held.append(row)
            if held:
                yield block(key, held)

        def block(key, held) -> dict:
            dim, cell = key
            x = np.stack([r[4] for r in held]).astype(np.float64).reshape(len(held), dim)
            y = lifted(x, square)
            path = []
            for points in path_of(trees.value.get(dim), cell):
                d = distances(y, points)
                path.append((points, d.min(axis=0), d.max(axis=0)))
            tree = grow(y, np.arange(len(x)), LEAF, ranges=True)
            return {"dim": dim, "ids": np.array([r[2] for r in held], np.int64), "labels": np.array([r[3] for r in held], np.int64), "x": narrow(x), "path": path, "tree": tree}

        order = ["dim", "cell", "near", "id"]
        placed = self.rows.mapInPandas(place, "id long, label long, v array<double>, dim int, cell long, near double")
        return placed.repartitionByRange(max(1, -(-self.n // (4 * BLOCK)), self.row_groups), *order).sortWithinPartitions(*order).mapInPandas(pack, PIECES)

    def best(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, window, score, id): the k best rows in each window of ``asked`` (id, label, v, windows), same or other label.

        ``windows`` is an array of whole numbers: low, high, low, high and so on. Of equal scores the smaller id comes first.
        """
        square, most = self.square, self.most

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return numbered_pieces(queries(frames))

        def queries(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
            for frame in frames:
                for dim, part in frame.groupby(frame["v"].map(len)):
                    windows = [np.asarray(w, np.int64).reshape(-1, 2) for w in part["windows"]]
                    yield {"dim": dim, "ids": part["id"].to_numpy(np.int64), "labels": part["label"].to_numpy(np.int64), "x": narrow(np.stack(part["v"]).astype(np.float64).reshape(len(part), dim)), "windows": windows}

        def work(held: list[dict], blocks: Iterator[dict]) -> Iterator[pd.DataFrame]:
            sets: dict[int, Anchors] = {}
            for dim in {h["dim"] for h in held}:
                own = [h for h in held if h["dim"] == dim]
                windows = [w for h in own for w in h["windows"]]
                of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
                flat = np.concatenate(windows)
                x, ids, labels = (np.concatenate([h[c] for h in own]) for c in ("x", "ids", "labels"))
                if len(of):
                    sets[dim] = Anchors(x.astype(np.float64), ids, labels, of, flat[:, 0], flat[:, 1], k, same, square)
            for b in blocks:
                if b["dim"] in sets:
                    search(sets[b["dim"]], b, most)
            for a in sets.values():
                a.best.settle()
                w = a.best.query
                yield pd.DataFrame({"anchor": a.ids[a.of[w]], "window": w - a.start[a.of[w]], "score": a.best.score, "id": a.best.id})

        n = asked.count()
        pieces = stash(asked.select("id", "label", "v", "windows").mapInPandas(pack, PIECES), "anchors")
        found = meet_all(pieces, self.blocks, max(1, -(-n // ANCHORS_TOGETHER)), self.row_groups, work, "anchor long, window int, score long, id long")
        return largest_per(found, ["anchor", "window"], k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``anchors`` holds.

    Components become floor(scale * x); scores are exact inner products (held to the range of a long). An anchor's
    positives are its ``positives`` best other rows of its label; each has as negatives the ``negatives`` best rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to the smaller id;
    ranks start from 1; fewer rows where there are fewer.

    Ids and labels are whole numbers. Rows without id, label or vector, or with a null or non-finite component (also after
    scaling), take no part. Repeated rows are one; of rows that share an id, that with the smallest (label, vector)
    takes part. Vectors of different lengths do not meet. ``anchors`` is a condition on ``id_col``. An empty table gives no
    rows; other columns are not read.
    """
    ids = vectors.schema[id_col].dataType
    rows = stash(whole_rows(vectors, scale, id_col, vec_col, label_col), "vectors")
    forest = Forest(rows)
    limit = np.iinfo(np.int64)
    chosen = rows.withColumnRenamed("id", id_col).where(anchors).withColumnRenamed(id_col, "id")
    chosen = chosen.select("id", "label", "v", F.array(F.lit(int(limit.min)), F.lit(int(limit.max))).alias("windows"))
    good = stash(forest.best(chosen, positives, True).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window")), "positives")

    bound = F.col("positive_score").cast("decimal(20,0)")
    inner = F.array(F.ceil(bound * low / 100).cast("long"), F.floor(bound * high / 100).cast("long"))
    windows = good.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("window", inner.alias("w")))).alias("w")).select(F.col("anchor").alias("id"), F.flatten(F.transform("w", lambda x: x["w"])).alias("windows"))
    asked = chosen.drop("windows").join(windows, "id")
    bad = forest.best(asked, negatives, False).select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = good.join(bad, ["anchor", "window"])
    return out.select(F.col("anchor").cast(ids).alias("anchor_id"), F.col("positive_id").cast(ids).alias("positive_id"), "rank", F.col("negative_id").cast(ids).alias("negative_id"), "positive_score", "negative_score")


@register("op11_gnat_negatives")
def op11_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)
