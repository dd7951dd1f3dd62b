"""Near-duplicate vectors by cosine: PCA-ordered tiled comparison, exact in double precision.

Unit vectors are turned so that the directions of most variance come first (a rotation, which keeps all cosines). Two tiles
are compared by a matrix product over the leading dimensions alone; the product of the two suffix norms bounds what the
others can still add (Cauchy-Schwarz). Pairs whose bound misses the threshold are dropped, the rest go on to the next
dimensions, and a tile pair ends when none is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from wattline.llm.common import attach, components, discard, small_frames, stash
from wattline.llm.registry import register, table

TILE = 2048
#: Strips that a table is cut into while they stay below the bytes of rows that a task may hold.
SIDES, STRIP_BYTES = 10, 64 << 20
#: Allowance for rounding in a bound; what passes is decided on the full product.
ROUNDING = 1e-9


def unit_rows(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large and very small numbers finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def steps_of(dim: int) -> list[int]:
    """Where the leading dimensions end: 3/8 of them, then 5/8, then all."""
    return sorted({max(1, dim * 3 // 8), max(1, dim * 5 // 8), dim})


def similar_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of rows with a cosine of ``threshold`` or more; i < j within ``a`` where b is None. Rotated unit rows."""
    same, b = b is None, a if b is None else b
    cuts = steps_of(a.shape[1])
    suffix = [(np.sqrt(np.maximum(0, (x[:, cuts[0] :] ** 2).sum(axis=1))))[:, None] for x in (a, b)]
    lead = [np.hstack([x[:, : cuts[0]], s]) for x, s in zip((a, b), suffix, strict=True)]
    found = []
    for start in range(0, len(a), 512):
        i, j = np.nonzero(lead[0][start : start + 512] @ lead[1].T >= threshold - ROUNDING)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        found.append((i, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    keep_i, keep_j = [], []
    for s in range(0, len(i), 200_000):
        p, q = i[s : s + 200_000], j[s : s + 200_000]
        total = np.einsum("nd,nd->n", a[p, : cuts[0]], b[q, : cuts[0]])
        for low, high in zip(cuts, cuts[1:], strict=False):
            total = total + np.einsum("nd,nd->n", a[p, low:high], b[q, low:high])
            rest = np.linalg.norm(a[p, high:], axis=1) * np.linalg.norm(b[q, high:], axis=1)
            alive = total + rest >= threshold - (ROUNDING if high < a.shape[1] else 0)
            p, q, total = p[alive], q[alive], total[alive]
        keep_i.append(p)
        keep_j.append(q)
    return (np.concatenate(keep_i), np.concatenate(keep_j)) if keep_i else (i, j)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every linked node that is not its component's smallest: at most n - 1 links for any number of pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        after = after[after]
        if (after == label).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
        label = after


class Strip:
    """Tiles of unit rows held together, against which others are compared one at a time.

    Links are counted per row, and of the links only a spanning part is kept: what a strip tells is at most one count and one
    link per row that it has read, for any number of pairs.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.tiles: list[tuple[int, np.ndarray, np.ndarray]] = []  # where a tile starts, copies, rows
        self.ids, self.links, self.label = (np.zeros(0, np.int64) for _ in range(3))

    def _across(self, copies: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list, list]:
        """Links of the rows ``x`` with held ones, and spanning links (one end, other end); ``x`` is numbered after the held rows."""
        own, ends, others = np.zeros(len(x)), [], []
        for start, held, rows in self.tiles:
            i, j = similar_pairs(rows, x, self.threshold)
            if len(i):
                self.links[start : start + len(held)] += np.bincount(i, copies[j], len(held)).astype(np.int64)
                own += np.bincount(j, held[i], len(x))
                for found, k in zip((ends, others), spanning(i, j + len(held), len(held) + len(x)), strict=True):
                    found.append(np.where(k < len(held), start + k, len(self.ids) + k - len(held)))
        return own, ends, others

    def _settle(self, ends: list, others: list, new: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, root) for rows numbered after the held ones; the roots of held rows are kept."""
        if not ends:
            return (np.zeros(0, np.int64),) * 2
        n = len(self.ids)
        moved = np.flatnonzero(self.label != np.arange(n))
        node, root = spanning(np.concatenate([*ends, moved]), np.concatenate([*others, self.label[moved]]), n + new)
        self.label = np.arange(n)
        self.label[node[node < n]] = root[node < n]
        return node[node >= n], root[node >= n]

    def hold(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, compare: bool) -> None:
        """Add a tile; with ``compare`` it meets itself and those held before."""
        n, own, ends, others = len(self.ids), np.zeros(len(ids)), [], []
        if compare:
            own, ends, others = self._across(copies, x)
            i, j = similar_pairs(x, None, self.threshold)
            if len(i):
                own += np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
                for found, k in zip((ends, others), spanning(i, j, len(x)), strict=True):
                    found.append(n + k)
        self.tiles.append((n, copies, x))
        self.ids, self.links = np.concatenate([self.ids, ids]), np.concatenate([self.links, own.astype(np.int64)])
        self.label = np.concatenate([self.label, np.arange(n, n + len(ids))])
        self._settle(ends, others, 0)

    def meet(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        """What is known of the rows of another tile."""
        own, ends, others = self._across(copies, x)
        node, root = self._settle(ends, others, len(ids))
        every = np.concatenate([self.ids, ids]) if len(node) else ids
        return _told(ids, own.astype(np.int64), every[node], every[root])

    def rest(self) -> pd.DataFrame:
        """What is known of the held rows in the end."""
        moved = np.flatnonzero(self.label != np.arange(len(self.ids)))
        return _told(self.ids, self.links, self.ids[moved], self.ids[self.label[moved]])


def _told(ids: np.ndarray, links: np.ndarray, node: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    some = np.flatnonzero(links)
    out = pd.DataFrame({"id": np.concatenate([ids[some], node])})
    out["links"] = pd.array([*links[some].tolist(), *[None] * len(node)], "Int64")
    out["root"] = pd.array([*[None] * len(some), *root.tolist()], "Int64")
    return out


def packed(x: np.ndarray) -> bytes:
    """Rows in single precision where that keeps every digit, else in double."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return (single if (single == x).all() else x).tobytes()


def unpacked(m: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(m, np.float32 if len(m) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def layout(tiles: int, dim: int) -> tuple[int, int]:
    """Tiles of a strip, strips of a chunk. A tile goes to a task per strip before its own and per chunk from its own on: about ``SIDES``
    times, until a strip is as large as a task may hold; then chunks grow, and tasks read more instead of being more."""
    most = max(1, STRIP_BYTES // (TILE * dim * 8))
    strip = min(most, -(-tiles // SIDES))
    return strip, max(1, -(-tiles // strip) // SIDES)


def _gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for frame in frames:
        if len(frame):
            x = unit_rows(np.stack(frame["v"]))
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pd.DataFrame({"at": np.arange(total.size), "s": total.ravel()})


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, zero, or hold null or non-finite components, and rows without an id, link with nothing; vectors
    of different lengths do not link (one comparison is planned per length; lengths are few). ``n_links`` counts other
    vectors linked directly; component: smallest id reachable. Rows with equal id and vector are one vector; rows with
    equal id and different vectors are told apart but share the component, and the larger ``n_links``. An empty table gives
    no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)  # kept as they are, at half the bytes
    v = F.transform(F.col(vec_col), lambda x: x if single else x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0)
    usable = rows.where(fit).select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"))
    usable = usable.groupBy("id", "k1", "k2", "dim").agg(F.first("v").alias("v"))
    usable = stash(usable, "vectors")
    classes = usable.groupBy("dim", "k1", "k2").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    heads = usable.join(classes.withColumnRenamed("head", "id"), ["dim", "k1", "k2", "id"]).select("dim", "k1", "k2", "id", "copies", "v")
    heads = stash(heads, "heads")
    found, packs = spark.createDataFrame([], "id long, links long, root long"), []
    for dim, n in sorted((r[0], r[1]) for r in heads.groupBy("dim").count().collect()):
        part, blobs = _links(heads.where(F.col("dim") == dim), dim, n, threshold)
        found = found.unionByName(part)
        packs.append(blobs)
    with small_frames(spark):
        found = stash(found, "links")
    discard(*packs)
    counts = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    per_head = heads.select("dim", "k1", "k2", F.col("id").alias("head"), "copies").join(counts.withColumnRenamed("id", "head"), "head", "left")
    per_head = per_head.select("dim", "k1", "k2", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    member = stash(attach(usable.select("id", "dim", "k1", "k2"), per_head, ["dim", "k1", "k2"], F.col("id"), "inner"), "members")
    discard(usable, heads)
    ties = member.select(F.col("id").alias("u"), F.col("head").alias("v")).unionByName(found.where("root is not null").select(F.col("id").alias("u"), F.col("root").alias("v")))
    roots = components(ties, "u", "v")
    links = member.groupBy("id").agg(F.max("links").alias("links"))
    out = rows.select("id").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    kind = vectors.schema[id_col].dataType
    own = F.coalesce("component", "id")
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.cast(kind).alias("component_id"), F.coalesce(own == F.col("id"), F.lit(False)).alias("kept"))


def _links(heads: DataFrame, dim: int, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, links, null): links of a vector found in a task, copies counted; (id, null, root): spanning links. And the tiles, to be
    discarded once they are read."""
    spark = heads.sparkSession
    gram = np.zeros(dim * dim)
    for r in heads.select("v").mapInPandas(_gram, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        gram[r["at"]] = r["s"]
    basis = spark.sparkContext.broadcast(np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy())
    tiles = -(-n // TILE)
    tiled = heads.select(F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"), "id", "copies", "v").repartition(tiles, "tile").sortWithinPartitions("tile", "id")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in frame.itertuples(index=False, name=None))
        for tile, members in groupby(rows, key=lambda row: row[0]):
            ids, copies, v = zip(*(row[1:] for row in members), strict=True)
            yield pd.DataFrame({"tile": [tile], "ids": [np.array(ids, np.int64).tobytes()], "copies": [np.array(copies, np.int64).tobytes()], "m": [packed(np.stack(v).astype(np.float64))]})

    blobs = stash(tiled.mapInPandas(pack, "tile int, ids binary, copies binary, m binary"), "tiles")
    strip, wide = layout(tiles, dim)
    strips = -(-tiles // strip)
    own = F.floor(F.col("tile") / strip).cast("int")
    chunk = F.floor(own / wide).cast("int")
    held = blobs.select(own.alias("strip"), F.explode(F.sequence(chunk, F.lit((strips - 1) // wide))).alias("chunk"), F.lit(0).alias("part"), "tile", "ids", "copies", "m")
    met = blobs.where(own > 0).select(F.explode(F.sequence(F.lit(0), own - 1)).alias("strip"), chunk.alias("chunk"), F.lit(1).alias("part"), "tile", "ids", "copies", "m")
    tasks = sum((strips - 1) // wide - k // wide + 1 for k in range(strips))
    # several places per task, so that few tasks share one
    dealt = held.unionByName(met).repartition(max(1, min(4 * tasks, 4096)), "strip", "chunk").sortWithinPartitions("strip", "chunk", "part", "tile")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in frame.itertuples(index=False, name=None))
        for (at, chunk), task in groupby(rows, key=lambda row: row[:2]):
            group = Strip(threshold)
            for _, _, part, _, ids, copies, m in task:
                ids, copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
                x = unit_rows(unpacked(m, len(ids), dim)) @ basis.value
                if part == 0:
                    group.hold(ids, copies, x, chunk == at // wide)
                elif group.tiles:
                    yield group.meet(ids, copies, x)
            yield group.rest()

    return dealt.mapInPandas(compare, "id long, links long, root long"), blobs


@register("op8_pca_tiles")
def op8_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
