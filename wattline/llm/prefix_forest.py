"""Nearest neighbours by cosine from a forest of sorted hash strings (LSH forest).

Each tree gives a vector a string of ``BITS`` bits: the signs of its products with random directions. Rows lie in blocks; a
block holds, per tree, the strings of all its rows in sorted order, so the rows that share a prefix with a query are one range.
A query goes down each tree to its longest prefix match (of variable length), then all trees go up together, one bit at a
time: the ranges widen, and the rows that enter are scored on their original vectors.

The way up ends when what is still unseen is improbable: with s the k-th best cosine so far, a row nearer than s shares a bit with
probability p >= 1 - arccos(s) / pi, so in all ``TREES`` trees it differs within the first x bits with probability (1 - p^x)^TREES
at most; at ``MISS`` or less the query stops. Nothing caps candidates: a query without near rows goes up to the root, where
every row of the block is scored. The directions depend on the vector length and a seed only; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.blockwise import PIECES, Best, largest_per, meet_all, numbered_pieces
from wattline.llm.common import stash
from wattline.llm.registry import register, table

TREES, BITS = 32, 32
#: Probability at which a query may stop, that a row as near as its k-th best is still unseen.
MISS = 0.05
#: Rows of a block; rows and queries that meet in one task; queries that go up side by side; pairs scored at once.
BLOCK = 8192
ROWS_TOGETHER, QUERIES_TOGETHER = 65_536, 8192
SIDE_BY_SIDE, PAIRS = 256, 100_000
#: Prefixes up to this length are compared in place, longer ones found as ranges; a block is multiplied with its queries once a level
#: brings in one pair in so many.
LEAD, DENSE = 8, 16
#: What a rounded product may miss; rows within it are scored exactly.
ROUNDING = 1e-12


def directions(dim: int, seed: int = 0) -> np.ndarray:
    """(dim, TREES * BITS) random directions, the same wherever they are made."""
    return np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(dim, TREES * BITS))


def strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(TREES, rows) hash strings; the first bit is the highest."""
    out = np.zeros((TREES, len(unit)), np.uint32)
    for low in range(0, len(unit), 1024):
        bits = (unit[low : low + 1024] @ planes > 0).reshape(-1, TREES, BITS)
        out[:, low : low + 1024] = np.packbits(bits, axis=2).view(">u4")[:, :, 0].T
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that keeps squares finite; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows; equal pairs give equal values."""
    return (a * b).sum(axis=1) / (norms(a) * norms(b))


def bits_kept(cosine: np.ndarray) -> np.ndarray:
    """The longest prefix x at which rows with this cosine or a larger one are unseen with probability MISS at most."""
    p = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    need = 1 - MISS ** (1 / TREES)  # p^x must reach it
    with np.errstate(divide="ignore"):
        x = np.log(need) / np.log(p)
    return np.where(p >= 1, BITS, np.floor(np.where(np.isfinite(x), x, 0)))


class Block:
    """Vectors (scaled), ids, and per tree the sorted strings with the rows they belong to."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, planes: np.ndarray):
        self.ids, self.x = ids, x
        s = strings(x / norms(x)[:, None], planes)
        self.order = np.argsort(s, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(s, self.order, axis=1)

    @cached_property
    def unit(self) -> np.ndarray:
        return self.x / norms(self.x)[:, None]

    @cached_property
    def lead(self) -> np.ndarray:
        """(TREES, rows) the first LEAD bits of the strings."""
        out = np.empty(self.order.shape, np.uint8)
        np.put_along_axis(out, self.order.astype(np.int64), (self.sorted >> (BITS - LEAD)).astype(np.uint8), axis=1)
        return out


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings of BITS bits."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def descend(block: Block, wanted: np.ndarray) -> np.ndarray:
    """Per query the longest prefix that it shares with a row in any tree; ``wanted``: (TREES, queries)."""
    best = np.zeros(wanted.shape[1], np.int64)
    for own, asked in zip(block.sorted, wanted, strict=True):
        at = np.searchsorted(own, asked)
        for near in (np.maximum(at - 1, 0), np.minimum(at, len(own) - 1)):
            best = np.maximum(best, common_bits(own[near], asked))
    return best


def _ranges(own: np.ndarray, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows begin and end that share the first ``bits`` bits with each query."""
    rest = np.uint64((1 << (BITS - bits)) - 1)
    wide = asked.astype(np.uint64)
    low, high = (wide & ~rest).astype(np.uint32), (wide | rest).astype(np.uint32)
    return np.searchsorted(own, low), np.searchsorted(own, high, side="right")


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of every position in the ranges."""
    size = np.maximum(stop - start, 0)
    which = np.repeat(np.arange(len(start)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def reached(block: Block, wanted: np.ndarray, bits: int) -> np.ndarray:
    """(queries, rows): which rows share the first ``bits`` bits with a query in any tree; ``wanted``: (TREES, queries)."""
    out = np.zeros((wanted.shape[1], len(block.ids)), bool)
    if bits > LEAD:
        for t in range(TREES):
            which, place = _spread(*_ranges(block.sorted[t], wanted[t], bits))
            out[which, block.order[t, place]] = True
    elif bits:
        # ranges hold many rows here, so prefixes are compared in place
        same = np.empty_like(out)
        for own, asked in zip(block.lead >> (LEAD - bits), wanted >> (BITS - bits), strict=True):
            np.equal(own, asked.astype(np.uint8)[:, None], out=same)
            out |= same
    else:
        out[:] = True
    return out


def marked(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a (queries, rows) table is set; faster than ``nonzero`` of two axes."""
    return np.divmod(np.flatnonzero(pairs), pairs.shape[1])


class Scores:
    """The cosines of a block's rows with the queries ``at``; those that may be among the best are worked out on their original vectors."""

    def __init__(self, block: Block, x: np.ndarray, at: np.ndarray, best: Best):
        self.block, self.x, self.at, self.best = block, x, at, best
        self.unit = x[at] / norms(x[at])[:, None]
        self.product: np.ndarray | None = None

    def score(self, now: np.ndarray, fresh: np.ndarray, pairs: int) -> None:
        """Score the ``pairs`` marked in ``fresh`` (places ``now`` in ``at``, rows)."""
        least = self.best.floor[self.at[now]] - ROUNDING
        if self.product is None and pairs * DENSE > fresh.size:
            # so many rows come in from here on that one product costs less than gathering them pair by pair
            self.product = self.unit @ self.block.unit.T
        known = self.product is not None
        if known:
            product = self.product if len(now) == len(self.at) else self.product[now]
            fresh = fresh & (product >= least[:, None])
        q, r = marked(fresh)
        for low in range(0, len(q), PAIRS):
            a, b = q[low : low + PAIRS], r[low : low + PAIRS]
            if not known:
                fit = np.einsum("nd,nd->n", self.unit[now[a]], self.block.unit[b]) >= least[a]
                a, b = a[fit], b[fit]
            a = self.at[now[a]]
            exact = cosines(self.x[a], self.block.x[b])
            good = self.best.better(a, exact, self.block.ids[b])
            self.best.add(a[good], exact[good], self.block.ids[b[good]])


def ascend(block: Block, x: np.ndarray, ids: np.ndarray, wanted: np.ndarray, best: Best, at: np.ndarray) -> int:
    """Score rows of the block for queries ``at``, from the longest prefix match up, until each may stop; the rows scored."""
    scored = 0
    length = descend(block, wanted[:, at])
    seen = ids[at, None] == block.ids
    active = np.ones(len(at), bool)
    scores = Scores(block, x, at, best)
    for bits in range(int(length.max(initial=0)), -1, -1):
        now = np.flatnonzero(active & (length >= bits))
        if not len(now):
            continue
        known = seen[now]
        fresh = reached(block, wanted[:, at[now]], bits)
        fresh &= ~known
        seen[now] = known | fresh
        pairs = np.count_nonzero(fresh)
        scores.score(now, fresh, pairs)
        scored += pairs
        best.settle()
        enough = best.floor[at] > -np.inf
        active &= ~(enough & (bits_kept(np.where(enough, best.floor[at], 0)) >= bits))
    return scored


def nearest(vectors: DataFrame, queries: Column, k: int = 5, seed: int = 0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id_col>, score): for rows where ``queries`` (a condition on ``id_col``) holds, the k nearest other
    rows found, by cosine in double precision, largest first, ties to the smaller id.

    Ids are whole numbers. Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components, take
    no part. Repeated rows are one; of rows that share an id, that with the smallest vector takes part. Vectors of different
    lengths do not meet. Fewer than k rows come back only if there are fewer candidates. An empty table gives no rows; other
    columns are not read.
    """
    kind = vectors.schema[id_col].dataType
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(~odd, F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fit).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    rows = stash(rows, "vectors")
    asked = F.col("_asked")
    marked = rows.withColumnRenamed("id", id_col).withColumn("_asked", queries).withColumnRenamed(id_col, "id")
    counts = marked.agg(F.count("*").alias("n"), F.count(F.when(asked, 1)).alias("q")).first()

    def pack_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return numbered_pieces(row_blocks(frames))

    def pack_queries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return numbered_pieces({"dim": dim, "ids": i, "x": x} for frame in frames for dim, i, x in _by_length(frame))

    def row_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for frame in frames:
            for dim, i, x in _by_length(frame):
                held.setdefault(dim, []).append((i, x))
                if sum(len(i) for i, _ in held[dim]) >= BLOCK:
                    yield from full(dim, held.pop(dim))
        for dim, parts in held.items():
            yield from full(dim, parts)

    def full(dim: int, parts: list) -> Iterator[dict]:
        i, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        planes = directions(dim, seed)
        for low in range(0, len(i), BLOCK):
            yield {"dim": dim, "block": Block(i[low : low + BLOCK], x[low : low + BLOCK], planes)}

    def work(held: list[dict], blocks: Iterator[dict]) -> Iterator[pd.DataFrame]:
        sets = {}
        for dim in {h["dim"] for h in held}:
            i, x = (np.concatenate([h[c] for h in held if h["dim"] == dim]) for c in ("ids", "x"))
            sets[dim] = i, x, strings(x / norms(x)[:, None], directions(dim, seed)), Best(len(i), k, np.float64)
        for b in blocks:
            if b["dim"] not in sets:
                continue
            i, x, wanted, best = sets[b["dim"]]
            for low in range(0, len(i), SIDE_BY_SIDE):
                ascend(b["block"], x, i, wanted, best, np.arange(low, min(low + SIDE_BY_SIDE, len(i))))
        for i, _, _, best in sets.values():
            best.settle()
            yield pd.DataFrame({"query_id": i[best.query], "id": best.id, "score": best.score})

    blocks = stash(rows.mapInPandas(pack_rows, PIECES), "forest")
    pieces = stash(marked.where(asked).select("id", "v").mapInPandas(pack_queries, PIECES), "queries")
    row_groups = max(1, min(-(-counts["n"] // 1024), max(vectors.sparkSession.sparkContext.defaultParallelism, -(-counts["n"] // ROWS_TOGETHER))))
    found = meet_all(pieces, blocks, max(1, -(-counts["q"] // QUERIES_TOGETHER)), row_groups, work, "query_id long, id long, score double")
    best = largest_per(found, ["query_id"], k)
    return best.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("id").cast(kind).alias(id_col), "score")


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for dim, part in frame.groupby(frame["v"].map(len)):
        yield dim, part["id"].to_numpy(np.int64), scaled(np.stack(part["v"]).astype(np.float64))


@register("op12_prefix_forest")
def op12_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
