"""Query blocks against row blocks: every pair of groups meets in one task, and tasks keep the best per query only."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "piece long, payload binary"
#: Pieces that one task may make.
MOST_PIECES = 1 << 20
#: Partitions per pair of groups, which are dealt by a hash.
PLACES = 8


def numbered_pieces(payloads: Iterable[dict]) -> Iterator[pd.DataFrame]:
    """One row (piece, payload) per payload; pieces are numbered through all tasks, alike whenever a task is run again."""
    start = TaskContext.get().partitionId() * MOST_PIECES
    for k, payload in enumerate(payloads):
        yield pd.DataFrame({"piece": [start + k], "payload": [pickle.dumps(payload, protocol=5)]})


def meet_all(queries: DataFrame, blocks: DataFrame, query_groups: int, row_groups: int, work: Callable[[list[dict], Iterator[dict]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``work(query payloads, row payloads)`` yields for every pair of a query group and a row group.

    Both sides are (piece, payload) and are dealt into groups in turns: the pieces of a task that made them go to one group after
    the other, from a group that changes from task to task, so groups are about equal. A task holds the queries of one group
    and reads row blocks one after the other; a query group travels once per row group and a row group once per query group.
    """

    def group(n: int):
        return F.pmod(F.shiftright("piece", MOST_PIECES.bit_length() - 1) + F.col("piece") % MOST_PIECES, F.lit(n)).cast("int")

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select(group(query_groups).alias("q"), all_of(row_groups).alias("r"), F.lit(0).alias("kind"), "piece", "payload")
    b = blocks.select(all_of(query_groups).alias("q"), group(row_groups).alias("r"), F.lit(1).alias("kind"), "piece", "payload")
    # several places per pair, so that few pairs share one
    dealt = q.unionByName(b).repartition(min(PLACES * query_groups * row_groups, 8192), "q", "r").sortWithinPartitions("q", "r", "kind", "piece")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in frame.itertuples(index=False, name=None))
        for _, pair in groupby(rows, key=lambda row: row[:2]):
            held: list[dict] = []
            for kind, pieces in groupby(pair, key=lambda row: row[2]):
                payloads = (pickle.loads(row[4]) for row in pieces)
                if kind == 0:
                    held = list(payloads)
                elif held:
                    yield from work(held, payloads)

    return dealt.mapInPandas(run, schema)


class Best:
    """The k best (largest score, then smallest id) of each of n queries, from candidates given in any order."""

    def __init__(self, n: int, k: int, kind=np.int64):
        self.k, self.least = k, np.iinfo(kind).min if np.issubdtype(kind, np.integer) else -np.inf
        self.query = np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, kind), np.zeros(0, np.int64)
        self.floor = np.full(n, self.least, kind)  # the k-th best so far, and its id
        self.floor_id = np.full(n, np.iinfo(np.int64).max)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def better(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which candidates may still enter (the arrays broadcast)."""
        floor = self.floor[query]
        return (score > floor) | ((score == floor) & (ids < self.floor_id[query]))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((query, score, ids))
        self.waiting += len(query)
        if self.waiting > 2 * self.k * len(self.floor):
            self.settle()

    def settle(self) -> None:
        """Keep the k best of each query and raise the floors."""
        if not self.new:
            return
        query, score, ids = (np.concatenate([old, *x]) for old, x in zip((self.query, self.score, self.id), zip(*self.new, strict=True), strict=True))
        self.new, self.waiting = [], 0
        order = np.lexsort((ids, _descending(score), query))
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        order, query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        self.query, self.score, self.id = query, score[order], ids[order]
        last = rank == self.k - 1
        self.floor[query[last]], self.floor_id[query[last]] = self.score[last], self.id[last]


def _descending(score: np.ndarray) -> np.ndarray:
    return ~score if np.issubdtype(score.dtype, np.integer) else -score


def largest_per(df: DataFrame, keys: list[str], k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The k rows of largest score (then smallest id) per key, with their rank from 1."""
    from pyspark.sql import Window

    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), id_col)).cast("int"))
    return ranked.where(F.col("rank") <= k)
