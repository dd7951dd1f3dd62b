"""Benchmark passages in documents, up to a share of edits: pigeonhole pieces, then Myers' bit-parallel distance.

Texts are normalised (lower case, ASCII punctuation and white space as single spaces). An item of m characters may be met
with up to k = floor(edit_share * m) edits. Cut into k + 1 pieces, one piece must then occur unchanged, at a place that
lies within k of its own; an automaton finds all pieces of all items in one pass over a document, and the text around
each hit is verified by an approximate search for the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import in_batches, stash
from wattline.llm.registry import register, table

#: Edits allowed per character of an item.
EDIT_SHARE = 0.05
#: Items shorter than this (normalised characters) are matched exactly, as words of their own.
SHORT = 20
#: Characters of benchmark items that one pass over the documents looks for; more items mean more passes.
BLOCK_CHARS = 4_000_000

_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def normalise(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()).decode("utf-8", "replace")


def edit_budget(length: int, share: float = EDIT_SHARE) -> int:
    return 0 if length < SHORT else int(length * share)


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets; fewer if the item is shorter than that."""
    n = min(budget + 1, len(item))
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``item`` in ``text`` with at most ``budget`` edits; the first of equals."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = ones, 0, m
    best = None
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        x = eq | minus
        diagonal = (((x & plus) + plus) ^ plus) | x
        h_plus = minus | (ones & ~(diagonal | plus))
        h_minus = plus & diagonal
        if h_plus & top:
            distance += 1
        elif h_minus & top:
            distance -= 1
        h_plus = (h_plus << 1) & ones  # a match may begin anywhere: row 0 stays zero
        h_minus = (h_minus << 1) & ones
        plus = h_minus | (ones & ~(diagonal | h_plus))
        minus = h_plus & diagonal
        if distance <= budget and (best is None or distance < best[0]):
            best = distance, at
    return best


class Finder:
    """The pieces of some items in one automaton; items are told apart by their place, so ids may repeat or be null."""

    def __init__(self, items: list[tuple[int | None, str]], share: float = EDIT_SHARE):
        import ahocorasick

        self.ids, self.items = [i for i, _ in items], [t for _, t in items]
        self.budget = [edit_budget(len(t), share) for t in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for at, t in enumerate(self.items):
            for offset, piece in cut(t, self.budget[at]):
                found.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int | None, int, int]]:
        """(id, distance, end of the match in the normalised text) for every item id that the text holds; the best place of each."""
        if not self.any:
            return []
        hits: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for item, offset in places:
                hits.setdefault(item, set()).add(end + 1 - length - offset)
        out: dict[int | None, tuple[int, int]] = {}
        for item, starts in hits.items():
            pattern, k = self.items[item], self.budget[item]
            best, done = None, -1
            for start in sorted(starts):
                if len(pattern) < SHORT:
                    end = start + len(pattern)
                    apart = (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")
                    got = (0, end) if apart else None
                else:
                    # places closer than the budget share a window; a new one starts behind the last
                    if start + len(pattern) + k <= done:
                        continue
                    low, done = max(0, start - k), start + len(pattern) + 2 * k
                    got = myers(pattern, text[low:done], k)
                    got = got and (got[0], low + got[1])
                if got and (best is None or got < best):
                    best = got
            if best:
                out[self.ids[item]] = min(best, out.get(self.ids[item], best))
        return [(i, *m) for i, m in out.items()]


def blocks_of(items: DataFrame, id_col: str, text_col: str, most_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The normalised items, read to the driver block by block; each block holds about ``most_chars`` characters."""
    held, size = [], 0
    for row in items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        t = normalise(row[1])
        if not t:
            continue
        if held and size + len(t) > most_chars:
            yield held
            held, size = [], 0
        held.append((row[0], t))
        size += len(t)
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS, unnamed: bool = False) -> DataFrame:
    """(id, item_id, distance, match_end) for each document and each item it holds within the edit budget.

    Whole texts are searched. Null or empty texts and items match nothing. All texts of a repeated item id are searched;
    the id gives one row per document, that of the smallest distance, then end. ``unnamed``: items without an id are searched
    too, together as the item id null; otherwise they are left out. Repeated documents each give their rows.
    ``match_end`` counts characters of the normalised text. The benchmark is the query set: it is taken in blocks of bounded size, each sent
    to all tasks, and every block passes over all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col(text_col).isNotNull())
    items = items if unnamed else items.where(F.col(item_id).isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    kept = items.schema[item_id].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {kept}, distance int, match_end long"
    blocks = list(blocks_of(items, item_id, item_text, block_chars))
    # an id whose texts lie in several blocks is met in each: the passes then need a row number to be merged
    split = any(a[-1][0] == b[0][0] for a, b in zip(blocks, blocks[1:], strict=False))
    if split:
        rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
        schema += ", _row long"
    found = []
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = Finder(shared.value, share)
            for frame in in_batches(frames, "_text", 4_000_000):
                got = [(at, *m) for at, t in enumerate(frame["_text"]) for m in finder.matches(normalise(t))]
                at = [g[0] for g in got]
                out = pd.DataFrame({id_col: frame["_id"].iloc[at].to_numpy(), "item_id": pd.Series([g[1] for g in got], dtype=object)})
                out["distance"], out["match_end"] = [g[2] for g in got], [g[3] for g in got]
                if split:
                    out["_row"] = frame["_row"].iloc[at].to_numpy()
                yield out

        found.append(rows.mapInPandas(search, schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = reduce(DataFrame.unionAll, found)
    if not split:
        return out
    best = out.groupBy("_row", id_col, "item_id").agg(F.min(F.struct("distance", "match_end")).alias("m"))
    return best.select(id_col, "item_id", "m.distance", "m.match_end")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with an id or without. Ids of documents are not read."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    left = docs
    for block in blocks_of(items, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, share)
            for batch in batches:
                yield batch.filter(pa.array([not finder.matches(normalise(t.as_py())) for t in batch.column(at)], pa.bool_()))

        left = left.mapInArrow(search, docs.schema)
    return left


@register("op9_pigeonhole_decontamination")
def op9_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
