"""Reproducible shuffle and sharding: a Feistel permutation over global row numbers.

Rows get global numbers in the order of (id, CRC of the text, size). A keyed Feistel network on the smallest even number
of bits that holds the row count, with cycle walking, permutes the numbers 0..n-1; the permuted number p lies in shard
``p mod shards`` at slot ``p div shards``. Shards thus differ by one row at most, slots have no gaps, and both can be
computed (and inverted) from a row number alone, without a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.common import stash
from wattline.llm.registry import register, table

ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of x and a round key."""
    x = x + _U(key)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _round_keys(seed: int) -> list[int]:
    return [(seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64 for r in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for k in keys:
        left, right = right, left ^ (_mix(right, k) & mask)
    return (left << _U(half)) | right


def _unfeistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for k in reversed(keys):
        left, right = right ^ (_mix(left, k) & mask), left
    return (left << _U(half)) | right


def _walk(step, x: np.ndarray, n: int, half: int, seed: int) -> np.ndarray:
    """Apply the network until every value lies below n again."""
    keys = _round_keys(seed)
    with np.errstate(over="ignore"):
        out = step(x.astype(np.uint64), half, keys)
        while (outside := np.flatnonzero(out >= _U(n))).size:
            out[outside] = step(out[outside], half, keys)
    return out.astype(np.int64)


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place in the shuffle of each row number (0 <= number < n); a bijection on 0..n-1."""
    return _walk(_feistel, np.asarray(numbers), n, _half_bits(n), seed) if len(numbers) else np.zeros(0, np.int64)


def unpermute(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each place of the shuffle: the inverse of ``permute``."""
    return _walk(_unfeistel, np.asarray(places), n, _half_bits(n), seed) if len(places) else np.zeros(0, np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that lies at (shard, slot)."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` (from 0, in the given order), and their count.

    A range shuffle sorts the rows; a row's number is the count of the earlier partitions, which are as many as
    Spark's shuffle partitions, plus its place in its own. Rows equal in all of ``order`` are interchangeable.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stash(placed, "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    ahead, total = [], 0
    for p, size in sizes:
        ahead.append((p, total))
        total += size
    offsets = spark.createDataFrame(ahead, "_part long, _ahead long")
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn("row_number", F.col("_ahead") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_ahead"), total


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number, place, shard, slot) for every row of ``docs``.

    size: UTF-8 bytes of the text plus 1 (null text: 1). text_crc32: unsigned CRC-32 of the UTF-8 text (null: 0, as for
    the empty text). Null ids come first; repeated rows each get a place of their own; an empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed, n = numbered(rows, [id_col, "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    return placed.withColumn("place", place("row_number")).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("place") / F.lit(shards)).cast("long"))


@register("op2_feistel_shards")
def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
