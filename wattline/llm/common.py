"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Copies of a looked-up row in ``attach``: one hot key is then spread over so many tasks.
SALTS = 16

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local session without one gets a new folder in /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/wattline-llm-{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete what ``stash`` wrote for these, once everything read from them is written itself."""
    for df in stashed:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stashed_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_frames(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """What is executed inside sends rows to Python in pieces of about ``most`` bytes (Spark's default: 64 MB, held by both sides)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], salt: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``facts`` (at most one row per key) to ``rows``, where one key may hold a third of all rows.

    ``salt`` spreads the rows of a key; ``facts`` is repeated ``salts`` times.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, in UTF-8; none for a null text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def in_batches(batches: Iterable[pd.DataFrame], column: str, most_chars: int) -> Iterator[pd.DataFrame]:
    """The same rows in pieces of about ``most_chars`` characters of ``column``, at least one row each."""
    for frame in batches:
        if not len(frame):
            continue
        sizes = frame[column].str.len().fillna(0).to_numpy()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most_chars:
                yield frame.iloc[start:i]
                start, total = i, 0
            total += n
        yield frame.iloc[start:]
    give_back()


def give_back() -> None:
    """Return what a worker has freed to the system: it lives on for other tasks, beside which unused memory would count."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _edges(df: DataFrame) -> DataFrame:
    return df.where(F.col("u") != F.col("v")).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and those that others hang on do not hang themselves."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("held")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("held")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("held").alias("held")).where("out > 1 or (out = 1 and held = 1)").isEmpty()


def components(edges: DataFrame, u: str, v: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node reachable.

    ``edges`` may be empty, repeat links and hold self-links; rows with a null end are ignored. Nodes without a
    link to another one do not appear. Large-star and small-star steps alternate until every node hangs on its
    smallest (a forest of stars); each round is written to the shared folder. The minima are written too, so that both sides
    of each join are dealt by plain shuffles, and Spark splits a hub's partition when it runs.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull())
    e = stash(_edges(e), "edges")
    for _ in range(most_rounds):
        if _stars(e):
            hung = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return hung.unionByName(hung.select(F.col("component").alias("node"), "component").distinct())
        # large star: of each node, the larger neighbours are hung on the smallest one
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        big = both.where(F.col("v") > F.col("u")).join(large, "u")
        hung = _edges(big.select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: the smaller neighbours, and the node, are hung on the smallest one
        least = stash(hung.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = hung.join(least, "u")
        after = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        after = stash(_edges(after), "edges")
        discard(e, large, least)
        e = after
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
