"""Writers, manifests and tables that are reused only when their parameters match."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables in the folder that the whole cluster shares (``spark.checkpoint.dir``).

    Without that setting a session that runs in one process gets a folder of its own; a cluster stops, since its
    executors would write where no other one can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/wattline-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new scratch folder and read back: computed once, and nothing is lost with an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def manifest_hash(*fields: str) -> Column:
    """SHA-256 of the canonical JSON of the given columns (in name order)."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def verify_manifest(df: DataFrame, fields: list[str], digest: str = "digest") -> DataFrame:
    """Stops when a stored digest is not the one of its row."""
    good = F.col(digest) == manifest_hash(*fields)
    return df.withColumn(digest, F.when(good, F.col(digest)).otherwise(F.raise_error(F.lit("manifest digest differs"))))


def sink_dataset(tables: Mapping[str, DataFrame], path: str, partitions: Mapping[str, list[str]], manifest: Mapping[str, object]) -> None:
    """Every table as Parquet under its name, and the protocol parameters as one JSON row with a digest."""
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.mode("overwrite").partitionBy(*partitions.get(name, [])).parquet(f"{path}/{name}")
    if spark is not None:
        row = spark.range(1).select(*[F.lit(json.dumps(v)).alias(k) for k, v in sorted(manifest.items())])
        row.withColumn("digest", manifest_hash(*manifest)).write.mode("overwrite").json(f"{path}/manifest")


def write_time_parts(axis: DataFrame, ts: str, path: str, files: int = 1) -> None:
    t = F.col(ts)
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t)}
    ordered = axis.repartitionByRange(files, ts).sortWithinPartitions(ts)
    ordered.select(*[c.alias(n) for n, c in parts.items()]).write.mode("overwrite").option("header", "true").csv(path)


def load_or_build(spark: SparkSession, path: str, parameters: Mapping[str, object], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The stored table if every parameter matches, else a rebuilt one; the flag says it was reused.

    Table and parameter row lie under the digest of the parameters, so a build with others never touches them, and the
    parameter row is written last, so a table whose build was cut short is never reused.
    """
    wanted = json.dumps(dict(sorted(parameters.items())), sort_keys=True)
    own = f"{path}/{hashlib.sha256(wanted.encode()).hexdigest()[:16]}"
    if stored_parameters(spark, own) == wanted:
        return spark.read.parquet(f"{own}/table"), True
    build().write.mode("overwrite").parquet(f"{own}/table")
    spark.range(1).select(F.lit(wanted).alias("value")).write.mode("overwrite").text(f"{own}/parameters")
    return spark.read.parquet(f"{own}/table"), False


def stored_parameters(spark: SparkSession, path: str) -> str | None:
    """The parameter row under ``path``, or None if nothing is stored there; other read errors are raised."""
    try:
        row = spark.read.text(f"{path}/parameters").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else None


POINTER = "seq bigint, version string, parameters string"


def sink_retrieval(entries: DataFrame, path: str, per_file: int = 25_000, parameters: Mapping[str, object] | None = None) -> str:
    """Publish entries in files of at most ``per_file`` rows, with the parameters they were made with; the version's name.

    Entries go to a folder of their own; then one row is appended to the pointers, and readers follow the last one. A write
    that stops before that row changes nothing for them, and nothing that they may be reading is overwritten.
    """
    spark, version = entries.sparkSession, uuid.uuid4().hex
    entries.write.option("maxRecordsPerFile", per_file).parquet(f"{path}/versions/{version}")
    row = json.dumps(dict(sorted((parameters or {}).items())), sort_keys=True)
    last = _last_pointer(spark, path)
    pointer = spark.createDataFrame([((last["seq"] if last else 0) + 1, version, row)], POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{path}/pointers")
    return version


def _last_pointer(spark: SparkSession, path: str):
    try:
        return spark.read.schema(POINTER).json(f"{path}/pointers").orderBy(F.desc("seq"), F.desc("version")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_retrieval(spark: SparkSession, path: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """The entries published last; an error names the first parameter that differs from the wanted ones."""
    last = _last_pointer(spark, path)
    if last is None:
        raise ValueError(f"no finished retrieval store under {path}")
    held = json.loads(last["parameters"])
    for name, value in sorted((parameters or {}).items()):
        if held.get(name) != value:
            raise ValueError(f"retrieval store was made with {name}={held.get(name)!r}, wanted {value!r}")
    return spark.read.parquet(f"{path}/versions/{last['version']}")


def sink_report(df: DataFrame, path: str) -> None:
    """A metric table as CSV, and appended to a JSON-lines log."""
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    df.write.mode("append").json(f"{path}/log")
