"""Readers for the file layouts that sensor and market data come in."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wattline.functions.blocks import row_index
from wattline.operators.clean import dedupe_first, dedupe_mean, num_coerce, readable, ts_read

ENCODINGS = ("UTF-8", "GB18030", "GBK")


def file_encodings(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> list[tuple[str, str, str]]:
    """(file, encoding, header line) of every file that has a line: the first encoding that decodes all of its lines.

    All files and encodings are decided in one pass over the raw lines. No byte of a character is a line end in these
    encodings, so a decoder starts afresh on every line and the lines of a file may be judged apart and put together by
    AND. The driver gets one row per file. A file that no encoding fits is an error.
    """
    names = list(encodings)

    @F.pandas_udf("int")
    def fits(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: sum(1 << k for k, name in enumerate(names) if _decodes(line, name)))

    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = raw.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    judged = lines.groupBy("file").agg(F.bit_and(fits("line")).alias("fit"), F.min_by("line", "at").alias("header")).collect()
    bad = sorted(r["file"] for r in judged if not r["fit"])
    if bad:
        raise ValueError(f"none of {tuple(encodings)} decodes {bad[:3]}")
    chosen = [(r["file"], names[(r["fit"] & -r["fit"]).bit_length() - 1], bytes(r["header"])) for r in judged]
    return sorted((file, name, header.decode(name)) for file, name, header in chosen)


def _decodes(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def scan_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, schema: str | None = None, file_column: str | None = None) -> DataFrame:
    """CSV with a header; each file is read with the first encoding that decodes all of its lines (see ``file_encodings``).

    A file is read twice, whatever the mix. Files may order their columns differently; columns that a file lacks are null. UTF-8
    goes through Spark's reader; other files are decoded line by line and parsed from there, so no session option is
    touched. Headers lose byte-order marks and blanks. ``file_column`` adds the path of each row's file.
    """
    groups: dict[tuple[bool, str, str], list[str]] = {}
    for file, encoding, header in file_encodings(spark, path, encodings):
        plain = encoding.upper().replace("-", "") == "UTF8"
        # paths come URL-encoded, and the reader takes them as patterns
        groups.setdefault((plain, encoding, header), []).append(re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(file)))
    if not groups:
        reader = spark.read.option("header", "true")
        empty = (reader.schema(schema) if schema else reader).csv(path)
        return empty.withColumn(file_column, F.lit(None).cast("string")) if file_column else empty
    parts = []
    for (plain, encoding, header), files in groups.items():
        if plain:
            reader = spark.read.option("header", "true")
            df = (reader.schema(schema) if schema else reader).csv(files)
            extra = [F.col("_metadata.file_path").alias(file_column)] if file_column else []
            df = df.select("*", *extra)
        else:
            df = _decoded_csv(spark, files, encoding, header, schema, file_column)
        parts.append(df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _decoded_csv(spark: SparkSession, files: list[str], encoding: str, header: str, schema: str | None, file_column: str | None) -> DataFrame:
    names = next(csv.reader([header]))
    fields = schema or ", ".join(f"`{c.replace('`', '``')}` string" for c in names)

    @F.pandas_udf("string")
    def decode(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: bytes(line).decode(encoding))

    raw = spark.read.text(files)
    lines = raw.select(decode(F.col("value").cast("binary")).alias("_line"), F.col("_metadata.file_path").alias("_file"))
    rows = lines.where((F.col("_line") != header) & (F.trim("_line") != "")).select(F.from_csv("_line", F.lit(fields)).alias("r"), "_file")
    return rows.select("r.*", *([F.col("_file").alias(file_column)] if file_column else []))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def scan_wide_matrix(spark: SparkSession, path: str, time_column: str | None = None, rejected: Observation | None = None, strict: bool = False) -> DataFrame:
    """Wide ``time, node…`` CSV to rows ``(ts, node_id, value)``; repeated times are averaged.

    Year-last dates are read the way that the column's unambiguous ones go. Rows whose time cannot be read go: ``rejected`` counts
    them when the result is used, ``strict`` makes the first one an error.
    """
    wide = scan_csv(spark, path)
    t = time_column or wide.columns[0]
    nodes = [c for c in wide.columns if c != t]
    timed = readable(ts_read(wide, t, "ts"), t, "ts", rejected, strict)
    long = timed.unpivot(["ts"], nodes, "node_id", "_text")
    return dedupe_mean(long.select("ts", "node_id", num_coerce(F.col("_text")).alias("value")), ["ts", "node_id"], ["value"])


def with_row_position(df: DataFrame, out: str = "_row") -> DataFrame:
    """Zero-based position in the files, in order of file name and offset."""
    marked = df.select(
        "*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_o"), F.monotonically_increasing_id().alias("_m")
    )
    return row_index(marked, [], ["_m"], F.struct("_f", "_o"), out).drop("_f", "_o", "_m")


def scan_time_parts(spark: SparkSession, parts_path: str, values_path: str) -> DataFrame:
    """Timestamps from year…second columns, attached to a value file by row position.

    Files of different length are an error when the plan runs.
    """
    parts = spark.read.option("header", "true").csv(parts_path)
    values = with_row_position(spark.read.option("header", "true").csv(values_path))
    second = F.col("second").cast("int") if "second" in parts.columns else F.lit(0)
    ts = F.make_timestamp_ntz(*[F.col(c).cast("int") for c in ("year", "month", "day", "hour", "minute")], second)
    times = with_row_position(parts).select("_row", ts.alias("ts"))
    same = values.agg(F.count(F.lit(1))).scalar() == times.agg(F.count(F.lit(1))).scalar()
    joined = times.join(values, "_row").withColumn("_same", same)
    return joined.withColumn("ts", F.when(F.col("_same"), F.col("ts")).otherwise(F.raise_error(F.lit("files differ in length")).cast("timestamp_ntz"))).drop("_same")


def scan_station_dir(spark: SparkSession, path: str, time_column: str, value_column: str, rejected: Observation | None = None, strict: bool = False) -> DataFrame:
    """A directory of station files to one table; capacity in MW comes from the file's path.

    Files may have any of ``ENCODINGS``. Rows whose time cannot be read are handled as in ``scan_wide_matrix``.
    """
    raw = ts_read(scan_csv(spark, path, file_column="_path"), time_column, "ts")
    where = F.url_decode(F.regexp_replace("_path", r"\+", "%2B"))
    rows = readable(raw, time_column, "ts", rejected, strict).select(
        F.regexp_extract(where, r"station=([A-Za-z_0-9]+)", 1).alias("station"),
        F.regexp_extract(where, r"Nominal capacity-(\d+)MW", 1).try_cast("double").alias("capacity"),
        "ts", num_coerce(F.col(value_column)).alias("power"),
    )
    return dedupe_first(rows, ["station", "ts"], ["power", "capacity"])


# Free-form sensor headers, first match wins (compared in lower case).
HEADER_RULES = (
    (r"time\(year-month-day", "timestamp"),
    (r"total solar irradiance", "total_solar_irradiance"),
    (r"direct normal irradiance", "direct_normal_irradiance"),
    (r"global horizontal irradiance", "global_horizontal_irradiance"),
    (r"wind speed at height of (10|30|50) meters", r"wind_speed_\1m"),
    (r"wind direction at height of (10|30|50) meters", r"wind_direction_\1m"),
    (r"(?=.*wheel hub)(?=.*m/s)", "wind_speed_hub"),
    (r"(?=.*wheel hub)(?=.*(˚|direction))", "wind_direction_hub"),
    (r"^air temperature", "temperature"),
    (r"atmosphere", "pressure"),
    (r"relative humidity", "humidity"),
    (r"^power", "power_mw"),
)
HEADER_TYPOS = {"horicontal": "horizontal"}


def canonical_header(header: str) -> str:
    text = re.sub(r"\s+", " ", header.strip().lower())
    for wrong, right in HEADER_TYPOS.items():
        text = text.replace(wrong, right)
    for pattern, name in HEADER_RULES:
        hit = re.search(pattern, text)
        if hit:
            return hit.expand(name)
    return re.sub(r"[^a-z0-9]+", "_", text).strip("_")


def canonical_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[canonical_header(c) for c in df.columns])


RECORD_SCHEMA = "variant string, records array<struct<t_start: bigint, node_idx: bigint, domain: string, parse_ok: boolean, parsed_prediction: array<double>, target: array<double>>>"


def scan_records_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested evaluation results to one row per record."""
    nested = spark.read.schema(RECORD_SCHEMA).option("multiLine", multi_line).json(path)
    return nested.select("variant", F.inline("records"))


def scan_split_json(spark: SparkSession, path: str, names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Named index lists to rows ``(split, ordinal, t_idx)``."""
    schema = ", ".join(f"{n} array<bigint>" for n in names)
    lists = spark.read.schema(schema).json(path)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.coalesce(n, F.array().cast("array<bigint>")).alias("ids")) for n in names]))
    return lists.select(each.alias("s")).select("s.split", F.posexplode("s.ids").alias("ordinal", "t_idx"))


def scan_candidate(spark: SparkSession, path: str) -> DataFrame:
    df = require(scan_csv(spark, path), ["day", "slot", "prediction"])
    typed = {"day": "date", "slot": "bigint", "prediction": "double", "target": "double"}
    return df.select(*[F.col(c).cast(typed[c]) if c in typed else F.col(c) for c in df.columns])
