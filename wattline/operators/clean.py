"""Cleaning, coercion, gap repair and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wattline.functions.blocks import BLOCK, carry

# How dates are written. Every pattern has three groups; ``order`` says which of year, month, day each is. The first group of
# "a b year" is the month, unless the column is day-first or no such month exists.
_MONTH = r"([A-Za-z]{3,9})\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_WEEKDAY = r"(?:(?:[Mm]on|[Tt]ue|[Ww]ed|[Tt]hu|[Ff]ri|[Ss]at|[Ss]un)[A-Za-z]*\.?,?\s+)?"
DATE_LAYOUTS = {
    "year first": (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "ymd"),
    "year, month and day signs": (r"(\d{4})年(\d{1,2})月(\d{1,2})日", "ymd"),
    "year last": (r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "mdy"),
    "month name first": (_WEEKDAY + _MONTH + r"[ -]+" + _DAY + r",?[ -]+(\d{4})", "mdy"),
    "month name in the middle": (_WEEKDAY + _DAY + r"[ -/.]*" + _MONTH + r",?[ -/.]*(\d{4})", "dmy"),
}
YEAR_LAST = "year last"
# hour, minute, second, fraction, half of the day, zone
_CLOCK = r"(?:[T ,]{sep}(\d{1,2}):(\d{1,2})(?::(\d{1,2})(\.\d+)?)?\s*([AaPp]\.?[Mm]\.?)?\s*(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?)?\s*Z?\s*$"
DIGITS = r"^\s*(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(?:(\d{2})(\.\d+)?)?)?\s*Z?\s*$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SERIAL_DAY_ZERO = "1899-12-30"


# --- coercion ---
def _pattern(name: str) -> str:
    return r"^\s*" + DATE_LAYOUTS[name][0] + _CLOCK.replace("{sep}", "*" if "signs" in name else "+")


def _moment(parts: Column, order: str) -> Column:
    """A timestamp from the nine parts of a text: three of the date in ``order``, six of the clock."""

    def number(k: int) -> Column:
        return F.coalesce(parts[k].try_cast("int"), F.lit(0))

    named = F.array_position(F.lit(list(MONTHS)), F.lower(F.substring(parts[order.index("m")], 1, 3))).cast("int")
    month = F.coalesce(parts[order.index("m")].try_cast("int"), named)
    half = F.lower(F.substring(parts[7], 1, 1))
    hour = F.when(half == "", number(3)).when(number(3).between(1, 12), number(3) % 12 + F.when(half == "p", 12).otherwise(0))
    at = F.try_make_timestamp_ntz(number(order.index("y")), month, number(order.index("d")), hour, number(4), number(5))
    up = F.when(F.coalesce(parts[6].try_cast("double"), F.lit(0.0)) > 0.5, 1).otherwise(0)
    zone = F.regexp_replace(parts[8], ":", "")
    ahead = F.coalesce(F.substring(zone, 2, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(zone, 4, 2).try_cast("int"), F.lit(0))
    ahead = F.when(zone.startswith("-"), -ahead).when(zone.startswith("+"), ahead).otherwise(0)
    return at + F.make_dt_interval(secs=up) - F.make_dt_interval(mins=ahead)


def _read(text: Column, pattern: str, groups: int, orders: Sequence[str]) -> Column:
    """The first of ``orders`` in which a text of this pattern is a date; the text is taken apart once."""
    marks = ";".join(f"${k}" if k <= groups else "" for k in range(1, 10))
    parts = F.array(F.split(F.regexp_replace(text, pattern, marks), ";", -1))
    return F.when(text.rlike(pattern), F.transform(parts, lambda p: F.coalesce(*[_moment(p, o) for o in orders]))[0])


def ts_coerce(text: Column, day_first: bool | Column = False) -> Column:
    """Text to timestamp: mixed layouts first, then spreadsheet serial days, rounded to the second.

    Dates: year first with ``-``, ``/``, ``.`` or year-month-day signs, one or two digits each; year last, month before day unless
    ``day_first`` or only the other way is a date; English month names, whole or their first three letters, with or without a
    weekday; 8, 12 or 14 digits without separators. Times: after a blank, comma or ``T``; hours and minutes, with or
    without seconds and fractions, AM or PM, and ``Z``, ``UTC``, ``GMT`` or an offset such as ``+08:00``. A time with an offset is
    turned to UTC; one without is kept as written. Anything else, and dates and times that do not exist (also 24:00), become NULL
    (see ``ts_rejects``).
    """
    swapped = day_first if isinstance(day_first, Column) else F.lit(day_first)
    tries = []
    for name, (_, order) in DATE_LAYOUTS.items():
        pattern = _pattern(name)
        if name == YEAR_LAST and not (day_first is False):
            tries.append(F.when(swapped, _read(text, pattern, 9, ["dmy", "mdy"])).otherwise(_read(text, pattern, 9, ["mdy", "dmy"])))
        else:
            tries.append(_read(text, pattern, 9, ["mdy", "dmy"] if name == YEAR_LAST else [order]))
    tries.append(_read(text, DIGITS, 7, ["ymd"]))
    days = text.try_cast("double")
    in_calendar = days.between(-600_000.0, 2_900_000.0)  # also leaves out inf and NaN
    secs = F.when(in_calendar, F.round(days * 86400.0)).cast("long")
    serial = F.lit(SERIAL_DAY_ZERO).cast("timestamp_ntz") + F.make_dt_interval(secs=secs)
    return F.date_trunc("second", F.coalesce(*tries, serial)).cast("timestamp_ntz")


def layout_votes(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """How a column's time texts are written, per group: rows that each layout reads, and which way year-last dates go.

    ``month_only`` and ``day_only`` count year-last dates whose other reading is no date (a part above 12); ``day_first`` is true if
    there are more of the second. Texts that could be read both ways do not vote.
    """
    text = F.col(column)
    first, second = (F.regexp_extract(text, _pattern(YEAR_LAST), k).try_cast("int") for k in (1, 2))
    counts = [F.count_if(text.rlike(_pattern(name))).alias(name.replace(",", "").replace(" ", "_")) for name in DATE_LAYOUTS]
    votes = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *counts, F.count_if(text.rlike(DIGITS)).alias("digits"),
        F.count_if(first.between(1, 12) & (second > 12)).alias("month_only"), F.count_if((first > 12) & second.between(1, 12)).alias("day_only"),
    )
    return votes.withColumn("day_first", F.col("day_only") > F.col("month_only"))


def ts_read(df: DataFrame, column: str, out: str = "ts") -> DataFrame:
    """Adds ``out``, the column's timestamps, with year-last dates read the way the column's unambiguous ones go.

    The vote is one aggregate over the column, as a scalar subquery.
    """
    return df.withColumn(out, ts_coerce(F.col(column), layout_votes(df, column).select("day_first").scalar()))


def ts_rejects(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per group, how many hold no time text, and how many hold one that ``ts_coerce`` cannot read."""
    blank = F.col(column).isNull() | (F.trim(F.col(column)) == "")
    bad = ~blank & ts_coerce(F.col(column)).isNull()
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("blank"), F.count_if(bad).alias("rejected"))


def readable(df: DataFrame, text: str, ts: str, rejected: Observation | None = None, strict: bool = False) -> DataFrame:
    """Rows with a timestamp; what is left out is counted or stops the plan.

    ``rejected`` is filled by the first action on the result: ``rows``, ``blank`` (no time text) and ``rejected`` (a text that could
    not be read). With ``strict`` the first such text is an error.
    """
    blank = F.col(text).isNull() | (F.trim(F.col(text)) == "")
    bad = ~blank & F.col(ts).isNull()
    if rejected is not None:
        df = df.observe(rejected, F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("blank"), F.count_if(bad).alias("rejected"))
    if strict:
        stop = F.raise_error(F.concat(F.lit("time text cannot be read: "), F.col(text))).cast(df.schema[ts].dataType)
        df = df.withColumn(ts, F.when(bad, stop).otherwise(F.col(ts)))
    return df.where(F.col(ts).isNotNull())


def num_coerce(text: Column) -> Column:
    """Text to double; anything that is not a finite number becomes NULL."""
    v = text.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def finite(v: Column) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def zero_fill(v: Column) -> Column:
    return F.coalesce(finite(v), F.lit(0.0))


def missing_mask(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of NULLs (one pass)."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return sums.unpivot([], list(columns), "feature", "missing")


# --- fills ---
def interp_pos(
    df: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str], width: int = BLOCK, clip_lower: float | None = None
) -> DataFrame:
    """Linear fill along ``pos``; flat before the first and after the last value.

    With ``pos`` a row position this is the positional fill, with ``pos`` in
    seconds the time-weighted one.
    """
    d = carry(df, keys, pos, {f"_f_{v}": F.col(v) for v in values}, width)
    cols = []
    for v in values:
        a, pa, b, pb = [F.col(f"_f_{v}_{x}") for x in ("prev", "prev_pos", "next", "next_pos")]
        filled = (
            F.when(F.col(v).isNotNull(), F.col(v))
            .when(a.isNull(), b)
            .when(b.isNull(), a)
            .otherwise(a + (b - a) * (F.col(pos) - pa) / (pb - pa))
        )
        if clip_lower is not None:
            filled = F.greatest(filled, F.lit(clip_lower))
        cols.append(filled.alias(v))
    return d.select(*[c for c in df.columns if c not in values], *cols)


def interp_time(
    df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], clip_lower: float | None = None, width: int = 30 * 86400
) -> DataFrame:
    """Time-weighted linear fill, flat at both ends; blocks are ``width`` seconds wide."""
    from wattline.functions.calendar import seconds

    timed = df.withColumn("_sec", seconds(F.col(ts)))
    return interp_pos(timed, keys, "_sec", values, width, clip_lower).drop("_sec")


def ffill_bfill(df: DataFrame, keys: Sequence[str], pos: str, value: str, width: int = BLOCK) -> DataFrame:
    d = carry(df, keys, pos, {"_f": F.col(value)}, width)
    return d.withColumn(value, F.coalesce("_f_prev", "_f_next")).select(*df.columns)


def ffill(df: DataFrame, keys: Sequence[str], pos: str, value: str, width: int = BLOCK) -> DataFrame:
    d = carry(df, keys, pos, {"_f": F.col(value)}, width, backward=False)
    return d.withColumn(value, F.col("_f_prev")).select(*df.columns)


# --- duplicates ---
def dedupe_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """Keep one whole row per key: the first (or last) in ``order``.

    ``min_by`` / ``max_by`` combine before the shuffle, so copies of a hot key
    never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*order)
    row = F.struct(*rest)
    pick = F.max_by(row, at) if last else F.min_by(row, at)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


# --- normalisation ---
def minmax_norm(df: DataFrame, value: str, in_train: Column | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Add ``{value}_norm``, ``vmin``, ``vmax``: one global range, taken from the rows ``in_train``.

    The two bounds are a scalar subquery, so the plan stays one job and only one row is shipped.
    """
    if bounds is not None:
        lo, hi = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    else:
        v = F.col(value) if in_train is None else F.when(in_train, F.col(value))
        got = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("b")).scalar()
        lo, hi = got["lo"], got["hi"]
    out = df.withColumn("vmin", lo).withColumn("vmax", hi)
    return out.withColumn(
        f"{value}_norm", (F.col(value) - F.col("vmin")) / (F.col("vmax") - F.col("vmin") + F.lit(1e-8))
    )


def denormalize(v: Column, vmin: Column, vmax: Column) -> Column:
    return v * (vmax - vmin) + vmin


# --- tables ---
def drop_zero_features(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Keep the features whose absolute values do not sum to zero."""
    alive = long.groupBy(feature).agg(F.sum(F.abs(F.col(value))).alias("_s")).where("_s > 0").select(feature)
    return long.join(alive, feature, "left_semi")


def zone_from_flag(flag: Column) -> Column:
    number = F.coalesce(flag.try_cast("double"), F.lit(0.0))
    return F.when(number > 0, "CBD").otherwise("Residential")


def validate(df: DataFrame, keys: Sequence[str], value: str, required: Sequence[str], n_time: int | None = None,
             n_nodes: int | None = None, strict: bool = False, split: str | None = None) -> DataFrame:
    """Rows ``(check, found, ok)``; with ``strict`` a failed check raises when the plan runs.

    ``split`` names a column: the share of missing values is then also given for each of its values.
    """
    checks = [("missing_column:" + c, F.lit(0 if c in df.columns else 1).cast("double"), F.lit(c in df.columns)) for c in required]
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(*[F.col(k) for k in keys]).alias("nk"),
        F.avg(F.col(value).isNull().cast("double")).alias("nulls"),
    )
    rows = [F.struct(F.lit(name).alias("check"), found.alias("found"), ok.alias("ok")) for name, found, ok in checks]
    rows.append(F.struct(F.lit("null_share").alias("check"), F.col("nulls").alias("found"), (F.col("nulls") == 0).alias("ok")))
    if n_nodes is not None:
        rows.append(F.struct(F.lit("node_count").alias("check"), F.col("nk").cast("double").alias("found"), (F.col("nk") == n_nodes).alias("ok")))
    if n_nodes is not None and n_time is not None:
        rows.append(F.struct(F.lit("cell_count").alias("check"), F.col("n").cast("double").alias("found"), (F.col("n") == n_nodes * n_time).alias("ok")))
    out = stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if split is not None:
        shares = df.groupBy(split).agg(F.avg(F.col(value).isNull().cast("double")).alias("found"))
        out = out.unionByName(shares.select(F.concat(F.lit("null_share:"), F.col(split)).alias("check"), "found", (F.col("found") == 0).alias("ok")))
    if strict:
        out = out.withColumn("ok", F.when(F.col("ok"), F.col("ok")).otherwise(F.raise_error(F.concat(F.lit("failed check: "), "check")).cast("boolean")))
    return out
