"""Epoch, date-text and calendar expressions (all UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Period aliases and unit lengths in ms.
PERIOD_ALIASES = {
    3_600_000: ("1h", "h1", "60m", "60min", "60minutes"),
    14_400_000: ("4h", "h4", "240m", "240min", "240minutes"),
    86_400_000: ("1d", "d", "1day", "day", "24h"),
}
UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}

_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSX",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
)


def epoch_ms(c: Column) -> Column:
    """Row rule: epochs below 1e11 are seconds."""
    n = c.cast("long")
    return F.when(F.abs(n) < F.lit(100_000_000_000), n * F.lit(1000)).otherwise(n)


def with_epoch_ms(df: DataFrame, col: str) -> DataFrame:
    """Column rule: a median of at most ten digits means the whole column holds seconds.

    The median is at most ten exactly when more than half of the values are that short, so two
    counters replace the sort.
    """
    digits = F.length(F.abs(F.col(col).cast("long")).cast("string"))
    hist = df.agg(F.count(col).alias("n"), F.count_if(digits <= 10).alias("short"))
    # at most ten digits at the upper middle position
    seconds = hist.select((F.col("short") * 2 > F.col("n")).alias("seconds")).scalar()
    n = F.col(col).cast("long")
    return df.withColumn(col, F.when(seconds, n * 1000).otherwise(n))


def parse_datetime(c: Column) -> Column:
    """Mixed text to timestamp, first format that fits; NULL when none does."""
    s = F.trim(c.cast("string"))
    dated = s.rlike(".[-/]")  # every format has one behind its year; each format that fails costs an exception
    return F.when(dated, F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in _DATE_FORMATS]))


def robust_timestamp(c: Column) -> Column:
    """Text dates, else epoch numbers in ms or s."""
    number = F.trim(c.cast("string")).try_cast("double").try_cast("long")
    return F.coalesce(parse_datetime(c), F.timestamp_millis(epoch_ms(number)))


def time_literal_ms(c: Column, now_ms: Column | None = None) -> Column:
    """User time input to epoch ms: 13 digits, 10 digits, YYYYMMDD, dates, ISO text or `now`."""
    s = F.trim(c.cast("string"))
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    return (
        F.when(F.lower(s) == "now", now)
        .when(s.rlike(r"^\d{13}$"), s.try_cast("long"))
        .when(s.rlike(r"^\d{10}$"), s.try_cast("long") * 1000)
        .when(s.rlike(r"^\d{8}$"), F.unix_millis(F.try_to_timestamp(s, F.lit("yyyyMMdd"))))
        .otherwise(F.unix_millis(parse_datetime(s)))
    )


def floor_step(ts: Column, step: int | Column) -> Column:
    """Start of the step that holds ts (floor also below zero)."""
    step = F.lit(step) if isinstance(step, int) else step
    return ts - F.pmod(ts, step)


def period_ms(c: Column) -> Column:
    """Period text to ms: known aliases, else a count with unit ms, s, m, h or d; NULL for anything else."""
    s = F.replace(F.lower(F.trim(c.cast("string"))), F.lit(" "), F.lit(""))
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for ms, aliases in PERIOD_ALIASES.items():
        out = out.when(s.isin(*aliases), F.lit(ms).cast("long"))
    count = F.regexp_extract(s, r"^(\d+)(ms|s|m|h|d)$", 1).try_cast("long")
    unit = F.regexp_extract(s, r"^(\d+)(ms|s|m|h|d)$", 2)
    for u, ms in UNIT_MS.items():
        out = out.when(unit == u, count * F.lit(ms).cast("long"))
    return out


def date_text_ms(c: Column, fmt: str = "yyyy/MM/dd") -> Column:
    return F.unix_millis(F.try_to_timestamp(F.trim(c), F.lit(fmt)))


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Hour-of-day and weekday (Monday = 0) on the circle."""
    turn = 2 * math.pi
    hour, day = F.hour(ts).cast("double"), F.weekday(ts).cast("double")
    return {
        "hour_sin": F.sin(hour * turn / 24),
        "hour_cos": F.cos(hour * turn / 24),
        "dow_sin": F.sin(day * turn / 7),
        "dow_cos": F.cos(day * turn / 7),
    }
