"""Bar tables: building them from ticks, scanning them from files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.functions.nulls import nan_to_null
from barloom.functions.symbols import canonical_symbol
from barloom.functions.times import floor_step
from barloom.schema import BAR_SCHEMA, PERIODS
from barloom.sources.delimited import delimited_rows, field


def ticks_to_bars(
    ticks: DataFrame,
    period: str,
    symbol: Column,
    ts_ms: Column,
    price: Column,
    volume: Column,
    tie: Sequence[Column] = (),
) -> DataFrame:
    """One bar per (symbol, step). Open and close are the first and last price by (time, ties, price)."""
    rank = F.struct(F.col("_ts"), *[F.col(f"_t{i}") for i in range(len(tie))], F.col("_p"))
    return (
        ticks.select(
            symbol.alias("symbol"),
            ts_ms.alias("_ts"),
            price.cast("double").alias("_p"),
            volume.cast("double").alias("_v"),
            *[t.alias(f"_t{i}") for i, t in enumerate(tie)],
        )
        .withColumn("timestamp", floor_step(F.col("_ts"), PERIODS[period].step_ms))
        .groupBy("symbol", "timestamp")
        .agg(
            F.min_by("_p", rank).alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", rank).alias("close"),
            F.sum("_v").alias("volume"),
        )
        .select(
            "timestamp",
            "open",
            "high",
            "low",
            "close",
            "volume",
            F.timestamp_millis("timestamp").alias("datetime"),
            "symbol",
            F.lit(period).alias("period"),
        )
    )


def read_bars_csv(spark: SparkSession, root: str, period: str) -> DataFrame:
    """All `<root>/<period>/<SYMBOL>_<period>_*.csv` in one scan, whatever column suffix each file carries.

    Columns may be called `close` or `close_<SYMBOL>_<period>`; the symbol comes from the file's name.
    """
    rows = delimited_rows(spark, f"{root}/{period}")
    stem = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    suffixed = lambda base: F.get(F.filter("header", lambda h: h.startswith(f"{base}_") & h.endswith(f"_{period}")), 0)
    prices = [F.coalesce(field(c), field(suffixed(c))).alias(c) for c in ("open", "high", "low", "close", "volume")]
    raw = rows.select(*[field(c).alias(c) for c in ("timestamp", "datetime")], *prices, F.regexp_replace(stem, rf"_{period}(?:_.*)?$", "").alias("_symbol"))
    return tolerant(raw, F.col("_symbol"), period)


def tolerant(raw: DataFrame, symbol: Column, period: str) -> DataFrame:
    """Any superset of the bar columns to the bar schema; a missing datetime or timestamp is derived."""
    have = set(raw.columns)
    ts = F.col("timestamp").try_cast("double").try_cast("long") if "timestamp" in have else F.lit(None).cast("long")
    dt = F.col("datetime").try_cast("timestamp") if "datetime" in have else F.lit(None).cast("timestamp")
    num = lambda c: F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")
    return nan_to_null(
        raw.select(
            F.coalesce(ts, F.unix_millis(dt)).alias("timestamp"),
            *[num(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
            F.coalesce(dt, F.timestamp_millis(ts)).alias("datetime"),
            canonical_symbol(symbol).alias("symbol"),
            F.lit(period).alias("period"),
        )
    )


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet bar table (partitioned by period)."""
    return nan_to_null(spark.read.schema(BAR_SCHEMA).parquet(path))


def symbols_in(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def restrict(bars: DataFrame, periods: Sequence[str] = (), symbols: Sequence[str] = ()) -> DataFrame:
    """Period and symbol filter; rows with a missing key go."""
    out = bars.na.drop(subset=["symbol", "period", "timestamp"])
    if periods:
        out = out.filter(F.col("period").isin(*periods))
    if symbols:
        out = out.filter(F.col("symbol").isin(*symbols))
    return out
