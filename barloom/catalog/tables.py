"""Bars, slow series, predictions and evaluation rows derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from barloom.sources.bars import ticks_to_bars
from barloom.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One given table; zone-less times are read as UTC instants. A schema is inferred once per path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_schemas[path]).parquet(path)
    plain = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


# Doubles are compared after rounding. The shift is not one half, because short decimals and their
# averages sit exactly on halves, where a last-bit difference between engines would split them.
_SHIFT = 0.4871
_TIERS = ((1e5, 1e6), (1e9, 1e2), (None, 1e-4))


def settle(c: Column) -> Column:
    """Six decimals, fewer for large magnitudes."""
    out = None
    for bound, scale in _TIERS:
        value = F.floor(c * scale + _SHIFT).cast("double") / scale
        if bound is None:
            return out.otherwise(value)
        out = F.when(F.abs(c) < bound, value) if out is None else out.when(F.abs(c) < bound, value)


def settle_sql(expr: str, name: str | None = None) -> str:
    cases = "".join(
        f" WHEN abs({expr}) < {b:.0e} THEN floor({expr} * {s:.0e} + {_SHIFT}) / {s:.0e}"
        if b
        else f" ELSE floor({expr} * {s:.0e} + {_SHIFT}) / {s:.0e}"
        for b, s in _TIERS
    )
    return f"CAST(CASE{cases} END AS DOUBLE) AS {name or expr}"


def settled(df: DataFrame, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The keys as they are and the other columns with doubles settled."""
    types = dict(df.dtypes)
    cols = [c for c in df.columns if c not in keys] if cols is None else cols
    return df.select(
        *keys, *[settle(F.col(c)).alias(c) if types[c] in ("double", "float") else F.col(c) for c in cols]
    )


def bars_intraday(spark: SparkSession, sf: str, period: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ticks_to_bars(
        ev,
        period,
        F.col("event_type"),
        F.unix_millis("ts"),
        F.col("value"),
        F.lit(1),
        tie=[F.unix_micros("ts"), F.col("event_id")],
    )


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sold positions with their market segment. Orders meet customers first, so that positions are shuffled once."""
    li, od, cu = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    return (
        li.join(od.join(cu, od.o_custkey == cu.c_custkey).select("o_orderkey", "c_mktsegment"), li.l_orderkey == F.col("o_orderkey"))
        .select("c_mktsegment", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber")
    )


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_to_bars(
        sales(spark, sf),
        "1d",
        F.col("c_mktsegment"),
        F.unix_millis("l_shipdate"),
        F.col("l_extendedprice") / F.col("l_quantity"),
        F.col("l_quantity"),
        tie=[F.col("l_orderkey"), F.col("l_linenumber")],
    )


def bars(spark: SparkSession, sf: str, *periods: str) -> DataFrame:
    """Bars of the given periods (all three when none is named), written once per call.

    The operators read their bars more than once (layout, carry-ins, values), so the joins and
    aggregations that build them are cut off here by a table in the shared folder.
    """
    out = None
    for p in periods or ("1h", "4h", "1d"):
        one = bars_daily(spark, sf) if p == "1d" else bars_intraday(spark, sf, p)
        out = one if out is None else out.unionByName(one)
    return staged(out, "bars")


_SQL_SHAPE = """
SELECT symbol, '{p}' AS period, timestamp,
       first(price ORDER BY {rank}) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY {rank}) AS close, sum(vol) AS volume
FROM {src} GROUP BY symbol, timestamp"""


def _ticks_sql(p: str) -> str:
    step = {"1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}[p]
    if p == "1d":
        return f"""ticks_1d AS (
SELECT c_mktsegment AS symbol, (epoch_ms(l_shipdate) // {step}) * {step} AS timestamp, epoch_ms(l_shipdate) AS ms,
       l_extendedprice / l_quantity AS price, l_quantity AS vol, l_orderkey AS k1, l_linenumber AS k2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
    return f"""ticks_{p} AS (
SELECT event_type AS symbol, (epoch_us(ts) // {step * 1000}) * {step} AS timestamp, epoch_us(ts) // 1000 AS ms,
       value AS price, CAST(1 AS DOUBLE) AS vol, epoch_us(ts) AS k1, event_id AS k2 FROM events)"""


def bars_sql(*periods: str) -> str:
    """WITH-clause body defining `bars` (no leading WITH)."""
    periods = periods or ("1h", "4h", "1d")
    ticks = [_ticks_sql(p) for p in periods]
    rank = "ms, k1, k2, price"
    union = " UNION ALL ".join(_SQL_SHAPE.format(p=p, rank=rank, src=f"ticks_{p}") for p in periods)
    return ",\n".join([*ticks, f"bars AS ({union})"])


# --- slow series --------------------------------------------------------------------------------


def symbol_series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily per-segment order value and count."""
    od, cu = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (
        od.join(cu, od.o_custkey == cu.c_custkey)
        .groupBy(F.unix_millis("o_orderdate").alias("timestamp"), F.col("c_mktsegment").alias("symbol"))
        .agg(F.sum("o_totalprice").alias("order_value"), F.count(F.lit(1)).alias("order_count"))
    )


def global_series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily average order price, absent on every seventh day of the month."""
    od = table(spark, sf, "orders").filter(F.dayofmonth("o_orderdate") % 7 != 0)
    return od.groupBy(F.unix_millis("o_orderdate").alias("timestamp")).agg(F.avg("o_totalprice").alias("avg_price"))


SERIES_SQL = """
sym AS (SELECT epoch_ms(o_orderdate) AS timestamp, c_mktsegment AS symbol, sum(o_totalprice) AS order_value,
               count(*) AS order_count
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
mkt AS (SELECT epoch_ms(o_orderdate) AS timestamp, avg(o_totalprice) AS avg_price
         FROM orders WHERE day(o_orderdate) % 7 <> 0 GROUP BY 1)"""
