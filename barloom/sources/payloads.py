"""Shaping nested payloads into rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.functions.times import date_text_ms
from barloom.operators.splits import keep_last

_RATE = T.StructType([T.StructField("exchange", T.StringType()), T.StructField("funding_rate", T.StringType())])
MARGIN_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("stablecoin_margin_list", T.ArrayType(_RATE)),
        T.StructField("token_margin_list", T.ArrayType(_RATE)),
    ]
)
PARALLEL_SCHEMA = T.StructType(
    [
        T.StructField("time_list", T.ArrayType(T.LongType())),
        T.StructField("price_list", T.ArrayType(T.DoubleType())),
        T.StructField("data_list", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
    ]
)
# Names of the ten positional bands.
BANDS = ("lowest", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth")
TIME_NAMES = ("timestamp", "ts", "time", "timestampMs", "T")


def normalise_payload(df: DataFrame, rename: Mapping[str, str], symbol: Column, period: str) -> DataFrame:
    """Mapped columns under their names, a time column in seconds, stamped keys, one row per key.

    Times above 1e12 anywhere mean the column holds milliseconds. Of equal keys the row with the
    smallest values is kept.
    """
    hit = {k: v for k, v in rename.items() if k in df.columns}
    out = df.withColumnsRenamed(hit)
    source = next(c for c in TIME_NAMES if c in out.columns)
    in_ms = out.agg((F.max(source) > F.lit(10**12)).alias("ms")).scalar()
    t = F.col(source).cast("long")
    seconds = F.when(in_ms, F.floor(t / 1000)).otherwise(t).cast("long")
    values = [v for v in rename.values() if v != "timestamp"]
    rows = out.select(seconds.alias("timestamp"), *values, symbol.alias("symbol"), F.lit(period).alias("period"))
    key = ["timestamp", "symbol", "period"]
    first = rows.groupBy(*key).agg(F.min(F.struct(*values)).alias("_first"))
    return first.select(*key, *[F.col(f"_first.{v}").alias(v) for v in values])


def flatten_margins(payload: DataFrame, json: str) -> DataFrame:
    """Two arrays per symbol to rows (symbol, exchange, margin_type, funding_rate_accum)."""
    parsed = payload.select(F.from_json(json, MARGIN_SCHEMA).alias("p")).select("p.*")
    tag = lambda c, t: F.transform(
        F.coalesce(F.col(c), F.array().cast(T.ArrayType(_RATE))),
        lambda r: F.struct(
            r.exchange.alias("exchange"), F.lit(t).alias("margin_type"), r.funding_rate.alias("rate")
        ),
    )
    rows = parsed.select(
        "symbol", F.inline(F.concat(tag("stablecoin_margin_list", "stablecoin"), tag("token_margin_list", "token")))
    )
    return rows.select("symbol", "exchange", "margin_type", F.col("rate").try_cast("double").alias("funding_rate_accum"))


def zip_parallel(payload: DataFrame, json: str, ids: Sequence[str] = (), unit_ms: int = 1) -> DataFrame:
    """Parallel time / price / map arrays to rows; maps are summed, short arrays give NULL.

    Rows beyond the time array are dropped, since only time decides how many there are.
    """
    p = F.from_json(json, PARALLEL_SCHEMA)
    zipped = F.arrays_zip(p.time_list.alias("t"), p.price_list.alias("p"), p.data_list.alias("d"))
    rows = payload.select(*ids, F.posexplode(zipped).alias("pos", "z"), F.size(p.time_list).alias("n")).filter("pos < n")
    known = F.filter(F.map_values("z.d"), lambda v: v.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))
    return rows.select(*ids, (F.col("z.t") * unit_ms).alias("timestamp"), F.col("z.p").alias("price"), total.alias("total"))


def name_bands(payload: DataFrame, values: str, ids: Sequence[str] = ()) -> DataFrame:
    """Positions 1 to 10 of an array to named bands, position 11 to the time."""
    at = lambda i: F.get(F.col(values), F.lit(i)).cast("double")
    return payload.select(*ids, F.get(F.col(values), F.lit(11)).cast("long").alias("timestamp"), *[at(i + 1).alias(b) for i, b in enumerate(BANDS)])


def daily_last(df: DataFrame, date_text: str, order: Sequence[str], fmt: str = "yyyy/MM/dd") -> DataFrame:
    """Date text to UTC ms, last row per day."""
    return keep_last(df.withColumn("timestamp", date_text_ms(F.col(date_text), fmt)), ["timestamp"], order)
