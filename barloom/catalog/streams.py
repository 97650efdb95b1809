"""Streaming queries, run to the end of the available data and compared with batch SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from barloom.catalog.indicators import KEY, W
from barloom.catalog.recursive import ORACLE as REC, ema, recursion
from barloom.catalog.tables import bars, bars_sql, settle_sql, settled
from barloom.operators.kernels import averages, parabolic_stop
from barloom.sources.staging import staged, staging_path
from barloom.streaming import bars as st

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def streamed_hourly_bars(spark, sf):
    """Ticks to hourly bars; a bar appears once the watermark of two hours has passed its end."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.stream_bars(ticks, "1h", F.col("event_type"), "ts", F.col("value"), F.lit(1), tie=[F.col("event_id")])
    return settled(st.run_available(out, staging_path(spark, "hourly")), KEY, ["open", "high", "low", "close", "volume"])


ORACLE["streamed_hourly_bars"] = f"""WITH {bars_sql('1h')}, wm AS (SELECT max(epoch_us(ts)) // 1000 - 7200000 AS w FROM events)
SELECT symbol, period, timestamp, {', '.join(settle_sql(c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM bars, wm WHERE timestamp + 3600000 <= w"""


def _bar_files(spark, sf, period: str, cuts: int, repeat: bool = False):
    """The bar table as files that arrive in time order, for a stream to pick up one after the other."""
    table_ = bars(spark, sf, period)
    lo, hi = table_.agg(F.min("timestamp"), F.max("timestamp")).first()
    width = (hi - lo) // cuts + 1
    path = staging_path(spark, "arrivals")
    for i in range(cuts):
        start = lo + i * width - (width // 4 if repeat and i else 0)
        part = table_.filter((F.col("timestamp") >= start) & (F.col("timestamp") < lo + (i + 1) * width))
        part.repartition("symbol").write.mode("append").parquet(path)  # one file per symbol and arrival
    return spark.readStream.schema(table_.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def streamed_bars_once(spark, sf):
    """4h bars arriving in overlapping files, each kept once."""
    stream = _bar_files(spark, sf, "4h", 3, repeat=True)
    out = st.run_available(st.once_per_bar(stream, "20 days"), staging_path(spark, "once"))
    return settled(out, KEY, ["close"])


ORACLE["streamed_bars_once"] = f"WITH {bars_sql('4h')} SELECT symbol, period, timestamp, {settle_sql('close')} FROM bars"


def _late_files(spark, sf, period: str, cuts: int, table_=None):
    """The bar table as files, every third bar of a time slice one slice late, and repeats; and how late a bar can come.

    A last bar of no symbol, far ahead, moves the watermark past all others and stays in the state.
    """
    table_ = bars(spark, sf, period) if table_ is None else table_
    lo, hi = table_.agg(F.min("timestamp"), F.max("timestamp")).first()
    width = (hi - lo) // cuts + 1
    part, held = F.floor((F.col("timestamp") - lo) / width), F.pmod(F.xxhash64("timestamp"), F.lit(3)) == 0
    path = staging_path(spark, "arrivals")
    for i in range(cuts + 1):
        arrived = table_.filter(((part == i) & ~held) | (part == i - 1))
        arrived.repartition("symbol").write.mode("append").parquet(path)  # one file per symbol and arrival
    end = (F.lit(hi) + 4 * width).cast("long")
    last = table_.limit(1).withColumns({"symbol": F.lit(None).cast("string"), "timestamp": end, "datetime": F.timestamp_millis(end)})
    last.select(table_.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(table_.schema).option("maxFilesPerTrigger", 1).parquet(path), f"{3 * width} milliseconds"


def _stateful(spark, arrivals, processor, name, history=None):
    stream, late = arrivals
    before = spark.conf.get(st.STATE_CONF)
    spark.conf.set(st.STATE_CONF, st.ROCKSDB)
    try:
        return st.run_available(st.stateful(stream, processor, late, history), staging_path(spark, name))
    finally:
        spark.conf.set(st.STATE_CONF, before)


@query
def streamed_ema(spark, sf):
    """Exponential averages kept in keyed state over arrivals out of order."""
    return settled(_stateful(spark, _late_files(spark, sf, "1d", 3), st.EmaState((12, 26)), "ema"), KEY)


ORACLE["streamed_ema"] = f"""WITH RECURSIVE {bars_sql('1d')}, b AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS pos FROM bars),
{recursion('rec', 'b', {'ema_12': ('n.close', ema('ema_12', 'n.close', '(2.0/13)')), 'ema_26': ('n.close', ema('ema_26', 'n.close', '(2.0/27)'))})}
SELECT symbol, period, timestamp, {settle_sql('ema_12')}, {settle_sql('ema_26')} FROM rec"""


@query
def streamed_parabolic_stop(spark, sf):
    """The parabolic stop kept in keyed state over arrivals out of order."""
    return settled(_stateful(spark, _late_files(spark, sf, "1d", 3), st.StopState(), "stop"), KEY)


ORACLE["streamed_parabolic_stop"] = f"SELECT symbol, period, timestamp, psar FROM ({REC['parabolic_stop']})"


def _continued(spark, sf, processor, batch, name):
    """Bars up to a day of 1996 in a batch, later ones in a stream that starts from the batch's ends; some old ones arrive again."""
    all_bars = bars(spark, sf, "1d")
    before, repeated = F.col("timestamp") < _DAY, F.col("timestamp") >= _DAY - 20 * 86_400_000
    history = staged(processor.history(all_bars.where(before)), f"{name}-history")
    arrivals = _late_files(spark, sf, "1d", 3, all_bars.where(~before | repeated))
    streamed = _stateful(spark, arrivals, processor, name, history)
    return settled(batch(all_bars.where(before)).select(streamed.columns).unionByName(streamed), KEY)


_DAY = 830_000_000_000 // 86_400_000 * 86_400_000


@query
def continued_ema(spark, sf):
    """Exponential averages of a batch, carried on by a stream."""
    spans = (12, 26)
    return _continued(spark, sf, st.EmaState(spans), lambda b: averages(b, spans), "continued-ema")


ORACLE["continued_ema"] = ORACLE["streamed_ema"]


@query
def continued_parabolic_stop(spark, sf):
    """The parabolic stop of a batch, carried on by a stream."""
    return _continued(spark, sf, st.StopState(), parabolic_stop, "continued-stop")


ORACLE["continued_parabolic_stop"] = ORACLE["streamed_parabolic_stop"]
