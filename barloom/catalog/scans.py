"""Scans of files in their own layouts: the given tables are written in these formats to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom import columns
from barloom.catalog.indicators import KEY
from barloom.catalog.tables import SERIES_SQL, bars, bars_sql, global_series, settle_sql, settled, symbol_series
from barloom.sources import bars as bar_source, files, series
from barloom.sources.staging import staging_path

QUERIES: dict = {}
ORACLE: dict = {}
PRICES = ("open", "high", "low", "close", "volume")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def settle_all(*cols: str) -> str:
    return ", ".join(settle_sql(c) for c in cols)


def _one_file(df: DataFrame, path: str, kind: str) -> None:
    """A small table as one file of just this name, on whatever storage Spark writes to."""
    spark = df.sparkSession
    df.coalesce(1).write.option("header", True).format(kind).save(f"{path}.parts")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = hadoop(f"{path}.parts")
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in store.listStatus(place) if f.getPath().getName().startswith("part-"))
    store.rename(part, hadoop(path))
    store.delete(place, True)


@query
def scanned_bar_files(spark, sf):
    """4h bars as one CSV folder a symbol, every second one with the symbol in its column names, read in one scan."""
    path, b = staging_path(spark, "bar-files"), bars(spark, sf, "4h")
    for i, symbol in enumerate(sorted(r.symbol for r in b.select("symbol").distinct().collect())):
        own = b.where(F.col("symbol") == symbol).select("timestamp", *[F.col(c).alias(f"{c}_{symbol}_4h" if i % 2 else c) for c in PRICES])
        own.write.csv(f"{path}/4h/{symbol}_4h_all.csv", header=True)
    return settled(bar_source.read_bars_csv(spark, path, "4h"), KEY, list(PRICES))


ORACLE["scanned_bar_files"] = f"WITH {bars_sql('4h')} SELECT upper(symbol) AS symbol, period, timestamp, {settle_all(*PRICES)} FROM bars"


@query
def scanned_series(spark, sf):
    """Slow series in the registry's file layout: one file a symbol, times in seconds or ms, a header without a time; one scan for each level."""
    path, own, market = staging_path(spark, "series"), symbol_series(spark, sf), global_series(spark, sf)
    symbols = sorted(r.symbol for r in own.select("symbol").distinct().collect())
    for symbol in symbols:
        rows = own.where(F.col("symbol") == symbol)
        rows.select((F.col("timestamp") / 1000).cast("long").alias("time"), F.col("order_value").alias("oi_mean_oc"), F.col("order_count").alias("oi_vol")).write.csv(f"{path}/futures/open-interest/{symbol}_USDT_1d.csv", header=True)
    first = own.where(F.col("symbol") == symbols[0])
    first.select("timestamp", (F.col("order_count") * 2).alias("whale_index_value")).write.csv(f"{path}/futures/whale-index-Binance-{symbols[0]}USDT-1d.csv", header=True)
    market.select("timestamp", F.col("avg_price").alias("premium"), (F.col("avg_price") / 4).alias("premium_rate")).write.csv(f"{path}/index/premium-index.csv", header=True)
    market.select(F.col("avg_price").alias("a"), F.col("timestamp").alias("b")).write.csv(f"{path}/index/bitcoin-rhodl_ratio.csv", header=True)
    by_symbol = series.read_symbol_series(spark, path, [f"{s}_USDT" for s in symbols], {"whale": True, "basis": False})
    by_time = series.read_global_series(spark, path, {"premium": True, "rhodl": True, "cb_premium": True, "m2_us": True})
    return settled(by_symbol.join(by_time, "timestamp", "left"), ["symbol", "timestamp"])


ORACLE["scanned_series"] = f"""WITH {SERIES_SQL}, wide AS (
SELECT symbol || '_USDT' AS symbol, timestamp, order_value AS oi_mean_oc, order_count::DOUBLE AS oi_vol,
CASE WHEN symbol = (SELECT min(symbol) FROM sym) THEN order_count * 2.0::DOUBLE END AS whale_index_value_whale_index,
avg_price AS premium_premium_index, avg_price / 4 AS premium_rate_premium_index, avg_price AS rhodl_ratio_bitcoin_bitcoin_rhodl_ratio, avg_price AS cb_premium
FROM sym LEFT JOIN mkt USING (timestamp))
SELECT symbol, timestamp, {settle_all('oi_mean_oc', 'oi_vol', 'whale_index_value_whale_index', 'premium_premium_index', 'premium_rate_premium_index', 'rhodl_ratio_bitcoin_bitcoin_rhodl_ratio', 'cb_premium')} FROM wide"""


@query
def appended_bar_table(spark, sf):
    """A stored table that ends mid-2000 resumed with all bars, each twice: stored and appended ones, once each."""
    path, b = staging_path(spark, "appended"), bars(spark, sf, "1d")
    files.write_long_table(b.where(F.col("timestamp") < 962_409_600_000), path, narrow=False)
    files.append_bars(b.unionByName(b), path)
    return settled(bar_source.read_bars(spark, path), KEY, ["close", "volume"])


ORACLE["appended_bar_table"] = f"WITH {bars_sql('1d')} SELECT symbol, period, timestamp, {settle_all('close', 'volume')} FROM bars"


@query
def converted_csv_table(spark, sf):
    """Bars of two periods as CSV, one period of them converted to the stored table."""
    path = staging_path(spark, "converted")
    files.write_csv(bars(spark, sf, "4h", "1d").drop("datetime"), f"{path}/csv")
    files.csv_to_parquet(spark, f"{path}/csv", f"{path}/table", ["4h"])
    return settled(spark.read.parquet(f"{path}/table"), KEY, list(PRICES))


ORACLE["converted_csv_table"] = f"WITH {bars_sql('4h')} SELECT symbol, period, timestamp, {settle_all(*PRICES)} FROM bars"


@query
def collected_prediction_files(spark, sf):
    """Prediction files of two experts in folders of their own, beside one that is none."""
    path, b = staging_path(spark, "predictions"), bars(spark, sf, "1d")
    for expert, column in (("trend", "close"), ("range", "high")):
        _one_file(b.select(*KEY, F.lit(expert).alias("expert"), F.col(column).alias("score")), f"{path}/{expert}/deep/predictions_{expert}.parquet", "parquet")
    _one_file(b.select(*KEY, F.lit("none").alias("expert"), F.lit(0.0).alias("score")), f"{path}/trend/notes.parquet", "parquet")
    return settled(files.read_predictions(spark, path), [*KEY, "expert"], ["score"])


ORACLE["collected_prediction_files"] = f"""WITH {bars_sql('1d')}, p AS (
SELECT symbol, period, timestamp, 'trend' AS expert, close AS score FROM bars UNION ALL SELECT symbol, period, timestamp, 'range', high FROM bars)
SELECT symbol, period, timestamp, expert, {settle_sql('score')} FROM p"""


@query
def collected_evidence_files(spark, sf):
    """Importance files whose period and target are in their path."""
    path, b = staging_path(spark, "evidence"), bars(spark, sf, "4h", "1d")
    for period in ("4h", "1d"):
        for target in ("target_up", "target_wide"):
            value = F.avg("close") if target == "target_up" else F.max(F.col("high") - F.col("low"))
            own = b.where(F.col("period") == period).groupBy(F.col("symbol").alias("feature")).agg(value.alias("tree_importance"))
            _one_file(own.withColumns({"period": F.lit("stale"), "target": F.lit("stale")}), f"{path}/{period}/{target}_importances.csv", "csv")
    return settled(files.read_evidence(spark, path), ["feature", "period", "target"])


ORACLE["collected_evidence_files"] = f"""WITH {bars_sql('4h', '1d')}, e AS (
SELECT symbol AS feature, period, 'target_up' AS target, avg(close) AS tree_importance FROM bars GROUP BY 1, 2
UNION ALL SELECT symbol, period, 'target_wide', max(high - low) FROM bars GROUP BY 1, 2)
SELECT feature, period, target, {settle_sql('tree_importance')} FROM e"""


@query
def normalised_column_names(spark, sf):
    """Untidy names made alike, another period's normalised columns dropped, and wanted ones found under this period's window."""
    raw = bars(spark, sf, "1d").withColumns({"Open - Px ": F.col("open"), "Vol/30 (ZN)": F.col("volume"), "close_zn30": F.col("close"), "close_zn56": F.col("close") * 2, "high_mm96": F.col("high")})
    tidy = raw.drop("open", "high", "low", "volume").toDF(*[columns.normalise_name(c) for c in raw.columns if c not in ("open", "high", "low", "volume")])
    tidy = tidy.drop(*columns.foreign_window_columns(tidy.columns, "1d"))
    found = columns.match_normalised(["close_zn96", "high_mm96", "open_px", "vol_30_zn"], tidy.columns, "1d")
    return settled(tidy.select(*KEY, *[F.col(c).alias(f"{name}_from_{c}") for name, c in found.items()]), KEY)


ORACLE["normalised_column_names"] = f"""WITH {bars_sql('1d')}, n AS (SELECT symbol, period, timestamp, close AS close_zn96_from_close_zn30, open AS open_px_from_open_px, volume AS vol_30_zn_from_vol_30_zn FROM bars)
SELECT symbol, period, timestamp, {settle_all('close_zn96_from_close_zn30', 'open_px_from_open_px', 'vol_30_zn_from_vol_30_zn')} FROM n"""
