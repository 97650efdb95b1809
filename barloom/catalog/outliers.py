"""Outlier scores and neighbour information of single columns, beside SQL that lists every neighbour."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.tables import bars, bars_sql, settle_sql, settled
from barloom.operators import information
from barloom.operators.outliers import local_outliers

# On a grid of 1/64 differences are exact, so equal distances are equal in both engines.
_COLUMNS = ("price", "volume")


def _grid(spark, sf):
    df = bars(spark, sf, "4h", "1d")
    return df.select("symbol", "period", "timestamp", (F.floor(F.col("close") * 64) / 64).alias("price"), F.col("volume").cast("double").alias("volume"))


def local_outlier_factors(spark, sf):
    """Scores and flags of price and volume of each series; neighbours are a tenth of the series, at least the period's."""
    return settled(local_outliers(_grid(spark, sf), _COLUMNS).drop(*_COLUMNS), ["symbol", "period", "timestamp"])


QUERIES = {"local_outlier_factors": local_outlier_factors}
ORACLE = {
    "local_outlier_factors": f"""
WITH {bars_sql("4h", "1d")},
grid AS (SELECT symbol, period, timestamp, floor(close * 64) / 64 AS price, CAST(volume AS DOUBLE) AS volume FROM bars),
rows_ AS (UNPIVOT grid ON price, volume INTO NAME feature VALUE v),
ranked AS (
  SELECT *, row_number() OVER g AS r, count(*) OVER (PARTITION BY symbol, period, feature) AS n FROM rows_ WINDOW g AS (PARTITION BY symbol, period, feature ORDER BY v, timestamp)
), points AS (
  SELECT *, least(n - 1, greatest(least_k, CAST(floor(n * 0.1) AS BIGINT))) AS k
  FROM (SELECT *, CASE period WHEN '1h' THEN 24 WHEN '4h' THEN 12 WHEN '1d' THEN 6 ELSE 24 END AS least_k FROM ranked) WHERE n > least_k
), near AS (
  SELECT a.symbol, a.period, a.feature, a.r, b.r AS other, abs(a.v - b.v) AS d
  FROM points a JOIN points b ON a.symbol = b.symbol AND a.period = b.period AND a.feature = b.feature AND b.r BETWEEN a.r - a.k AND a.r + a.k AND b.r <> a.r
  QUALIFY row_number() OVER (PARTITION BY a.symbol, a.period, a.feature, a.r ORDER BY abs(a.v - b.v), b.v, b.r) <= a.k
), reach AS (SELECT symbol, period, feature, r, max(d) AS far FROM near GROUP BY ALL),
density AS (
  SELECT n.symbol, n.period, n.feature, n.r, 1 / (avg(greatest(n.d, o.far)) + 1e-10) AS lrd
  FROM near n JOIN reach o ON o.symbol = n.symbol AND o.period = n.period AND o.feature = n.feature AND o.r = n.other GROUP BY ALL
), scored AS (
  SELECT n.symbol, n.period, n.feature, n.r, -avg(o.lrd) / any_value(a.lrd) AS lof
  FROM near n JOIN density o ON o.symbol = n.symbol AND o.period = n.period AND o.feature = n.feature AND o.r = n.other
  JOIN density a ON a.symbol = n.symbol AND a.period = n.period AND a.feature = n.feature AND a.r = n.r GROUP BY ALL
), flagged AS (
  SELECT p.symbol, p.period, p.timestamp, p.feature, lof, -- rounded, because sums in another order give the scores of equal values unequal last digits
    CAST(round(lof, 9) < quantile_cont(round(lof, 9), 0.01) OVER (PARTITION BY p.symbol, p.period, p.feature) AS INTEGER) AS flag
  FROM points p JOIN scored s ON s.symbol = p.symbol AND s.period = p.period AND s.feature = p.feature AND s.r = p.r
), wide AS (
  SELECT g.symbol, g.period, g.timestamp, max(lof) FILTER (WHERE feature = 'price') AS lof_score_price, max(flag) FILTER (WHERE feature = 'price') AS is_outlier_price,
    max(lof) FILTER (WHERE feature = 'volume') AS lof_score_volume, max(flag) FILTER (WHERE feature = 'volume') AS is_outlier_volume
  FROM grid g LEFT JOIN flagged f ON f.symbol = g.symbol AND f.period = g.period AND f.timestamp = g.timestamp GROUP BY ALL
)
SELECT symbol, period, timestamp, {settle_sql("lof_score_price")}, is_outlier_price, {settle_sql("lof_score_volume")}, is_outlier_volume FROM wide"""
}


def neighbour_information(spark, sf):
    """Information of price and volume about the direction of the next close, by three nearest neighbours."""
    df = bars(spark, sf, "4h").select("symbol", "period", "timestamp", (F.floor(F.col("close") * 64) / 64).alias("price"), F.col("volume").cast("double").alias("volume"), (F.col("close") > F.col("open")).cast("int").alias("up"))
    return settled(information.neighbour_information(df, _COLUMNS, "up"), ["feature", "rows"])


def _psi(x: str) -> str:
    y = f"({x} + 6.0)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * pow({y}, 4.0)) - 1 / (252 * pow({y}, 6.0))" + "".join(f" - 1 / ({x} + {i}.0)" for i in range(6)) + ")"


QUERIES["neighbour_information"] = neighbour_information
ORACLE["neighbour_information"] = f"""
WITH {bars_sql("4h")},
grid AS (SELECT floor(close * 64) / 64 AS price, CAST(volume AS DOUBLE) AS volume, CAST(close > open AS INTEGER) AS up FROM bars),
rows_ AS (UNPIVOT grid ON price, volume INTO NAME feature VALUE v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature, up ORDER BY v) AS r, count(*) OVER (PARTITION BY feature, up) AS total FROM rows_),
points AS (SELECT *, least(3, total - 1) AS k FROM ranked WHERE total > 1),
reach AS (
  SELECT feature, up, r, any_value(v) AS v, any_value(total) AS total, any_value(k) AS k, max(d) AS d FROM (
    SELECT a.feature, a.up, a.r, a.v, a.total, a.k, abs(a.v - b.v) AS d FROM points a JOIN points b ON a.feature = b.feature AND a.up = b.up AND b.r BETWEEN a.r - a.k AND a.r + a.k AND b.r <> a.r
    QUALIFY row_number() OVER (PARTITION BY a.feature, a.up, a.r ORDER BY abs(a.v - b.v)) <= a.k
  ) GROUP BY ALL
), inside AS (
  SELECT p.feature, p.up, p.r, any_value(p.total)::DOUBLE AS total, any_value(p.k)::DOUBLE AS k, count(*)::DOUBLE AS m
  FROM reach p JOIN points q ON q.feature = p.feature AND (abs(q.v - p.v) < p.d OR (p.d = 0 AND q.v = p.v)) GROUP BY ALL
), sums AS (SELECT feature, count(*) AS rows, avg({_psi("k")} - {_psi("total")} - {_psi("m")}) AS part FROM inside GROUP BY ALL)
SELECT feature, rows, {settle_sql("greatest(0, " + _psi("CAST(rows AS DOUBLE)") + " + part)", "information")} FROM sums"""
