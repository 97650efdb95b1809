"""Indicator queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from barloom.catalog.tables import bars, bars_sql, settle_sql, settled
from barloom.operators import indicators as ind

KEY = ["symbol", "period", "timestamp"]


def families(wanted: list[str], cols: list[str], periods: tuple[str, ...], by_period: bool = False):
    def run(spark, sf):
        if not by_period:
            return settled(ind.compute(bars(spark, sf, *periods), wanted), KEY, cols)
        parts = [settled(ind.compute(bars(spark, sf, p), wanted, p), KEY, cols) for p in periods]
        return reduce(DataFrame.unionByName, parts)

    return run


# --- SQL side ------------------------------------------------------------------------------------

W = "PARTITION BY symbol, period ORDER BY timestamp"


def over(n: int, lag: int = 0) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {str(lag) + ' PRECEDING' if lag else 'CURRENT ROW'})"


def full(agg: str, x: str, n: int, mp: int | None = None, lag: int = 0) -> str:
    mp = n if mp is None else mp
    return f"(CASE WHEN count({x}) {over(n, lag)} >= {mp} THEN {agg} {over(n, lag)} END)"


BASE = f"""
b0 AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(open) OVER ({W}) AS po, lag(high) OVER ({W}) AS ph,
              lag(low) OVER ({W}) AS pl, lag(volume) OVER ({W}) AS pv, row_number() OVER ({W}) AS pos FROM bars),
b AS MATERIALIZED (SELECT *, close - pc AS d, (high + low + close) / 3 AS tp,
             greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
             ln(close) - ln(pc) AS r, CASE WHEN pv <> 0 THEN (volume - pv) / pv END AS dv FROM b0)"""


def sql(periods: tuple[str, ...], ctes: str, cols: list[str], src: str, ints: tuple[str, ...] = ()) -> str:
    sel = ", ".join(c if c in ints else settle_sql(c) for c in cols)
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH RECURSIVE {bars_sql(*periods)},{BASE}{extra}\nSELECT symbol, period, timestamp, {sel} FROM {src}"


ALL = ("1h", "4h", "1d")
DAILY = ("1d",)
QUERIES: dict = {}
ORACLE: dict = {}


def register(name, wanted, cols, ctes, src, periods=DAILY, ints=(), by_period=False):
    QUERIES[name] = families(wanted, cols, periods, by_period)
    if ctes is not None:
        ORACLE[name] = sql(periods, ctes, cols, src, ints)


register(
    "moving_averages",
    ["moving_averages"],
    ["ma5", "ma20", "ma200", "vol_ma", "ma_diff_5_20", "price_position_ma200", "price_above_ma20"],
    f"""x AS (SELECT *, coalesce({full('avg(close)', 'close', 5)}, 0) AS ma5,
        coalesce({full('avg(close)', 'close', 20)}, 0) AS ma20, coalesce({full('avg(close)', 'close', 200)}, 0) AS ma200,
        coalesce({full('avg(volume)', 'volume', 5)}, 0) AS vol_ma FROM b),
    y AS (SELECT *, ma5 - ma20 AS ma_diff_5_20, CASE WHEN ma200 <> 0 THEN close / ma200 - 1 END AS price_position_ma200,
        CAST(close > ma20 AS INT) AS price_above_ma20 FROM x)""",
    "y",
    ints=("price_above_ma20",),
)

RSI = f"""g AS (SELECT *, coalesce(greatest(d, 0), 0) AS gain, coalesce(greatest(-d, 0), 0) AS loss FROM b),
    a AS (SELECT *, avg(gain) {over(14)} AS up, avg(loss) {over(14)} AS down FROM g),
    rs AS (SELECT *, 100 - 100 / (1 + up / CASE WHEN down = 0 THEN 1e-10 ELSE down END) AS rsi FROM a)"""
register(
    "relative_strength",
    ["relative_strength"],
    ["rsi", "stoch_rsi", "rsi_overbought", "rsi_oversold"],
    RSI
    + f""", z AS (SELECT *, (rsi - min(rsi) {over(14)}) / (max(rsi) {over(14)} - min(rsi) {over(14)} + 1e-10) AS stoch_rsi,
        CAST(rsi > 70 AS INT) AS rsi_overbought, CAST(rsi < 30 AS INT) AS rsi_oversold FROM rs)""",
    "z",
    ints=("rsi_overbought", "rsi_oversold"),
)
register(
    "momentum_volume_change",
    ["momentum"],
    ["momentum", "vol_change"],
    f"""x AS (SELECT *, coalesce(close - lag(close, 5) OVER ({W}), 0) AS momentum,
        coalesce(CASE WHEN dv IS NOT NULL THEN least(greatest(dv, -5), 5) END, 0) AS vol_change FROM b)""",
    "x",
)
BOLL = f"""bo0 AS (SELECT *, coalesce({full('avg(close)', 'close', 20)}, 0) AS mid,
        {full('stddev_samp(close)', 'close', 20)} AS dev FROM b),
    bo1 AS (SELECT *, coalesce(mid + 2 * dev, 0) AS boll_upper, coalesce(mid - 2 * dev, 0) AS boll_lower FROM bo0),
    bo AS (SELECT *, (close - boll_lower) / (abs(boll_upper - boll_lower) + 1e-9) AS boll_pctb,
        (boll_upper - boll_lower) / (abs(mid) + 1e-9) AS boll_bandwidth FROM bo1)"""
register("bollinger", ["bollinger"], ["boll_upper", "boll_lower", "boll_pctb", "boll_bandwidth"], BOLL, "bo")
ATR = f"""t0 AS (SELECT *, avg(tr) {over(14)} AS atr FROM b),
    t AS (SELECT *, lag(atr) OVER ({W}) AS patr FROM t0)"""
register(
    "true_range",
    ["true_range"],
    ["atr", "atr_ratio_price", "atr_ratio_range", "atr_change", "range_to_atr", "atr_slope", "amplitude_range", "z_score_gap"],
    ATR
    + """, x AS (SELECT *, atr / (abs(close) + 1e-9) AS atr_ratio_price, atr / (abs(high - low) + 1e-9) AS atr_ratio_range,
        coalesce(CASE WHEN patr <> 0 THEN least(greatest((atr - patr) / patr, -2), 2) END, 0) AS atr_change,
        (high - low) / (atr + 1e-9) AS range_to_atr, atr - patr AS atr_slope, high - low AS amplitude_range,
        (open - pc) / (atr + 1e-9) AS z_score_gap FROM t)""",
    "x",
)
register(
    "commodity_channel",
    ["commodity_channel"],
    ["cci"],
    f"""x AS (SELECT *, list(tp) {over(20)} AS tps, avg(tp) {over(20)} AS m FROM b),
    y AS (SELECT *, coalesce((tp - m) / (0.015 * list_avg(list_transform(tps, lambda v: abs(v - m))) + 1e-10), 0) AS cci FROM x)""",
    "y",
)
register(
    "channels",
    ["channels"],
    ["donchian_high_20", "donchian_low_20", "williams_r"],
    f"""x AS (SELECT *, max(high) {over(20)} AS donchian_high_20, min(low) {over(20)} AS donchian_low_20,
        -100.0 * (max(high) {over(14)} - close) / (max(high) {over(14)} - min(low) {over(14)} + 1e-10) AS williams_r FROM b)""",
    "x",
)
register(
    "ichimoku",
    ["ichimoku"],
    ["ichimoku_conv", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b", "cloud_thickness"],
    f"""x AS (SELECT *, (max(high) {over(9)} + min(low) {over(9)}) / 2 AS ichimoku_conv,
        (max(high) {over(26)} + min(low) {over(26)}) / 2 AS ichimoku_base,
        (max(high) {over(52)} + min(low) {over(52)}) / 2 AS m52 FROM b),
    y AS (SELECT *, coalesce(lag((ichimoku_conv + ichimoku_base) / 2, 26) OVER ({W}), 0) AS ichimoku_span_a,
        coalesce(lag(m52, 26) OVER ({W}), 0) AS ichimoku_span_b FROM x),
    z AS (SELECT *, ichimoku_span_b - ichimoku_span_a AS cloud_thickness FROM y)""",
    "z",
)
register(
    "supertrend",
    ["supertrend"],
    ["supertrend_10_3"],
    f"""x AS (SELECT *, (high + low) / 2 + 3 * avg(tr) {over(10)} AS up, (high + low) / 2 - 3 * avg(tr) {over(10)} AS lo FROM b),
    y AS (SELECT *, CASE WHEN close > lag(up) OVER ({W}) THEN 1 WHEN close < lag(lo) OVER ({W}) THEN 0 END AS cross_ FROM x),
    z AS (SELECT *, CASE WHEN pc IS NULL THEN 0 WHEN coalesce(last_value(cross_ IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 1) = 1
        THEN lo ELSE up END AS supertrend_10_3 FROM y)""",
    "z",
)
register(
    "heikin_ashi",
    ["heikin_ashi"],
    ["heikin_ashi_trend"],
    "x AS (SELECT *, (open + high + low + close) / 4 - coalesce((po + pc) / 2, open) AS heikin_ashi_trend FROM b)",
    "x",
)
register(
    "money_flow",
    ["money_flow"],
    ["mfi", "cmf", "vwap_14"],
    f"""x AS (SELECT *, tp * volume AS mf, lag(tp) OVER ({W}) AS ptp,
        CASE WHEN high = low THEN NULL ELSE ((close - low) - (high - close)) / (high - low + 1e-10) * volume END AS mfv FROM b),
    y AS (SELECT *, sum(CASE WHEN tp > ptp THEN mf ELSE 0 END) {over(14)} AS p, sum(CASE WHEN tp < ptp THEN mf ELSE 0 END) {over(14)} AS n,
        sum(mfv) {over(20)} AS f, sum(volume) {over(20)} AS v, sum(mf) {over(14)} / sum(volume) {over(14)} AS vwap_14 FROM x),
    z AS (SELECT *, 100 - 100 / (1 + p / (n + 1e-10)) AS mfi, coalesce(f / (v + 1e-10), 0) AS cmf FROM y)""",
    "z",
)
register(
    "price_volume_corr",
    ["price_volume_corr"],
    ["price_volume_corr_20"],
    f"""p AS (SELECT *, CASE WHEN r IS NOT NULL AND dv IS NOT NULL THEN r END AS cr,
        CASE WHEN r IS NOT NULL AND dv IS NOT NULL THEN dv END AS cv FROM b),
    x AS (SELECT *, {full('corr(cr, cv)', 'cr', 20, 2)} AS c0 FROM p),
    y AS (SELECT *, coalesce(CASE WHEN isfinite(c0) THEN c0 END, 0) AS price_volume_corr_20 FROM x)""",
    "y",
)
register(
    "pivots",
    ["pivots"],
    ["pivot_point", "distance_to_pivot"],
    "x AS (SELECT *, tp AS pivot_point, (close - tp) / (abs(close) + 1e-9) AS distance_to_pivot FROM b)",
    "x",
)
register(
    "trend_lines",
    ["trend_lines"],
    ["trendline_slope_20"],
    f"x AS (SELECT *, coalesce({full('regr_slope(close, pos)', 'close', 20)}, 0) AS trendline_slope_20 FROM b)",
    "x",
)
VOL = f"""v0 AS (SELECT *, coalesce(volume / {full('avg(volume)', 'volume', 20)}, 0) AS volume_relative_20, list(volume) {over(120)} AS vs FROM b),
    v AS (SELECT *, CASE WHEN len(vs) = 120 THEN len(list_filter(vs, lambda e: e < volume)) / 120.0 ELSE 0 END AS volume_percentile FROM v0)"""
register("volume_levels", ["volume_levels"], ["volume_relative_20", "volume_percentile"], VOL, "v")
register(
    "support_resistance",
    ["support_resistance"],
    ["support_level_20", "resistance_level_20", "distance_to_support", "distance_to_resistance", "breakout_recent_high",
     "pullback_from_high", "volume_spike_near_support", "volume_spike_near_resist"],
    VOL
    + f""", s0 AS (SELECT *, coalesce({full('min(low)', 'low', 20)}, 0) AS support_level_20,
        {full('max(high)', 'high', 20)} AS hi20 FROM v),
    s1 AS (SELECT *, coalesce(hi20, 0) AS resistance_level_20, lag(hi20) OVER ({W}) AS phi FROM s0),
    s2 AS (SELECT *, (close - support_level_20) / greatest(close, 1e-9) AS distance_to_support,
        (resistance_level_20 - close) / greatest(close, 1e-9) AS distance_to_resistance,
        CAST(coalesce(close > phi, false) AS INT) AS breakout_recent_high,
        coalesce((hi20 - close) / greatest(hi20, 1e-9), 0) AS pullback_from_high FROM s1),
    s3 AS (SELECT *, CAST(volume_relative_20 > 1.5 AND distance_to_support < 0.02 AS INT) AS volume_spike_near_support,
        CAST(volume_relative_20 > 1.5 AND distance_to_resistance < 0.02 AS INT) AS volume_spike_near_resist FROM s2)""",
    "s3",
    ints=("breakout_recent_high", "volume_spike_near_support", "volume_spike_near_resist"),
)
register(
    "on_balance_volume",
    ["on_balance"],
    ["obv", "obv_diff1", "obv_pct", "obv_slope_14", "vwap"],
    f"""x AS (SELECT *, coalesce(sign(d), 0) * volume AS sv FROM b),
    y AS (SELECT *, sum(sv) OVER ({W} ROWS UNBOUNDED PRECEDING) AS obv,
        sum(tp * volume) OVER ({W} ROWS UNBOUNDED PRECEDING) / sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS vwap FROM x),
    z0 AS (SELECT *, lag(obv) OVER ({W}) AS pobv FROM y),
    z AS (SELECT * EXCLUDE (obv), obv, coalesce(obv - pobv, 0) AS obv_diff1,
        coalesce(CASE WHEN pobv <> 0 THEN least(greatest((obv - pobv) / pobv, -5), 5) END, 0) AS obv_pct,
        coalesce({full('regr_slope(obv, pos)', 'obv', 14)}, 0) AS obv_slope_14 FROM z0)""",
    "z",
)
register(
    "tail_risk",
    ["tail_risk"],
    ["ret_skew_30d", "ret_kurt_30d", "var_95_30d", "cvar_95_30d"],
    f"""x AS (SELECT *, {full('skewness(r)', 'r', 30, 10)} AS ret_skew_30d, {full('kurtosis(r)', 'r', 30, 10)} AS ret_kurt_30d,
        {full('quantile_cont(r, 0.05)', 'r', 30, 10)} AS var_95_30d,
        list_filter(list(r) {over(30)}, lambda e: e IS NOT NULL) AS rs FROM b),
    y AS (SELECT *, CASE WHEN var_95_30d IS NOT NULL THEN list_avg(list_filter(rs, lambda e: e <= var_95_30d + abs(var_95_30d) * 1e-12)) END AS cvar_95_30d FROM x)""",
    "y",
)
register(
    "candles",
    ["candles"],
    ["doji_ratio_20", "hammer_cnt_20", "engulfing_up_cnt_20"],
    f"""x AS (SELECT *, CAST(coalesce(CASE WHEN high <> low THEN abs(close - open) / (high - low) < 0.1 END, false) AS INT) AS doji,
        CAST(coalesce(open > close AND CASE WHEN high <> low THEN (open - low) / (high - low) > 0.6 END, false) AS INT) AS ham,
        CAST(coalesce(close > open AND pc < po AND close >= po AND open <= pc, false) AS INT) AS eng FROM b),
    y AS (SELECT *, {full('avg(doji)', 'doji', 20, 5)} AS doji_ratio_20, CAST({full('sum(ham)', 'ham', 20, 5)} AS DOUBLE) AS hammer_cnt_20,
        CAST({full('sum(eng)', 'eng', 20, 5)} AS DOUBLE) AS engulfing_up_cnt_20 FROM x)""",
    "y",
)
register(
    "calendar_cycle",
    ["calendar"],
    ["hour_sin", "hour_cos", "dow_sin", "dow_cos"],
    """x AS (SELECT *, sin(2 * pi() * hour(make_timestamp(timestamp * 1000)) / 24) AS hour_sin,
        cos(2 * pi() * hour(make_timestamp(timestamp * 1000)) / 24) AS hour_cos,
        sin(2 * pi() * (isodow(make_timestamp(timestamp * 1000)) - 1) / 7) AS dow_sin,
        cos(2 * pi() * (isodow(make_timestamp(timestamp * 1000)) - 1) / 7) AS dow_cos FROM b)""",
    "x",
)
