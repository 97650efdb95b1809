"""Bars to the labelled long feature table.

Stages are written to the shared folder where the next one reads its input more than once; within a
stage all windows share one layout, one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from barloom.columns import foreign_window_columns, norm_suffixes
from barloom.operators import indicators, kernels, labels, market, norms, splits
from barloom.operators.chunks import time_bucket
from barloom.schema import KEYS, PERIODS, TIME
from barloom.sources.staging import staged

# The columns that get a rolling z-score and min-max form.
NORMALISED = (
    "open", "high", "low", "close", "ma5", "ma20", "boll_upper", "boll_lower", "support_level_20", "resistance_level_20",
    "distance_to_support", "distance_to_resistance", "volume", "vol_ma", "volume_relative_20", "obv", "atr",
    "amplitude_range", "atr_slope", "trendline_slope_20", "ma_diff_5_20", "cci", "adx_scaled", "vwap", "obv_diff1",
    "obv_pct", "obv_slope_14", "trend_flag", "range_flag", "high_vol_flag", "stress_flag", "donchian_high_20",
    "donchian_low_20", "keltner_upper_20", "keltner_lower_20", "squeeze_on", "ppo", "stoch_rsi", "williams_r", "tsi",
    "ichimoku_conv", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b", "cloud_thickness", "psar", "psar_flip_flag",
    "supertrend_10_3", "heikin_ashi_trend", "ret_skew_30d", "ret_kurt_30d", "var_95_30d", "cvar_95_30d", "z_score_gap",
    "engulfing_up_cnt_20", "doji_ratio_20", "hammer_cnt_20", "mfi", "cmf", "price_volume_corr_20",
    "price_position_ma200", "beta_btc_60d", "pivot_point", "distance_to_pivot", "volume_profile_hvn",
    "volume_profile_lvn", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
)
FAMILIES = tuple(indicators.FAMILIES)


def indicator_table(bars: DataFrame, period: str, benchmark: str | None = None, families: Sequence[str] = FAMILIES) -> DataFrame:
    """All indicators of one period's bars. The heavy ones (profile, stop, beta) join on the key."""
    key = [*KEYS, TIME]
    out = staged(indicators.compute(bars, families, period), "indicators")
    stop = kernels.parabolic_stop(bars.select(*key, "high", "low")).select(*key, "psar", "psar_flip_flag")
    profile = market.volume_profile(bars.select(*key, "close", "volume"), period).select(
        *key, "volume_profile_hvn", "volume_profile_lvn"
    )
    out = out.join(stop, key).join(profile, key)
    if benchmark:
        r = market.benchmark_returns(bars, benchmark)
        beta = market.benchmark_beta(bars.select(*key, "close"), r, period).select(*key, "r_sym", "r_btc", "beta_btc_60d")
        out = out.join(beta, key)
    return out


def feature_table(bars: DataFrame, period: str, benchmark: str | None = None) -> DataFrame:
    """Indicators, lagged where they would leak, with slopes and rolling norms, warm-up cut off."""
    out = staged(indicator_table(bars, period, benchmark), "unlagged")
    out = staged(norms.guarded_slopes(out, period), "sloped")
    window = PERIODS[period].norm_window
    cols = [c for c in NORMALISED if c in out.columns]
    out = staged(norms.rolling_norms(out, cols, window, wide=True), "normed")
    normed = [c + s for c in cols for s in norm_suffixes(period)]
    return norms.trim_warm_up(out, window, normed, time_bucket(out))


def _labelled(features: DataFrame, period: str) -> DataFrame:
    """Labels from the few columns they read, joined to the wide rows on the bar's key."""
    key = [*KEYS, TIME]
    narrow = features.select(*key, "open", "high", "low", "close", "volume", "atr")
    named = labels.with_labels(narrow, period)
    added = [c for c in named.columns if c not in features.columns]
    return features.join(named.select(*key, *added), key)


def long_table(bars: DataFrame, benchmark: str | None = None, periods: Sequence[str] = ("1h", "4h", "1d")) -> DataFrame:
    """One labelled table over periods: features, labels of complete rows, and the bar number."""
    parts = []
    for p in periods:
        features = staged(feature_table(bars.filter(F.col("period") == p), p, benchmark), "features")
        out = labels.drop_unlabelled(staged(_labelled(features, p), "labelled"))
        parts.append(out.drop(*foreign_window_columns(out.columns, p)))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return splits.with_time_idx(staged(table, "long"))
