"""Which features each expert asks for, per channel, and which columns may stand in for them."""

from __future__ import annotations

from collections.abc import Sequence

from barloom.columns import resolve_features
from barloom.operators.joins import RICH_COLUMNS

# The experts' default features and the synonyms of feature names.
_PRICES = ("open", "high", "low", "close", "volume", "vwap")
_DIRECTION = _PRICES + (
    "rsi", "macd_hist", "adx", "adx_scaled", "boll_bandwidth", "ma5", "ma20", "obv", "atr", "cci", "momentum", "ppo",
    "stoch_rsi", "williams_r", "tsi", "donchian_high_20", "donchian_low_20", "keltner_upper_20", "keltner_lower_20",
    "squeeze_on", "trendline_slope_20", "ma_diff_5_20", "boll_pctb", "amplitude_range",
)
BASE_FEATURES: dict[str, tuple[str, ...]] = {
    "Alpha-Dir-TFT": _DIRECTION,
    "Alpha-Ret-TFT": _DIRECTION
    + ("rolling_volatility", "parkinson_volatility", "ewmavolatility", "return_skewness", "atr_ratio_price", "atr_slope"),
    "Risk-TFT": _PRICES
    + ("var_95_30d", "cvar_95_30d", "ret_skew_30d", "ret_kurt_30d", "atr", "atr_change", "atr_ratio_range"),
    "Regime-Gate": _PRICES
    + (
        "trend_flag", "range_flag", "high_vol_flag", "stress_flag", "volume_profile_hvn", "volume_profile_lvn",
        "volume_relative_20", "volume_percentile",
    ),
    "KeyLevel-Breakout-TFT": _PRICES
    + (
        "support_level_20", "resistance_level_20", "breakout_recent_high", "pullback_from_high", "distance_to_support",
        "distance_to_resistance", "volume_spike_near_support", "volume_spike_near_resist", "tail_bias_norm", "amplitude_range",
    ),
    "RelativeStrength-Spread-TFT": _PRICES + ("r_sym", "r_btc", "beta_btc_60d", "price_position_ma200"),
    "MicroStruct-Deriv-TFT": RICH_COLUMNS,
    "OnChain-ETF-TFT": RICH_COLUMNS,
    "Factor-Bridge-TFT": RICH_COLUMNS,
    "Z-Combiner": _PRICES,
}
SYNONYMS: dict[str, tuple[str, ...]] = {
    "rsi": ("rsi_14",),
    "macd_hist": ("macd",),
    "adx": ("adx_scaled",),
    "return_skewness": ("ret_skew_30d",),
    "atr_ratio_range": ("range_to_atr",),
    "funding_rate": ("funding_rate_z",),
    "oi_total": ("oi",),
    "taker_buy_sell_imbalance": ("taker_imbalance_z",),
    "basis_z": ("basis",),
    "etf_flow": ("etf_net_flow",),
    "etf_premium": ("etf_premium_z",),
    "active_addresses": ("active_addr_z",),
}
CHANNELS = ("base", "rich", "comprehensive")


def wanted_features(expert: str, channel: str = "base") -> tuple[str, ...]:
    """Rich and comprehensive channels include the base ones; the combiner has no rich features."""
    base = BASE_FEATURES.get(expert, ())
    if channel == "base" or expert == "Z-Combiner":
        return base
    return tuple(dict.fromkeys((*base, *RICH_COLUMNS)))


def pinned_features(expert: str, channel: str, columns: Sequence[str]) -> list[str]:
    """The expert's features under the names this table has for them."""
    return sorted(resolve_features(wanted_features(expert, channel), SYNONYMS, columns)[0])
