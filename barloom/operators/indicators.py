"""Technical indicators as families of window columns.

A family is a function (df, w) -> df that adds columns, plus the number of earlier rows it reads.
`compute` lays the bars out in chunks once, applies the families on the shared window, and drops
the borrowed rows. Recursive families (exponential averages) add their Arrow steps in between.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from barloom.functions import frames as fr
from barloom.functions.nulls import clip, flag, ratio, safe
from barloom.functions.times import calendar_columns
from barloom.operators.chunks import halo_chunks, restored_keys
from barloom.operators.kernels import Step, ema, ema_halo, renewing_rows, span_alpha, with_recursive
from barloom.operators.scan import bucketed_scan
from barloom.schema import KEYS, PERIODS, TIME

EPS = 1e-10


def open_() -> Column:
    return F.col("open")


def high_() -> Column:
    return F.col("high")


def low_() -> Column:
    return F.col("low")


def close_() -> Column:
    return F.col("close")


def volume_() -> Column:
    return F.col("volume")


def _prev(x: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(x, n).over(w)


def base(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Row-to-row quantities that every other family starts from. Reads one earlier row."""
    df = df.withColumns(
        {
            "_pc": _prev("close", w),
            "_po": _prev("open", w),
            "_ph": _prev("high", w),
            "_pl": _prev("low", w),
            "_pv": _prev("volume", w),
            "_pos": F.row_number().over(w),
        }
    )
    typical = (high_() + low_() + close_()) / 3
    log_close = F.when(close_() > 0, F.ln(close_()))
    log_prev = F.when(F.col("_pc") > 0, F.ln("_pc"))
    return df.withColumns(
        {
            "_d": close_() - F.col("_pc"),
            "_tp": typical,
            # greatest skips NULL, so the first bar's range is high - low
            "_tr": F.greatest(high_() - low_(), F.abs(high_() - F.col("_pc")), F.abs(low_() - F.col("_pc"))),
            "_r": log_close - log_prev,
            "_dv": ratio(volume_() - F.col("_pv"), F.col("_pv")),
        }
    )


# --- moving statistics, oscillators, volume -----------------------------------------------------


def moving_averages(df, w):
    return df.withColumns(
        {
            "ma5": safe(fr.mean(close_(), w, 5)),
            "ma20": safe(fr.mean(close_(), w, 20)),
            "ma200": safe(fr.mean(close_(), w, 200)),
            "vol_ma": safe(fr.mean(volume_(), w, 5)),
        }
    ).withColumns(
        {
            "ma_diff_5_20": F.col("ma5") - F.col("ma20"),
            "price_position_ma200": ratio(close_(), F.col("ma200")) - 1,
            "price_above_ma20": flag(close_() > F.col("ma20")),
        }
    )


def relative_strength(df, w):
    d = F.col("_d")
    df = df.withColumns({"_gain": F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0)),
                         "_loss": F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0))})
    up, down = fr.mean(F.col("_gain"), w, 14, 1), fr.mean(F.col("_loss"), w, 14, 1)
    df = df.withColumns({"_up": up, "_down": down})
    rs = F.col("_up") / F.when(F.col("_down") == 0, F.lit(EPS)).otherwise(F.col("_down"))
    df = df.withColumn("rsi", safe(100 - 100 / (1 + rs)))
    df = df.withColumns({"_rlo": fr.low(F.col("rsi"), w, 14, 1), "_rhi": fr.high(F.col("rsi"), w, 14, 1)})
    span = F.col("_rhi") - F.col("_rlo") + EPS
    return df.withColumns(
        {
            "stoch_rsi": safe((F.col("rsi") - F.col("_rlo")) / span),
            "rsi_overbought": flag(F.col("rsi") > 70),
            "rsi_oversold": flag(F.col("rsi") < 30),
        }
    )


def momentum(df, w):
    return df.withColumns({"momentum": safe(close_() - _prev("close", w, 5)), "vol_change": safe(clip(F.col("_dv"), -5, 5))})


def bollinger(df, w):
    df = df.withColumns({"_m20": fr.mean(close_(), w, 20), "_s20": fr.std(close_(), w, 20)})
    mid, dev = safe(F.col("_m20")), F.col("_s20")
    df = df.withColumns({"boll_upper": safe(mid + 2 * dev), "boll_lower": safe(mid - 2 * dev)})
    width = F.col("boll_upper") - F.col("boll_lower")
    return df.withColumns(
        {
            "boll_pctb": safe((close_() - F.col("boll_lower")) / (F.abs(width) + 1e-9)),
            "boll_bandwidth": safe(width / (F.abs(mid) + 1e-9)),
        }
    )


def true_range(df, w):
    df = df.withColumn("atr", safe(fr.mean(F.col("_tr"), w, 14, 1)))
    df = df.withColumn("_patr", _prev("atr", w))
    atr, before = F.col("atr"), F.col("_patr")
    return df.withColumns(
        {
            "atr_ratio_price": safe(atr / (F.abs(close_()) + 1e-9)),
            "atr_ratio_range": safe(atr / (F.abs(high_() - low_()) + 1e-9)),
            "atr_change": safe(clip(ratio(atr - before, before), -2, 2)),
            "range_to_atr": safe((high_() - low_()) / (atr + 1e-9)),
            "atr_slope": atr - before,
            "amplitude_range": high_() - low_(),
            "z_score_gap": (open_() - F.col("_pc")) / (atr + 1e-9),
        }
    )


def commodity_channel(df, w):
    """Mean absolute deviation around the window's own mean needs the window's values."""
    df = df.withColumns({"_tps": fr.values(F.col("_tp"), w, 20), "_tpm": fr.mean(F.col("_tp"), w, 20, 1)})
    total = F.aggregate("_tps", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_tpm")))
    mad = ratio(total, F.size("_tps").cast("double"))
    return df.withColumn("cci", safe((F.col("_tp") - F.col("_tpm")) / (0.015 * mad + EPS)))


def channels(df, w):
    df = df.withColumns({"donchian_high_20": safe(fr.high(high_(), w, 20, 1)), "donchian_low_20": safe(fr.low(low_(), w, 20, 1)),
                         "_hh14": fr.high(high_(), w, 14, 1), "_ll14": fr.low(low_(), w, 14, 1)})
    wr = -100.0 * (F.col("_hh14") - close_()) / (F.col("_hh14") - F.col("_ll14") + EPS)
    return df.withColumn("williams_r", safe(wr))


def ichimoku(df, w):
    mid = lambda n: (fr.high(high_(), w, n, 1) + fr.low(low_(), w, n, 1)) / 2.0
    df = df.withColumns({"ichimoku_conv": safe(mid(9)), "ichimoku_base": safe(mid(26)), "_mid52": mid(52)})
    df = df.withColumn("_lead", (F.col("ichimoku_conv") + F.col("ichimoku_base")) / 2.0)
    df = df.withColumns(
        {"ichimoku_span_a": safe(_prev("_lead", w, 26)), "ichimoku_span_b": safe(_prev("_mid52", w, 26))}
    )
    return df.withColumn("cloud_thickness", F.col("ichimoku_span_b") - F.col("ichimoku_span_a"))


def supertrend(df, w):
    """The band switches at crossings and holds otherwise. The last crossing may lie arbitrarily far
    back, so the band is finished by `finish_supertrend`; here the crossing of each row is marked."""
    df = df.withColumn("_atr10", safe(fr.mean(F.col("_tr"), w, 10, 1)))
    mid = (high_() + low_()) / 2.0
    df = df.withColumns({"_band_up": mid + 3.0 * F.col("_atr10"), "_band_lo": mid - 3.0 * F.col("_atr10")})
    df = df.withColumns({"_pup": _prev("_band_up", w), "_plo": _prev("_band_lo", w)})
    return df.withColumn("_cross", F.when(close_() > F.col("_pup"), 1).when(close_() < F.col("_plo"), 0))


def finish_supertrend(df: DataFrame, light: DataFrame) -> DataFrame:
    """Carry the last crossing along the whole group; trends start upward, the first bar has no band."""
    df = bucketed_scan(df, KEYS, [TIME], "_chunk", lasts={"_trend": F.col("_cross")}, carry_from=light)
    rising = F.coalesce(F.col("_trend"), F.lit(1)) == 1
    band = F.when(rising, F.col("_band_lo")).otherwise(F.col("_band_up"))
    return df.withColumn("supertrend_10_3", F.when(F.col("_pc").isNull(), 0.0).otherwise(safe(band)))


def heikin_ashi(df, w):
    before = (F.col("_po") + F.col("_pc")) / 2.0
    return df.withColumn("heikin_ashi_trend", safe((open_() + high_() + low_() + close_()) / 4.0 - F.coalesce(before, open_())))


def money_flow(df, w):
    df = df.withColumns({"_ptp": _prev("_tp", w), "_mf": F.col("_tp") * volume_()})
    spread = F.when(high_() == low_(), F.lit(None)).otherwise(high_() - low_()) + EPS
    df = df.withColumns(
        {
            "_pmf": F.when(F.col("_tp") > F.col("_ptp"), F.col("_mf")).otherwise(0.0),
            "_nmf": F.when(F.col("_tp") < F.col("_ptp"), F.col("_mf")).otherwise(0.0),
            "_mfv": ratio((close_() - low_()) - (high_() - close_()), spread) * volume_(),
        }
    )
    pos, neg = fr.total(F.col("_pmf"), w, 14, 1), fr.total(F.col("_nmf"), w, 14, 1)
    flow, vol = fr.total(F.col("_mfv"), w, 20, 1), fr.total(volume_(), w, 20, 1)
    pv = fr.total(F.col("_mf"), w, 14, 1)
    df = df.withColumns(
        {"_pos_mf": pos, "_neg_mf": neg, "_flow": flow, "_vol20": vol, "_pv14": pv, "_v14": fr.total(volume_(), w, 14, 1)}
    )
    return df.withColumns(
        {
            "mfi": safe(100.0 - 100.0 / (1.0 + F.col("_pos_mf") / (F.col("_neg_mf") + EPS))),
            "cmf": safe(F.col("_flow") / (F.col("_vol20") + EPS)),
            "vwap_14": safe(ratio(F.col("_pv14"), F.col("_v14"))),
        }
    )


def price_volume_corr(df, w):
    """Correlation over the bars where both changes are known, at least two of them."""
    both = F.col("_r").isNotNull() & F.col("_dv").isNotNull()
    df = df.withColumns({"_cr": F.when(both, F.col("_r")), "_cv": F.when(both, F.col("_dv"))})
    frame = fr.back(w, 20)
    df = df.withColumns({"_ncorr": F.count("_cr").over(frame), "_corr": F.corr("_cr", "_cv").over(frame)})
    return df.withColumn("price_volume_corr_20", safe(F.when(F.col("_ncorr") >= 2, F.col("_corr"))))


def pivots(df, w):
    return df.withColumn("pivot_point", safe(F.col("_tp"))).withColumn(
        "distance_to_pivot", (close_() - F.col("pivot_point")) / (F.abs(close_()) + 1e-9)
    )


def trend_lines(df, w):
    return df.withColumn("trendline_slope_20", safe(fr.slope(close_(), F.col("_pos"), w, 20)))


def volume_levels(df, w):
    df = df.withColumns({"_vm20": fr.mean(volume_(), w, 20), "_vs120": fr.values(volume_(), w, 120)})
    share = fr.share_below(F.col("_vs120"), volume_(), F.lit(120.0))
    return df.withColumns(
        {
            "volume_relative_20": safe(ratio(volume_(), F.col("_vm20"))),
            "volume_percentile": safe(F.when(F.size("_vs120") == 120, share)),
        }
    )


def support_resistance(df, w):
    """Reads volume_relative_20."""
    df = df.withColumns({"support_level_20": safe(fr.low(low_(), w, 20)), "resistance_level_20": safe(fr.high(high_(), w, 20)),
                         "_hi20": fr.high(high_(), w, 20)})
    price = F.greatest(close_(), F.lit(1e-9))
    df = df.withColumns(
        {
            "distance_to_support": safe((close_() - F.col("support_level_20")) / price),
            "distance_to_resistance": safe((F.col("resistance_level_20") - close_()) / price),
            "breakout_recent_high": flag(close_() > _prev("_hi20", w)),
            "pullback_from_high": safe((F.col("_hi20") - close_()) / F.greatest(F.col("_hi20"), F.lit(1e-9))),
        }
    )
    busy = F.col("volume_relative_20") > 1.5
    return df.withColumns(
        {
            "volume_spike_near_support": flag(busy & (F.col("distance_to_support") < 0.02)),
            "volume_spike_near_resist": flag(busy & (F.col("distance_to_resistance") < 0.02)),
        }
    )


def on_balance(df, w):
    """Signed volume. Differences and slopes do not depend on where the running total starts, so they
    come from the chunk-local total; the level itself is carried across chunks by `finish_totals`."""
    df = df.withColumn("_sv", F.coalesce(F.signum("_d"), F.lit(0.0)) * volume_())
    df = df.withColumn("_obv", F.sum("_sv").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumns(
        {
            "obv_slope_14": safe(fr.slope(F.col("_obv"), F.col("_pos"), w, 14)),
            "obv_diff1": safe(F.when(F.col("_pc").isNotNull(), F.col("_sv"))),
        }
    )


def finish_totals(df: DataFrame, light: DataFrame) -> DataFrame:
    """obv, obv_pct and the cumulative vwap over whole groups."""
    totals = {"obv": F.col("_sv"), "_cum_pv": F.col("_tp") * volume_(), "_cum_v": volume_()}
    df = bucketed_scan(df, KEYS, [TIME], "_chunk", sums=totals, carry_from=light)
    before = F.col("obv") - F.col("_sv")
    change = ratio(F.col("_sv"), before)
    return df.withColumns(
        {
            "obv": safe(F.col("obv")),
            "obv_pct": safe(F.when(F.col("_pc").isNotNull(), clip(change, -5, 5))),
            "vwap": safe(ratio(F.col("_cum_pv"), F.col("_cum_v"))),
        }
    )


# --- tail risk, candles, regimes ----------------------------------------------------------------


def tail_risk(df, w):
    r = F.col("_r")
    df = df.withColumns(
        {
            "ret_skew_30d": fr.skew_unbiased(r, w, 30, 10),
            "ret_kurt_30d": fr.kurt_unbiased(r, w, 30, 10),
            "var_95_30d": fr.quantile(r, 0.05, w, 30, 10),
            "_rs30": fr.values(r, w, 30),
        }
    )
    # a value one rounding step above the interpolated quantile is still the quantile itself
    edge = F.col("var_95_30d") + F.abs("var_95_30d") * 1e-12
    tail = F.filter("_rs30", lambda x: x <= edge)
    mean = ratio(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x), F.size(tail).cast("double"))
    return df.withColumn("cvar_95_30d", F.when(F.col("var_95_30d").isNotNull(), mean))


def candles(df, w):
    body, span = F.abs(close_() - open_()), F.when(high_() != low_(), high_() - low_())
    po, pc = F.col("_po"), F.col("_pc")
    df = df.withColumns(
        {
            "_doji": flag(ratio(body, span) < 0.1),
            "_hammer": flag((open_() > close_()) & (ratio(open_() - low_(), span) > 0.6)),
            "_engulf": flag((close_() > open_()) & (pc < po) & (close_() >= po) & (open_() <= pc)),
        }
    )
    return df.withColumns(
        {
            "doji_ratio_20": fr.mean(F.col("_doji"), w, 20, 5),
            "hammer_cnt_20": fr.total(F.col("_hammer"), w, 20, 5).cast("double"),
            "engulfing_up_cnt_20": fr.total(F.col("_engulf"), w, 20, 5).cast("double"),
        }
    )


def regime_inputs(df, w, period: str):
    """Volatility statistics under the regime flags."""
    r, day = F.col("_r"), PERIODS[period].day_window
    return df.withColumns(
        {
            "_std20": fr.std(r, w, 20, 10),
            "_sum20": fr.total(r, w, 20, 10),
            "_std_day": fr.std(r, w, day, 1) if day > 1 else F.lit(None).cast("double"),
        }
    )


# Quantiles and ranks over up to 500 bars: an updated order statistic costs log(n) per row, where a
# frame aggregate would sort the frame again for every row.
REGIME_STEPS: list[Step] = [
    ("_bw30", lambda p: p["boll_bandwidth"].rolling(500).quantile(0.3)),
    ("_std70", lambda p: p["_std20"].rolling(100).quantile(0.7)),
]
SQUEEZE_STEPS: list[Step] = [
    ("_kc_rank", lambda p: p["_kcw"].rolling(500, min_periods=100).rank(method="min")),
    ("_kc_rows", lambda p: p["_kcw"].rolling(500, min_periods=100).count()),
]


def regime_flags(df, w):
    """Reads adx, atr_ratio_price and `regime_inputs`."""
    adx, std20 = F.col("adx"), F.col("_std20")
    calm = F.when(F.col("_std_day") != 0, F.col("_std_day"))
    return df.withColumns(
        {
            "trend_flag": flag((adx > 25) & (F.abs("_sum20") > 2.0 * std20)),
            "range_flag": flag(
                (F.col("atr_ratio_price") < 0.008) & (adx < 15) & (F.col("boll_bandwidth") < F.col("_bw30"))
            ),
            "high_vol_flag": flag((std20 > F.col("_std70")) & (adx < 15)),
            "stress_flag": flag(F.col("_r") < -4.0 * calm),
        }
    )


def squeeze_width(df, w):
    """Reads keltner_* and ma20."""
    width = (F.col("keltner_upper_20") - F.col("keltner_lower_20")) / (F.abs("ma20") + 1e-9)
    return df.withColumn("_kcw", width)


def squeeze(df, w):
    """Reads `squeeze_width`, its rank in the window and boll_bandwidth."""
    narrow = ratio(F.col("_kc_rank") - 1, F.col("_kc_rows")) < 0.3
    return df.withColumn("squeeze_on", flag((F.col("boll_bandwidth") < F.col("_kcw")) & narrow))


def calendar(df, w):
    return df.withColumns(calendar_columns(F.timestamp_millis(TIME)))


def macd_cross(df, w):
    before = _prev("macd_hist", w)
    return df.withColumn("macd_bullish_cross", flag((F.col("macd_hist") > 0) & (before <= 0)))


# --- recursive families: inputs in Spark, recursion in Arrow steps ------------------------------


def directional_inputs(df, w):
    up, down = high_() - F.col("_ph"), F.col("_pl") - low_()
    rng = F.greatest(fr.high(high_(), w, 9, 1) - fr.low(low_(), w, 9, 1), F.lit(0.0))
    df = df.withColumns(
        {
            "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
            "_ad": F.abs("_d"),
            "_lo9": fr.low(low_(), w, 9, 1),
            "_rng9": rng,
        }
    )
    return df.withColumn("_rsv", ratio(close_() - F.col("_lo9"), F.col("_rng9")) * 100)


MACD_STEPS: list[Step] = [
    ("_ema12", ema("close", span=12, adjust=False)),
    ("_ema26", ema("close", span=26, adjust=False)),
    ("macd_line", lambda p: p["_ema12"] - p["_ema26"]),
    ("macd_signal", ema("macd_line", span=9, adjust=False)),
    ("macd_hist", lambda p: p["macd_line"] - p["macd_signal"]),
    ("ppo", lambda p: ((p["_ema12"] - p["_ema26"]) / (p["_ema26"].replace(0, float("nan")) + EPS)).fillna(0)),
]
KDJ_STEPS: list[Step] = [
    ("_k", ema("_rsv", com=2)),
    ("_dd", ema("_k", com=2)),
    ("kdj_k", lambda p: p["_k"].fillna(0)),
    ("kdj_d", lambda p: p["_dd"].fillna(0)),
    ("kdj_j", lambda p: (3 * p["_k"] - 2 * p["_dd"]).fillna(0)),
]
ADX_STEPS: list[Step] = [
    ("_rma_tr", ema("_tr", alpha=1 / 14, adjust=False)),
    ("_rma_p", ema("_pdm", alpha=1 / 14, adjust=False)),
    ("_rma_m", ema("_mdm", alpha=1 / 14, adjust=False)),
    ("_pdi", lambda p: 100.0 * p["_rma_p"] / (p["_rma_tr"] + EPS)),
    ("_mdi", lambda p: 100.0 * p["_rma_m"] / (p["_rma_tr"] + EPS)),
    ("_dx", lambda p: 100.0 * (p["_pdi"] - p["_mdi"]).abs() / (p["_pdi"] + p["_mdi"] + EPS)),
    ("_adx", ema("_dx", alpha=1 / 14, adjust=False)),
    ("adx", lambda p: p["_adx"].fillna(0).clip(0, 100)),
    ("plus_di", lambda p: p["_pdi"].fillna(0).clip(0, 100)),
    ("minus_di", lambda p: p["_mdi"].fillna(0).clip(0, 100)),
    ("adx_scaled", lambda p: p["adx"] / 100.0),
]
TSI_STEPS: list[Step] = [
    ("_m1", ema("_d", span=25, adjust=False)),
    ("_m2", ema("_m1", span=13, adjust=False)),
    ("_a1", ema("_ad", span=25, adjust=False)),
    ("_a2", ema("_a1", span=13, adjust=False)),
    ("tsi", lambda p: (p["_m2"] / (p["_a2"] + EPS)).fillna(0)),
]
KELTNER_STEPS: list[Step] = [("_ema20", ema("close", span=20, adjust=False))]


def keltner(df, w):
    """Reads _ema20."""
    df = df.withColumn("_atr20", safe(fr.mean(F.col("_tr"), w, 20, 1)))
    mid = safe(F.col("_ema20"))
    return df.withColumns(
        {
            "keltner_upper_20": safe(mid + 1.5 * F.col("_atr20")),
            "keltner_lower_20": safe(mid - 1.5 * F.col("_atr20")),
        }
    )


def _halo(*spans: float) -> int:
    return sum(ema_halo(span_alpha(s)) for s in spans)


@dataclass(frozen=True)
class Family:
    """What a family adds, how far back it reads, and what has to be there first."""

    add: Callable[[DataFrame, WindowSpec], DataFrame] | None
    back: int
    needs: tuple[str, ...] = ()
    steps: tuple[Step, ...] = ()
    finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None


FAMILIES: dict[str, Family] = {
    "base": Family(base, 1),
    "moving_averages": Family(moving_averages, 200, ("base",)),
    "relative_strength": Family(relative_strength, 28, ("base",)),
    "momentum": Family(momentum, 5, ("base",)),
    "bollinger": Family(bollinger, 20, ("base",)),
    "true_range": Family(true_range, 16, ("base",)),
    "commodity_channel": Family(commodity_channel, 20, ("base",)),
    "channels": Family(channels, 20, ("base",)),
    "ichimoku": Family(ichimoku, 78, ("base",)),
    "supertrend": Family(supertrend, 12, ("base",), finish=finish_supertrend),
    "heikin_ashi": Family(heikin_ashi, 1, ("base",)),
    "money_flow": Family(money_flow, 21, ("base",)),
    "price_volume_corr": Family(price_volume_corr, 21, ("base",)),
    "pivots": Family(pivots, 1, ("base",)),
    "trend_lines": Family(trend_lines, 20, ("base",)),
    "volume_levels": Family(volume_levels, 120, ("base",)),
    "support_resistance": Family(support_resistance, 21, ("volume_levels",)),
    "on_balance": Family(on_balance, 15, ("base",), finish=finish_totals),
    "tail_risk": Family(tail_risk, 31, ("base",)),
    "candles": Family(candles, 21, ("base",)),
    "calendar": Family(calendar, 0, ("base",)),
    "macd": Family(None, _halo(26, 9), ("base",), tuple(MACD_STEPS)),
    "macd_cross": Family(macd_cross, 1, ("macd",)),
    "directional_inputs": Family(directional_inputs, 10, ("base",)),
    "kdj": Family(None, 2 * ema_halo(1 / 3), ("directional_inputs",), tuple(KDJ_STEPS)),
    "adx": Family(None, 2 * ema_halo(1 / 14), ("directional_inputs",), tuple(ADX_STEPS)),
    "tsi": Family(None, _halo(25, 13), ("directional_inputs",), tuple(TSI_STEPS)),
    "keltner_mid": Family(None, _halo(20), ("base",), tuple(KELTNER_STEPS)),
    "keltner": Family(keltner, 20, ("keltner_mid",)),
    "squeeze_width": Family(squeeze_width, 0, ("keltner", "moving_averages")),
    "squeeze_rank": Family(None, 500, ("squeeze_width",), tuple(SQUEEZE_STEPS)),
    "squeeze": Family(squeeze, 0, ("squeeze_rank", "bollinger")),
    "regime_quantiles": Family(None, 500, ("regime_inputs", "bollinger"), tuple(REGIME_STEPS)),
    "regime_flags": Family(regime_flags, 0, ("adx", "true_range", "regime_quantiles")),
}


def _with_period(period: str) -> dict[str, Family]:
    inputs = Family(lambda df, w: regime_inputs(df, w, period), 25, ("base",))
    return {**FAMILIES, "regime_inputs": inputs}


def compute(bars: DataFrame, wanted: Sequence[str], period: str = "1d") -> DataFrame:
    """Bars plus the columns of the wanted families (and of those they need).

    `period` only sets the day length of the regime flags; every other family is the same for all
    periods, and groups never mix.
    """
    table = _with_period(period)
    chosen: list[str] = []

    def visit(name: str) -> None:
        for n in table[name].needs:
            visit(n)
        if name not in chosen:
            chosen.append(name)

    for name in wanted:
        visit(name)
    depth: dict[str, int] = {}
    for n in chosen:
        depth[n] = table[n].back + max((depth[m] for m in table[n].needs), default=0)
    back = max(depth.values())
    ck = halo_chunks(bars, back=back, renewed=renewing_rows() if any(table[n].steps for n in chosen) else None)
    df, done, left = ck.df, set(), list(chosen)
    while left:
        # everything in Spark that can run now, then all waiting Arrow steps in one pass
        for n in list(left):
            if not table[n].steps and done.issuperset(table[n].needs):
                df = table[n].add(df, ck.w)
                done.add(n)
                left.remove(n)
        waiting = [n for n in left if table[n].steps and done.issuperset(table[n].needs)]
        if waiting:
            df = with_recursive(ck, df, [step for n in waiting for step in table[n].steps])
            done.update(waiting)
            left = [n for n in left if n not in done]
    df = df.filter("_own")
    carried = [n for n in chosen if table[n].finish]
    if carried:
        # what the carries need, without the Arrow step
        light = base(ck.df, ck.w)
        for n in carried:
            light = table[n].add(light, ck.w)
        for n in carried:
            df = table[n].finish(df, light.filter("_own"))
    return restored_keys(df).drop(*[c for c in df.columns if c.startswith("_")])
