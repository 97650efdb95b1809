"""Leak guards, derived differences and rolling normalisation."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barloom.functions import frames as fr
from barloom.functions.nulls import clip, ratio
from barloom.operators.chunks import Chunked, halo_chunks
from barloom.operators.scan import with_position
from barloom.schema import KEYS, PERIODS, TIME

# Columns that become known only after their bar closes, and the ones that get a
# difference and a one-day slope.
LAGGED = (
    "trend_flag", "range_flag", "high_vol_flag", "stress_flag", "squeeze_on", "ppo", "stoch_rsi", "williams_r", "tsi",
    "psar", "psar_flip_flag", "supertrend_10_3", "heikin_ashi_trend", "ret_skew_30d", "ret_kurt_30d", "var_95_30d",
    "cvar_95_30d", "z_score_gap", "mfi", "cmf", "price_volume_corr_20", "price_position_ma200", "beta_btc_60d",
    "pivot_point", "distance_to_pivot", "volume_profile_hvn", "volume_profile_lvn",
)
CALENDAR = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")
SLOPED = (
    "trend_flag", "range_flag", "ppo", "stoch_rsi", "psar", "ret_skew_30d", "ret_kurt_30d", "mfi", "price_position_ma200",
)


def lag_guard(df: DataFrame, cols: Sequence[str] = LAGGED, calendar: bool = False) -> DataFrame:
    """Shift the listed columns by one bar. Calendar columns are known ahead and stay unless asked for."""
    ck = halo_chunks(df, back=1)
    return ck.owned(_lagged(ck, cols, calendar))


def differences_and_slopes(df: DataFrame, period: str, cols: Sequence[str] = SLOPED) -> DataFrame:
    """c_diff1 and c_slope_24h (least squares over one day, from half a day of known values)."""
    ck = halo_chunks(df, back=PERIODS[period].slope_window)
    return ck.owned(_sloped(ck, ck.df, period, cols))


def guarded_slopes(df: DataFrame, period: str, calendar: bool = False) -> DataFrame:
    """`lag_guard`, then `differences_and_slopes` of the lagged columns, in one layout."""
    ck = halo_chunks(df, back=PERIODS[period].slope_window + 1)
    return ck.owned(_sloped(ck, _lagged(ck, LAGGED, calendar), period, SLOPED))


def _lagged(ck: Chunked, cols: Sequence[str], calendar: bool) -> DataFrame:
    listed = [c for c in (*cols, *(CALENDAR if calendar else ())) if c in ck.df.columns]
    return ck.df.withColumns({c: F.lag(c).over(ck.w) for c in listed})


def _sloped(ck: Chunked, df: DataFrame, period: str, cols: Sequence[str]) -> DataFrame:
    n = PERIODS[period].slope_window
    listed = [c for c in cols if c in df.columns]
    work = df.withColumn("_pos", F.row_number().over(ck.w))
    out = {f"{c}_diff1": F.col(c) - F.lag(c).over(ck.w) for c in listed}
    # the fit is over the whole frame: an unknown value inside makes the sum unknown
    out |= {f"{c}_slope_24h": _gapless_slope(F.col(c), F.col("_pos"), ck.w, n, max(2, n // 2)) for c in listed}
    return work.withColumns(out)


def _gapless_slope(y: Column, pos: Column, w, n: int, mp: int) -> Column:
    frame = fr.back(w, n)
    rows, known = F.count(F.lit(1)).over(frame), F.count(y).over(frame)
    return F.when((known >= mp) & (known == rows), F.regr_slope(y.cast("double"), pos.cast("double")).over(frame))


def rolling_norms(
    df: DataFrame,
    cols: Sequence[str],
    window: int,
    methods: Sequence[str] = ("z", "mm"),
    min_periods: int | None = None,
    eps: float = 1e-7,
    suffix: bool = True,
    clip_z: float | None = 5.0,
    clip_mm: tuple[float, float] | None = (0.0, 1.0),
    wide: bool = False,
) -> DataFrame:
    """x_zn<W> and x_mm<W> against the window that ends one bar earlier.

    The lag is folded into the frame, and the frame stays inside its (symbol, period) group. A Spark
    frame that slides evaluates every aggregate over its whole length for each row; for a wide table
    that is hundreds of aggregates, so a caller with one asks for `wide`: updating statistics in an
    Arrow step (measured at 65 columns and 30 bars: 1.4 s instead of 11 s).
    """
    mp = window if min_periods is None else min_periods
    tag = str(window) if suffix else ""
    ck = halo_chunks(df, back=window)
    kinds = ("mean", "std") if "z" in methods else ()
    kinds += ("min", "max") if "mm" in methods else ()
    stats = _wide_stats if wide else _frame_stats
    work = stats(ck, cols, window, mp, kinds)
    out: dict[str, Column] = {}
    for c in cols:
        x = F.col(c).cast("double")
        if "z" in methods:
            z = (x - F.col(f"_mean_{c}")) / (F.abs(f"_std_{c}") + eps)
            out[f"{c}_zn{tag}"] = z if clip_z is None else clip(z, -clip_z, clip_z)
        if "mm" in methods:
            mm = (x - F.col(f"_min_{c}")) / (F.abs(F.col(f"_max_{c}") - F.col(f"_min_{c}")) + eps)
            out[f"{c}_mm{tag}"] = mm if clip_mm is None else clip(mm, *clip_mm)
    return ck.owned(work.withColumns(out))


def _frame_stats(ck: Chunked, cols: Sequence[str], window: int, mp: int, kinds: Sequence[str]) -> DataFrame:
    """Built-in window aggregates."""
    frame = fr.back(ck.w, window, lag=1)
    agg = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    raw: dict[str, Column] = {}
    for c in cols:
        x = F.col(c).cast("double")
        raw[f"_n_{c}"] = F.count(x).over(frame)
        raw |= {f"_{k}_{c}": agg[k](x).over(frame) for k in kinds}
    known = {f"_{k}_{c}": F.when(F.col(f"_n_{c}") >= mp, F.col(f"_{k}_{c}")) for c in cols for k in kinds}
    return ck.df.withColumns(raw).withColumns(known)


def _wide_stats(ck: Chunked, cols: Sequence[str], window: int, mp: int, kinds: Sequence[str]) -> DataFrame:
    """The same statistics for many columns at once, updated row by row inside each chunk."""
    names, order = list(cols), ck.order
    added = [f"_{k}_{c}" for k in kinds for c in names]
    schema = T.StructType([*ck.df.schema.fields, *[T.StructField(a, T.DoubleType()) for a in added]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        earlier = pdf[names].astype("float64").shift(1).rolling(window, min_periods=mp)
        parts = [getattr(earlier, k)().add_prefix(f"_{k}_") for k in kinds]
        return pd.concat([pdf, *parts], axis=1)[schema.names]

    return ck.df.groupBy(*ck.chunk_keys).applyInPandas(run, schema)


def trim_warm_up(df: DataFrame, window: int, subset: Sequence[str], bucket: Column) -> DataFrame:
    """Drop the first `window` rows of each group, then rows unknown in any of the subset."""
    placed = with_position(df.withColumn("_bucket", bucket), KEYS, [TIME], "_bucket", "_row")
    return placed.filter(F.col("_row") >= window).drop("_row", "_bucket").na.drop(subset=list(subset))


def lagged_standardise(df: DataFrame, cols: Sequence[str], window: int, min_periods: int, method: str = "z") -> DataFrame:
    """Slow-series scaling with statistics of the earlier window only: z, r(obust) or m(in-max)."""
    ck = halo_chunks(df, back=window)
    mp = min_periods
    stats: dict[str, Column] = {}
    for c in cols:
        x = F.col(c)
        if method == "z":
            stats[f"_a_{c}"] = fr.mean(x, ck.w, window, mp, lag=1)
            stats[f"_b_{c}"] = fr.std_pop(x, ck.w, window, mp, lag=1)
        elif method == "r":
            stats[f"_a_{c}"] = fr.quantile(x, 0.5, ck.w, window, mp, lag=1)
            stats[f"_b_{c}"] = fr.quantile(x, 0.75, ck.w, window, mp, lag=1) - fr.quantile(
                x, 0.25, ck.w, window, mp, lag=1
            )
        else:
            stats[f"_a_{c}"] = fr.low(x, ck.w, window, mp, lag=1)
            stats[f"_b_{c}"] = fr.high(x, ck.w, window, mp, lag=1) - fr.low(x, ck.w, window, mp, lag=1)
    out = {f"{c}_{method}": ratio(F.col(c) - F.col(f"_a_{c}"), F.col(f"_b_{c}")) for c in cols}
    return ck.owned(ck.df.withColumns(stats).withColumns(out))
