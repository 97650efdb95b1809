"""Cross-section, volume profile, regime core and derivative-series features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barloom.functions import frames as fr
from barloom.functions.nulls import finite, ratio
from barloom.operators.chunks import halo_chunks
from barloom.operators.kernels import ema_halo, ewm_std, renewing_rows, span_alpha, with_recursive
from barloom.operators.norms import lagged_standardise
from barloom.operators.scan import bucketed_scan
from barloom.schema import KEYS, PERIODS, TIME


def log_return(c: str, prev: Column) -> Column:
    return F.when(F.col(c) > 0, F.ln(c)) - F.when(prev > 0, F.ln(prev))


# --- benchmark beta -----------------------------------------------------------------------------


def benchmark_returns(bars: DataFrame, symbol: str) -> DataFrame:
    """(period, timestamp, r_btc) of the benchmark symbol."""
    ck = halo_chunks(bars.filter(F.col("symbol") == symbol).select(*KEYS, TIME, "close"), back=1)
    r = ck.df.withColumn("_pc", F.lag("close").over(ck.w)).withColumn("r_btc", log_return("close", F.col("_pc")))
    return ck.owned(r).select("period", TIME, "r_btc")


def benchmark_beta(bars: DataFrame, benchmark: DataFrame, period: str) -> DataFrame:
    """Adds r_sym, r_btc and beta_btc_60d (lagged one bar).

    The benchmark is joined by an equality on time: Spark broadcasts it when it is small and
    shuffles otherwise. The frame of 60 days can be 1440 rows, so its means are differences of
    running totals, one step per row whatever the frame length.
    """
    n = PERIODS[period].bars_60d
    need = max(n // 2, 30)
    joined = bars.join(benchmark, ["period", TIME], "left")
    ck = halo_chunks(joined, back=n + 2)
    df = ck.df.withColumn("_pc", F.lag("close").over(ck.w)).withColumn("r_sym", log_return("close", F.col("_pc")))
    x, y = F.col("r_sym"), F.col("r_btc")
    moments = {"x": x, "y": y, "xy": x * y, "yy": y * y}
    run = ck.w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_{k}": v for k, v in moments.items()})
    df = df.withColumns(
        {f"_s{k}": F.coalesce(F.sum(f"_{k}").over(run), F.lit(0.0)) for k in moments}
        | {f"_n{k}": F.count(f"_{k}").over(run) for k in moments}
    )
    df = df.withColumns(
        {f"_ps{k}": F.lag(f"_s{k}", n, 0.0).over(ck.w) for k in moments}
        | {f"_pn{k}": F.lag(f"_n{k}", n, 0).over(ck.w) for k in moments}
    )
    mean = {}
    for k in moments:
        cnt = F.col(f"_n{k}") - F.col(f"_pn{k}")
        mean[k] = F.when(cnt >= need, (F.col(f"_s{k}") - F.col(f"_ps{k}")) / cnt)
    cov = mean["xy"] - mean["x"] * mean["y"]
    var = mean["yy"] - mean["y"] * mean["y"]
    df = df.withColumn("_beta", ratio(cov, var)).withColumn("beta_btc_60d", F.lag("_beta").over(ck.w))
    return ck.owned(df)


# --- volume profile -----------------------------------------------------------------------------


def _profile_nodes(price: np.ndarray, volume: np.ndarray, window: int, bins: int, need: int):
    """Centre of the heaviest and of the lightest non-empty price bin of each trailing window."""
    n = len(price)
    heavy, light = np.full(n, np.nan), np.full(n, np.nan)
    pad = np.full(window - 1, np.nan)
    p_all = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, price]), window)
    v_all = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, volume]), window)
    block = max(1, 262_144 // window)
    for a in range(0, n, block):
        p, v = p_all[a : a + block], v_all[a : a + block]
        rows = np.minimum(np.arange(a, a + len(p)) + 1, window)
        known = np.isfinite(p)
        lo = np.where(known, p, np.inf).min(axis=1)
        hi = np.where(known, p, -np.inf).max(axis=1)
        ok = (rows >= need) & np.isfinite(lo) & np.isfinite(hi) & (hi > lo)
        if not ok.any():
            continue
        p, v, known, lo, hi = p[ok], v[ok], known[ok], lo[ok, None], hi[ok, None]
        width = (hi - lo) / bins
        with np.errstate(invalid="ignore"):
            at = np.where(known, (p - lo) / (hi - lo) * bins, 0).astype(np.int64)
        at = np.clip(at, 0, bins - 1)
        # rounding may leave a price on the wrong side of an edge
        at -= known & (p < lo + at * width)
        at += known & (at < bins - 1) & (p >= lo + (at + 1) * width)
        weight = np.where(known & np.isfinite(v), v, 0.0)
        flat = (np.arange(len(p))[:, None] * bins + at).ravel()
        hist = np.bincount(flat, weights=weight.ravel(), minlength=len(p) * bins).reshape(-1, bins)
        top = hist.argmax(axis=1)
        some = (hist > 0).any(axis=1)
        bottom = np.where(hist > 0, hist, np.inf).argmin(axis=1)
        centre = lambda k: lo[:, 0] + (k + 0.5) * width[:, 0]
        idx = np.flatnonzero(ok) + a
        heavy[idx] = centre(top)
        light[idx] = np.where(some, centre(bottom), np.nan)
    return heavy, light


def volume_profile(bars: DataFrame, period: str) -> DataFrame:
    """Adds volume_profile_hvn and volume_profile_lvn over 60 days, lagged one bar.

    A histogram per row over up to 1440 rows; done in array blocks per chunk, since an explode
    would multiply the data by the frame length.
    """
    spec = PERIODS[period]
    window, bins, need = spec.bars_60d, spec.profile_bins, max(spec.bars_60d // 2, 30)
    ck = halo_chunks(bars, back=window + 1)
    names = ("volume_profile_hvn", "volume_profile_lvn")
    schema = T.StructType([*ck.df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    order = ck.order

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        nodes = _profile_nodes(pdf["close"].to_numpy(float), pdf["volume"].to_numpy(float), window, bins, need)
        for name, values in zip(names, nodes):
            pdf[name] = pd.Series(values).shift(1)
        return pdf

    return ck.owned(ck.df.groupBy(*ck.chunk_keys).applyInPandas(run, schema))


# --- agreement across periods -------------------------------------------------------------------


def trend_agreement(trends: Mapping[str, DataFrame], on: str, bucket_ms: int = 86_400_000 * 64) -> DataFrame:
    """Sum over periods of sign(ma5 - ma20), each period's latest bar as of the bar of period `on`.

    `trends` holds (symbol, timestamp, ma5, ma20) per period. One scan carries every period's last
    direction; at equal times slower bars count as known.
    """
    rest = [p for p in trends if p != on]
    rows = None
    for p, df in trends.items():
        direction = F.signum(F.col("ma5") - F.col("ma20"))
        one = df.select(
            "symbol",
            TIME,
            F.lit(int(p == on)).alias("_mine"),
            *[(direction if q == p else F.lit(None).cast("double")).alias(f"_dir_{q}") for q in trends],
        )
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("_bucket", F.floor(F.col(TIME) / F.lit(bucket_ms)))
    carried = bucketed_scan(
        rows, ["symbol"], [TIME, "_mine"], "_bucket", lasts={f"_last_{p}": F.col(f"_dir_{p}") for p in rest}
    )
    total = F.coalesce(F.col(f"_dir_{on}"), F.lit(0.0))
    for p in rest:
        total = total + F.coalesce(F.col(f"_last_{p}"), F.lit(0.0))
    return carried.filter(F.col("_mine") == 1).select(
        "symbol", F.lit(on).alias("period"), TIME, total.alias("trend_agree_multi")
    )


# --- regime core --------------------------------------------------------------------------------


def regime_core(
    df: DataFrame,
    fast: int = 24,
    slow: int = 72,
    funding: str | None = "funding_rate",
    open_interest: str | None = "open_interest",
    atr: str | None = "atr",
) -> DataFrame:
    """Volatility, momentum, slopes and the structural gap; a source that is absent gives NULL."""
    span = max(10, fast // 2)
    ck = halo_chunks(df, back=max(slow, ema_halo(span_alpha(span))) + 1, renewed=renewing_rows())
    w, have = ck.w, set(df.columns)
    out = ck.df.withColumn("_pc", F.lag("close").over(w))
    out = out.withColumn("_ret", finite(ratio(F.col("close"), F.col("_pc")) - 1))
    out = with_recursive(ck, out, [("ewma_vol", ewm_std("_ret", span=span))])

    def change(c: str, n: int = 1) -> Column:
        return finite(ratio(F.col(c), F.lag(c, n).over(w)) - 1)

    def diff(c: str | None) -> Column:
        return F.col(c) - F.lag(c).over(w) if c and c in have else F.lit(None).cast("double")

    mid = (fr.high(F.col("high"), w, slow) + fr.low(F.col("low"), w, slow)) / 2
    return ck.owned(
        out.withColumns(
            {
                "realized_vol": fr.std(F.col("_ret"), w, fast),
                "volume_change": change("volume"),
                "funding_rate_slope": diff(funding),
                "open_interest_slope": diff(open_interest),
                "momentum_fast": change("close", fast),
                "momentum_slow": change("close", slow),
                "atr_slope": diff(atr),
                "structural_gap": ratio(F.col("close") - mid, F.col("close")),
            }
        )
    )


# --- derivative series --------------------------------------------------------------------------


def open_interest_features(df: DataFrame, period: str) -> DataFrame:
    """Mean of open and close, log return, ATR-like volatility and a lagged z-score of the mean."""
    n = PERIODS[period].series_window
    mp, eps = max(5, n // 3), 1e-12
    ck = halo_chunks(df, back=2 * n + 2)
    out = ck.df.withColumns(
        {
            "_pc": F.lag("close").over(ck.w),
            "oi_mean_oc": (F.coalesce("open", "close") + F.col("close")) / 2.0,
        }
    )
    floor = lambda c: F.greatest(c, F.lit(eps))
    pc = F.col("_pc")
    out = out.withColumns(
        {
            "oi_logret": F.when(pc.isNotNull() & F.col("close").isNotNull(), F.ln(floor(F.col("close")) / floor(pc))),
            "_tr": F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)),
            "_mu": fr.mean(F.col("oi_mean_oc"), ck.w, n, mp, lag=1),
            "_sd": fr.std_pop(F.col("oi_mean_oc"), ck.w, n, mp, lag=1),
        }
    )
    spread = F.when(F.col("_sd") > 0, F.col("_sd"))
    return ck.owned(
        out.withColumns(
            {
                "oi_vol": fr.mean(F.col("_tr"), ck.w, n, mp),
                "oi_mean_oc_z": (F.col("oi_mean_oc") - F.col("_mu")) / (spread + eps),
            }
        )
    )


def taker_imbalance(df: DataFrame, buy: str, sell: str, window: int, min_periods: int | None = None, method: str = "z") -> DataFrame:
    """(buy - sell) / (buy + sell) and the lagged scaling of all three columns."""
    mp = max(8, window // 4) if min_periods is None else min_periods
    b, s = F.col(buy), F.col(sell)
    with_gap = df.withColumn("taker_imbalance", (b - s) / (b + s + 1e-12))
    return lagged_standardise(with_gap, [buy, sell, "taker_imbalance"], window, mp, method)


def compounded_rate(df: DataFrame, rate: str, span_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """exp(sum log1p(r)) - 1 over (t - span, t] for every instant t.

    A RANGE frame reaches back in time, so rows are laid out in time slices of the span's length and
    every slice borrows the one before it: one copy per row, whatever the group size.
    """
    slice_ = F.floor(F.col(TIME) / F.lit(span_ms))
    laid = df.withColumn("_home", slice_).withColumn("_slice", F.explode(F.array(slice_, slice_ + 1)))
    w = Window.partitionBy(*keys, "_slice").orderBy(TIME).rangeBetween(-(span_ms - 1), 0)
    log = F.log1p(F.coalesce(F.col(rate), F.lit(0.0)))
    out = laid.withColumn("_log", log).withColumn("accumulated", F.expm1(F.sum("_log").over(w)))
    return out.filter(F.col("_home") == F.col("_slice")).drop("_home", "_slice", "_log")


def net_flow(inflow: Column, outflow: Column) -> Column:
    return F.coalesce(inflow, F.lit(0.0)) - F.coalesce(outflow, F.lit(0.0))
