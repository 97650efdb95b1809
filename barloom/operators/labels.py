"""Supervised labels. f is the log return to the next bar, r the one from the previous bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import frames as fr
from barloom.functions.nulls import flag, ratio
from barloom.operators.chunks import halo_chunks, restored_keys
from barloom.operators.kernels import ema_halo, ewm_std, renewing_rows, span_alpha, with_recursive
from barloom.operators.scan import bucketed_scan
from barloom.schema import KEYS, PERIODS, TIME

# The labels a row must have to be usable.
ESSENTIAL = (
    "target_logreturn",
    "target_binarytrend",
    "target_logsharpe_ratio",
    "target_vol_jump_prob",
    "target_realized_vol",
    "target_breakout_prob",
)
FUND_FLOW_WEIGHTS = {"exch_netflow": -0.35, "stablecoin_mcap": 0.25, "etf_flow": 0.25, "cb_premium": 0.15}


def with_future_close(df: DataFrame) -> DataFrame:
    ck = halo_chunks(df, back=0, ahead=1)
    return ck.owned(ck.df.withColumn("future_close", F.lead("close").over(ck.w)))


def with_labels(df: DataFrame, period: str, forward: bool = False) -> DataFrame:
    """All labels of one period's bars, plus the volatility and structure features they rest on.

    Reads open, high, low, close, volume and atr. Volatility-jump and realised volatility use the
    trailing window of the series shifted by one bar; with `forward` they use the window that lies
    wholly ahead instead. Run lengths are finished with positions carried across chunks.
    """
    spec = PERIODS[period]
    n, jw, jl, bn = spec.norm_window, spec.jump_window, spec.jump_base, spec.breakout_window
    reach = jw + 2 if forward else 3
    span = max(2, n // 2)
    back = max(n + max(jl, n) + 2, ema_halo(span_alpha(span)) + 1, bn + 2)
    ck = halo_chunks(df, back=back, ahead=reach, renewed=renewing_rows())
    w = ck.w
    out = ck.df.withColumns(
        {"_pc": F.lag("close").over(w), "future_close": F.lead("close").over(w), "_patr": F.lag("atr").over(w)}
    )
    ln = lambda a, b: F.ln(ratio(a, b))  # noqa: E731  (NULL at zero or unknown prices)
    out = out.withColumns(
        {
            "_r": ln(F.col("close"), F.col("_pc")),
            "_f": ln(F.col("future_close"), F.col("close")),
            "_hl2": F.pow(ln(F.col("high"), F.col("low")), F.lit(2.0)),
        }
    )
    step = F.signum(F.coalesce("_f", F.lit(0.0)))
    light = out.withColumns(
        {"_pos": ck.position(), "_dir": step, "_up": flag(F.col("_f") > 0)}
    ).withColumn("_pdir", F.coalesce(F.lag("_dir").over(w), F.lit(0.0)))
    out = with_recursive(ck, light, [("_ewm", ewm_std("_r", span=span, adjust=False))])
    r, f = F.col("_r"), F.col("_f")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns(
        {
            "rolling_volatility": F.log1p(zero(fr.std(r, w, n))),
            "parkinson_volatility": F.log1p(zero(fr.mean(F.col("_hl2"), w, n))),
            "ewmavolatility": zero(F.col("_ewm")),
            "return_skewness": fr.rolling(F.skewness, r, w, n),
            "tail_bias_norm": (F.col("high") + F.col("low") - 2 * F.col("close")) / (F.col("atr") + 1e-6),
            "amplitude_range": F.col("high") - F.col("low"),
            "atr_slope": F.col("atr") - F.col("_patr"),
            "_p10": fr.quantile(r, 0.10, w, n),
            "_p90": fr.quantile(r, 0.90, w, n),
            "_rs": fr.values(r, w, n),
            "_f1": F.lead("_f").over(w),
            # only differences of this total are used, so it may start at the chunk
            "_cum": F.when(f.isNotNull(), F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))),
            "_hi": fr.high(F.col("high"), w, bn, 2),
            "_lo": fr.low(F.col("low"), w, bn, 2),
            "_vmean": fr.mean(F.col("volume"), w, max(2, bn // 4)),
        }
    )
    less = F.size(F.filter("_rs", lambda x: x < r)).cast("double")
    same = F.size(F.filter("_rs", lambda x: x == r)).cast("double")
    f1 = F.col("_f1")
    ahead = w.rowsBetween(0, jw - 1)
    if forward:
        jump_std = F.when(F.count(f1).over(ahead) >= jw, F.stddev_samp(f1).over(ahead))
        square_sum = F.when(F.count(f1).over(ahead) >= jw, F.sum(f1 * f1).over(ahead))
    else:
        jump_std, square_sum = fr.std(f1, w, jw), fr.total(f1 * f1, w, jw)
    out = out.withColumns(
        {
            "target_logreturn": f,
            "target_logsharpe_ratio": f / (F.col("rolling_volatility") + 1e-6),
            "target_return_outlier_lower_10": flag(f < F.col("_p10")),
            "target_return_outlier_upper_90": flag(f > F.col("_p90")),
            "logreturn_pct_rank": F.when(F.size("_rs") == n, (less + (same + 1) / 2) / n),
            "target_binarytrend": F.col("_up"),
            "target_max_drawdown": F.col("_cum") - fr.high(F.col("_cum"), w, n, 1),
            "target_pullback_prob": flag(
                (F.lag("_up", 1).over(w) != F.col("_up")) & (F.lag("_up", 2).over(w) == F.col("_up"))
            ),
            "_calm": fr.mean(F.col("rolling_volatility"), w, max(2, n // 2)),
            "_hist": fr.mean(F.col("rolling_volatility"), w, jl),
            "_jump": jump_std,
            "_sq": square_sum,
        }
    )
    busy = F.col("volume") / (F.col("_vmean") + 1e-6) >= spec.breakout_volume
    next_close = F.col("future_close")
    beyond = (next_close >= F.col("_hi") * (1.0 + spec.breakout_eps)) | (
        next_close <= F.col("_lo") * (1.0 - spec.breakout_eps)
    )
    out = out.withColumns(
        {
            "target_drawdown_prob": flag(F.col("target_max_drawdown") < 0),
            "target_sideway_detect": flag((F.col("_calm") < 0.02) & (F.abs(f) < 0.001)),
            "target_vol_jump_prob": flag(
                F.coalesce(F.col("_jump") / (F.col("_hist") + 1e-6), F.lit(0.0)) >= spec.jump_tau
            ),
            "target_realized_vol": F.sqrt(F.col("_sq") + 1e-12) * spec.annual_factor,
            "target_breakout_prob": flag(beyond & busy),
        }
    )
    return _run_lengths(out.filter("_own"), light.filter("_own"))


def _run_lengths(df: DataFrame, light: DataFrame) -> DataFrame:
    """Length of the current run of equal direction, and of rising bars, over whole groups."""
    row = F.col("_pos") + 1
    starts = {"_turn": F.when(F.col("_pdir") != F.col("_dir"), row), "_fall": F.when(F.col("_up") == 0, row)}
    runs = bucketed_scan(df, KEYS, [TIME], "_chunk", lasts=starts, carry_from=light)
    zero = F.lit(0).cast("long")
    lengths = {"target_trend_persistence": row - F.coalesce("_turn", zero) + 1, "target_breakout_count": row - F.coalesce("_fall", zero)}
    return restored_keys(runs.withColumns(lengths)).drop(*[c for c in runs.columns if c.startswith("_")])


def drop_unlabelled(df: DataFrame, essential: Sequence[str] = ESSENTIAL) -> DataFrame:
    """Drop rows that miss an essential label; a label unknown everywhere does not count."""
    present = [c for c in essential if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return df.na.drop(subset=[c for c in present if counts[c]])


def drop_incomplete_features(df: DataFrame) -> DataFrame:
    """Drop rows with an unknown feature; labels, keys and future columns may stay unknown."""
    skip = ("symbol", "period", "datetime", "timestamp", "time_idx")
    return df.na.drop(subset=[c for c in df.columns if not c.startswith("target_") and c not in skip])


def fund_flow_strength(df: DataFrame) -> DataFrame:
    """Weighted sum of whole-column z-scores of flow columns (the stablecoin stock enters as its change).

    Needs the four source columns, which exist after fusing; without them the table is returned as is.
    """
    if any(c not in df.columns for c in FUND_FLOW_WEIGHTS):
        return df
    ck = halo_chunks(df, back=1)
    work = ck.df.withColumn("_stable", F.col("stablecoin_mcap") - F.lag("stablecoin_mcap").over(ck.w))
    work = work.filter("_own")
    source = {c: ("_stable" if c == "stablecoin_mcap" else c) for c in FUND_FLOW_WEIGHTS}
    stats = work.agg(
        *[F.avg(s).alias(f"m_{s}") for s in source.values()],
        *[F.stddev_pop(s).alias(f"s_{s}") for s in source.values()],
    ).first()
    total: Column = F.lit(0.0)
    for c, weight in FUND_FLOW_WEIGHTS.items():
        s = source[c]
        mu, sd = stats[f"m_{s}"] or 0.0, stats[f"s_{s}"] or 0.0
        total = total + weight * (F.col(s) - mu) / (sd if sd > 1e-6 else 1.0)
    return ck.owned(work.withColumn("target_fundflow_strength", total))


def label_fill(df: DataFrame) -> DataFrame:
    """Valid count and share of every label."""
    labels = [c for c in df.columns if c.startswith("target_")]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in labels])
    return counts.unpivot("rows", labels, "label", "valid").withColumn("share", ratio(F.col("valid"), F.col("rows")))
