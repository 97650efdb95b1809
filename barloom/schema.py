"""Table shapes and the per-period constants every operator reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

KEYS = ("symbol", "period")
TIME = "timestamp"

BAR_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("period", T.StringType()),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("symbol_idx", T.LongType()),
        T.StructField("period", T.StringType()),
        T.StructField("period_idx", T.LongType()),
        T.StructField("time_idx", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("uncertainty", T.DoubleType()),
        T.StructField("head_scale", T.DoubleType()),
        T.StructField("head_bias", T.DoubleType()),
        T.StructField("expert", T.StringType()),
        T.StructField("expert_ver", T.StringType()),
        T.StructField("schema_ver", T.StringType()),
        T.StructField("data_ver", T.StringType()),
        T.StructField("train_window_id", T.StringType()),
        T.StructField("period_config", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("global_step", T.LongType()),
    ]
)

# Versions that must agree inside one stacking run.
VERSION_COLUMNS = ("schema_ver", "data_ver", "expert_ver", "train_window_id")


@dataclass(frozen=True)
class PeriodSpec:
    """Window lengths (in bars) and thresholds of one bar period."""

    name: str
    step_ms: int
    norm_window: int
    jump_window: int
    jump_base: int
    jump_tau: float
    breakout_window: int
    breakout_eps: float
    breakout_volume: float
    bars_per_year: int
    bars_60d: int
    profile_bins: int
    slope_window: int
    day_window: int
    series_window: int
    outlier_neighbors: int

    @property
    def annual_factor(self) -> float:
        return float(self.bars_per_year) ** 0.5


# These must equal the published feature definitions.
PERIODS = {
    "1h": PeriodSpec("1h", 3_600_000, 96, 24, 96, 1.6, 96, 0.0015, 1.2, 24 * 365, 1440, 50, 24, 24, 96, 24),
    "4h": PeriodSpec("4h", 14_400_000, 56, 12, 48, 1.5, 48, 0.0015, 1.2, 6 * 365, 360, 40, 6, 6, 48, 12),
    "1d": PeriodSpec("1d", 86_400_000, 30, 7, 30, 1.4, 30, 0.001, 1.1, 365, 60, 20, 2, 1, 30, 6),
}


def step_ms(period: str | Column = "period") -> Column:
    """Declared bar step in ms; NULL for an undeclared period."""
    p = F.col(period) if isinstance(period, str) else period
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for spec in PERIODS.values():
        out = out.when(p == spec.name, F.lit(spec.step_ms).cast("long"))
    return out
