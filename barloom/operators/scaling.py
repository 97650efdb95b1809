"""Target scaling by group statistics of the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from barloom.schema import KEYS

FLOOR = 1e-8


def target_scaler(train: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Mean and floored deviation of each regression target per (symbol, period)."""
    return train.groupBy(*KEYS).agg(
        *[F.avg(t).alias(f"{t}__mean") for t in targets],
        *[F.greatest(F.coalesce(F.stddev_samp(t), F.lit(1.0)), F.lit(FLOOR)).alias(f"{t}__std") for t in targets],
    )


def standardise(df: DataFrame, scaler: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(x - mean) / std by group; a group that never trained keeps its values."""
    out = df.join(scaler, list(KEYS), "left")
    mean = lambda t: F.coalesce(F.col(f"{t}__mean"), F.lit(0.0))
    std = lambda t: F.coalesce(F.col(f"{t}__std"), F.lit(1.0))
    return out.withColumns({t: (F.col(t) - mean(t)) / std(t) for t in targets}).select(*df.columns)


def destandardise(df: DataFrame, scaler: DataFrame, targets: Sequence[str]) -> DataFrame:
    out = df.join(scaler, list(KEYS), "left")
    mean = lambda t: F.coalesce(F.col(f"{t}__mean"), F.lit(0.0))
    std = lambda t: F.coalesce(F.col(f"{t}__std"), F.lit(1.0))
    return out.withColumns({t: F.col(t) * std(t) + mean(t) for t in targets}).select(*df.columns)
