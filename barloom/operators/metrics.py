"""Evaluation of probabilities and forecasts, by any grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.nulls import clip, ratio
from barloom.operators.ranks import average_rank, ranked_values

# Normal quantiles of the interval bounds.
Z = {10: -1.2815515655446004, 50: 0.0, 90: 1.2815515655446004}


def clip_probability(p: Column) -> Column:
    return clip(p, 1e-6, 1 - 1e-6)


def average_precision(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Sum over distinct thresholds of recall gain times precision; NULL for one-class groups."""
    at = ranked_values(df, keys, score, sums={"pos": (F.col(label) > 0.5).cast("long")})
    above = F.col("total") - F.col("before")
    hits = F.col("total_pos") - F.col("before_pos")
    gain = F.col("pos") * hits / above
    both = (F.max("total_pos") > 0) & (F.max("total_pos") < F.max("total"))
    return at.groupBy(*keys).agg(F.when(both, F.sum(gain) / F.max("total_pos")).alias("pr_auc"))


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Probability that a positive outranks a negative, from average ranks."""
    at = ranked_values(df, keys, score, sums={"pos": (F.col(label) > 0.5).cast("long")})
    p, n = F.max("total_pos"), F.max("total") - F.max("total_pos")
    auc = (F.sum(F.col("pos") * average_rank()) - p * (p + 1) / 2) / (p * n)
    return at.groupBy(*keys).agg(F.when((p > 0) & (n > 0), auc).alias("roc_auc"))


def calibration_bins(df: DataFrame, keys: Sequence[str], prob: str, label: str, bins: int = 10) -> DataFrame:
    """Per non-empty bin (lo, hi]: rows, confidence, accuracy at one half, positive rate. Zero is in no bin."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(bins)])
    p, y = F.col(prob), (F.col(label) > 0.5).cast("int")
    bin_ = F.size(F.filter(edges, lambda e: e < p))
    right = ((p > 0.5).cast("int") == y).cast("int")
    rows = df.withColumn("bin", bin_).filter((F.col("bin") > 0) & (p <= 1))
    return rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(right).alias("accuracy"), F.avg(y).alias("positive_rate")
    )


def expected_calibration_error(df: DataFrame, keys: Sequence[str], prob: str, label: str, bins: int = 10, against: str = "accuracy") -> DataFrame:
    """Bin-weighted gap of confidence and accuracy (or `positive_rate`, the usual form)."""
    per = calibration_bins(df, keys, prob, label, bins)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    gap = F.abs(F.col("confidence") - F.col(against)) * F.col("n")
    if not keys:
        return per.agg((F.sum(gap) / total.scalar()).alias("ece"))
    ece = per.groupBy(*keys).agg(F.sum(gap).alias("_gap"))
    return total.join(ece, list(keys), "left").select(
        *keys, (F.coalesce("_gap", F.lit(0.0)) / F.col("_all")).alias("ece")
    )


def brier(df: DataFrame, keys: Sequence[str], prob: str, label: str) -> DataFrame:
    y = (F.col(label) > 0.5).cast("int")
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(prob) - y, F.lit(2.0))).alias("brier"))


def classification(df: DataFrame, keys: Sequence[str], prob: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at a threshold."""
    yes, y = F.col(prob) >= threshold, F.col(label) > 0.5
    c = df.groupBy(*keys).agg(
        F.count_if(yes & y).alias("tp"), F.count_if(yes & ~y).alias("fp"), F.count_if(~yes & y).alias("fn"), F.count_if(~yes & ~y).alias("tn")
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(ratio(a.cast("double"), b.cast("double")), F.lit(0.0))
    return c.withColumns(
        {
            "accuracy": zero(tp + tn, tp + fp + fn + tn),
            "precision": zero(tp, tp + fp),
            "recall": zero(tp, tp + fn),
            "f1": zero(2 * tp, 2 * tp + fp + fn),
        }
    )


def regression(df: DataFrame, keys: Sequence[str], pred: str, y: str) -> DataFrame:
    e = F.col(pred) - F.col(y)
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - ratio(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
    )


def interval_metrics(df: DataFrame, keys: Sequence[str], pred: str, sigma: str, y: str) -> DataFrame:
    """Coverage and pinball loss of the 10, 50 and 90 % bounds pred + z * sigma."""
    out = []
    for q, z in Z.items():
        bound, tau = F.col(pred) + z * F.col(sigma), q / 100
        diff = F.col(y) - bound
        out.append(F.avg((diff <= 0).cast("int")).alias(f"coverage_{q}"))
        out.append(F.avg(F.greatest(tau * diff, (tau - 1) * diff)).alias(f"pinball_{q}"))
    return df.groupBy(*keys).agg(*out)


def _tall(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def evaluation_report(classes: DataFrame | None, values: DataFrame | None, keys: Sequence[str] = ("symbol", "period", "target"), bins: int = 15) -> DataFrame:
    """Long report (keys, metric, value): pr_auc, ece, brier; rmse, coverage and pinball of each bound."""
    parts = []
    if classes is not None:
        parts += [
            _tall(average_precision(classes, keys, "prob", "label"), keys, ["pr_auc"]),
            _tall(expected_calibration_error(classes, keys, "prob", "label", bins), keys, ["ece"]),
            _tall(brier(classes, keys, "prob", "label"), keys, ["brier"]),
        ]
    if values is not None:
        bounds = [f"{m}_{q}" for q in Z for m in ("coverage", "pinball")]
        parts += [
            _tall(regression(values, keys, "pred", "y"), keys, ["rmse"]),
            _tall(interval_metrics(values, keys, "pred", "sigma", "y"), keys, bounds),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_weights(df: DataFrame, label: str, lo: float = 0.1, hi: float = 10.0, eps: float = 1e-6) -> DataFrame:
    """Weight per row by class balance, clamped and scaled to mean one; three numbers are read from the data."""
    y = F.col(label) >= 0.5
    c = df.agg(F.greatest(F.count_if(y), F.lit(1)).alias("pos"), F.greatest(F.count_if(~y), F.lit(1)).alias("neg")).first()
    bound = lambda v: min(max(v, lo), hi)
    w_pos, w_neg = bound(c["neg"] / (c["pos"] + eps)), bound(c["pos"] / (c["neg"] + eps))
    total = df.agg((F.count_if(y) * w_pos + F.count_if(~y) * w_neg).alias("s"), F.count(F.lit(1)).alias("n")).first()
    scale = total["n"] / max(total["s"], eps)
    return df.withColumn("weight", F.when(y, w_pos * scale).otherwise(w_neg * scale))


def named_weights(df: DataFrame, column: str, weights: Mapping[str, float], out: str = "weight") -> DataFrame:
    """Static weight per name, one for names without any."""
    w = F.lit(1.0)
    for name, v in weights.items():
        w = F.when(F.col(column) == name, F.lit(float(v))).otherwise(w)
    return df.withColumn(out, w)


def gated_blend(base: Column, rich: Column, available: Column, gate: Column) -> Column:
    """(1 - a) * base + a * rich with a = availability * sigmoid(gate); base alone where rich is unknown."""
    a = available.cast("double") / (1 + F.exp(-gate))
    return F.when(rich.isNull(), base).otherwise((1 - a) * base + a * rich)
