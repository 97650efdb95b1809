"""Stacking tables from long predictions, and the baselines they are judged against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from barloom.columns import STACK_PREFIXES, is_target
from barloom.operators.market import regime_core
from barloom.operators.metrics import average_precision, clip_probability, regression
from barloom.schema import KEYS, VERSION_COLUMNS

ROW = (*KEYS, "time_idx")


def experts_and_targets(predictions: DataFrame) -> list[tuple[str, str]]:
    """The pivot columns: a handful of names, read once so that the pivot needs no second pass."""
    pairs = predictions.select("expert", "target").distinct().orderBy("expert", "target")
    return [(r["expert"], r["target"]) for r in pairs.collect()]


def pivot_predictions(predictions: DataFrame, names: Sequence[tuple[str, str]], values: Sequence[str] = ("score", "uncertainty")) -> DataFrame:
    """score__<expert>__<target>, … per (symbol, period, time_idx), averaging repeated predictions."""
    is_ = lambda e, t: (F.col("expert") == e) & (F.col("target") == t)
    return predictions.groupBy(*ROW).agg(
        *[F.avg(F.when(is_(e, t), F.col(v))).alias(f"{v}__{e}__{t}") for v in values for e, t in names]
    )


def consistent_versions(predictions: DataFrame) -> dict[str, str]:
    """The one version tuple of a prediction set; more than one is an error."""
    rows = predictions.select(*VERSION_COLUMNS).distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"predictions mix versions: {[r.asDict() for r in rows]}")
    return rows[0].asDict()


def version_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(*VERSION_COLUMNS).agg(F.count(F.lit(1)).alias("rows"))


def stacking_table(predictions: DataFrame, bars: DataFrame, targets: Sequence[str] | None = None, regime: bool = True) -> DataFrame:
    """Wide scores and uncertainties, labels and regime features on (symbol, period, time_idx)."""
    versions = consistent_versions(predictions)
    wide = pivot_predictions(predictions, experts_and_targets(predictions))
    labels = list(targets) if targets is not None else [c for c in bars.columns if is_target(c)]
    source = regime_core(bars.drop("realized_vol", "ewma_vol")) if regime else bars
    extra = [c for c in STACK_PREFIXES if c in source.columns] if regime else []
    right = source.select(*ROW, *labels, *extra).dropDuplicates(list(ROW))
    return wide.join(right, list(ROW)).withColumns({k: F.lit(v) for k, v in versions.items()})


def stack_features(columns: Sequence[str], prefixes: Sequence[str] = STACK_PREFIXES) -> list[str]:
    return sorted({c for c in columns if c.startswith(tuple(prefixes))})


def score_columns(features: Sequence[str]) -> list[str]:
    scores = [c for c in features if c.startswith("score__")]
    return scores or list(features)


def equal_weight(df: DataFrame, features: Sequence[str], out: str = "equal_weight", classes: bool = True) -> DataFrame:
    """Row mean of the known scores."""
    known = F.filter(F.array(*[F.col(c) for c in score_columns(features)]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))
    return df.withColumn(out, clip_probability(mean) if classes else mean)


def single_scores(df: DataFrame, features: Sequence[str], target: str, classes: bool = True) -> DataFrame:
    """Quality of every score column alone: (column, metric), all columns in one pass over long rows."""
    cols = score_columns(features)
    tall = df.select(target, *cols).unpivot([target], cols, "column", "score").filter("score is not null")
    if classes:
        return average_precision(tall, ["column"], "score", target).select("column", F.col("pr_auc").alias("metric"))
    return regression(tall, ["column"], "score", target).select("column", (-F.col("rmse")).alias("metric"))


def best_single(validation: DataFrame, test: DataFrame, features: Sequence[str], target: str, classes: bool = True, out: str = "best_single") -> DataFrame:
    """The score column that is best on validation, applied to test; ties go to the first column."""
    best = single_scores(validation, features, target, classes).orderBy(F.desc_nulls_last("metric"), "column").first()["column"]
    return test.withColumn(out, clip_probability(F.col(best)) if classes else F.col(best))
