"""Predictions to a judged stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators import audits, metrics, models, splits, stacking
from barloom.sources.staging import staged


def run_stack(predictions: DataFrame, bars: DataFrame, target: str, classes: bool = True, train: float = 0.6, val: float = 0.2) -> dict[str, DataFrame]:
    """Stacking table, leakage audit, and validation/test quality of the model and both baselines."""
    table = staged(stacking.stacking_table(predictions, bars, [target]), "stacking")
    features = stacking.stack_features(table.columns)
    rows = staged(splits.three_way_split(table.filter(F.col(target).isNotNull()), train, val), "parts")
    part = lambda *p: rows.filter(F.col("part").isin(*p, "all"))
    model = models.fit_stack(part("train"), features, target, classes)
    validation, test = part("val", "val_test"), part("test", "val_test")
    judged = None
    for stage, data in (("val", validation), ("test", test)):
        out = models.predict_stack(model, data, features, classes)
        out = stacking.equal_weight(out, features, classes=classes)
        out = stacking.best_single(validation, out, features, target, classes)
        names = ["model", "equal_weight", "best_single"]
        tall = out.select(target, *names).unpivot([target], names, "name", "value").withColumn("stage", F.lit(stage))
        judged = tall if judged is None else judged.unionByName(tall)
    key = ["stage", "name"]
    if classes:
        judged = judged.withColumn("value", metrics.clip_probability(F.col("value")))
        report = metrics.average_precision(judged, key, "value", target).join(
            metrics.expected_calibration_error(judged, key, "value", target), key
        )
    else:
        report = metrics.regression(judged, key, "value", target)
    return {"table": table, "audit": audits.leakage(table), "report": report}
