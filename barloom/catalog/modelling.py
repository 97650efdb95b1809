"""Model evidence and stacking; no SQL counterpart, checked by properties in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import evaluation
from barloom.catalog.selection import matrix
from barloom.catalog.tables import bars
from barloom.operators import metrics, models, splits, stacking
from barloom.sources.staging import staged

QUERIES: dict = {}
ORACLE: dict = {}
COLS = [*[f"f{i}" for i in range(16)], "f_planted"]
TARGET = "target_binarytrend"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _halves(spark, sf):
    df = staged(matrix(spark, sf).select("vec_id", "label", TARGET, *COLS), "matrix")
    val = F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0
    return df.filter(~val), df.filter(val)


@query
def tree_importance(spark, sf):
    train, _ = _halves(spark, sf)
    return models.tree_importance(models.vector_table(train, COLS, TARGET), COLS, True)


@query
def shadow_test(spark, sf):
    train, _ = _halves(spark, sf)
    return models.shadow_test(models.vector_table(train, COLS, TARGET, ["vec_id"]), COLS, ["vec_id"], True, rounds=2)


@query
def linear_path(spark, sf):
    train, _ = _halves(spark, sf)
    return models.linear_path(models.vector_table(train, COLS, TARGET), COLS, True)


@query
def shuffle_permutation(spark, sf):
    train, val = (models.vector_table(d, COLS, TARGET, ["vec_id"]) for d in _halves(spark, sf))
    model = models._forest(True, 40, 42).fit(train)
    return models.shuffle_permutation(model, val, COLS, ["vec_id"], True, repeats=2)


@query
def cyclic_permutation(spark, sf):
    """Three groups of vectors in id order; shifts near eight rows."""
    train, val = (models.vector_table(d, COLS, TARGET, ["vec_id"]) for d in _halves(spark, sf))
    model = models._forest(True, 40, 42).fit(train)
    val = val.withColumn("grp", F.col("vec_id") % 3)
    bucket = F.floor(F.col("vec_id") / 4096)
    return models.cyclic_permutation(model, val, COLS, ["grp"], ["vec_id"], bucket, True, block=8, repeats=3, embargo=2, purge=2)


@query
def backward_elimination(spark, sf):
    train, val = _halves(spark, sf)
    keep, score = models.backward_elimination(train, val, COLS, {TARGET: 1.0}, trees=10)
    return spark.createDataFrame([(k, score) for k in keep], "feature string, score double")


@query
def rolling_validation(spark, sf):
    """Expanding folds of the daily bars, two features, next direction as label."""
    df = evaluation.labelled_bars(spark, sf).withColumn(TARGET, F.col("target_up"))
    rows = staged(splits.rolling_folds(df, 3, 0.2), "folds")
    return models.validation_summary(models.rolling_validation(rows, ["x_mom", "x_rng"], {TARGET: 1.0}, trees=10))


@query
def stack_model_report(spark, sf):
    """Logistic stack against both baselines on test rows: average precision and calibration error."""
    rows, feats = evaluation._parts(spark, sf)
    train, val, test = (rows.filter(F.col("part") == p) for p in ("train", "val", "test"))
    model = models.fit_stack(train, feats, "target_up", True)
    out = models.predict_stack(model, test, feats, True)
    out = stacking.best_single(val, stacking.equal_weight(out, feats), feats, "target_up")
    tall = out.select("target_up", "model", "equal_weight", "best_single").unpivot(
        ["target_up"], ["model", "equal_weight", "best_single"], "model_name", "prob"
    )
    return metrics.average_precision(tall, ["model_name"], "prob", "target_up").join(
        metrics.expected_calibration_error(tall, ["model_name"], "prob", "target_up"), "model_name"
    )


@query
def stack_regression_report(spark, sf):
    """Boosted-tree stack of the next return against the mean score."""
    daily = bars(spark, sf, "1d")  # built from the ticks once, for all three uses
    rows, feats = evaluation._parts(spark, sf, daily)
    ret = evaluation.value_rows(spark, sf, daily).select("symbol", "timestamp", "y")
    idx = splits.with_time_idx(daily).select("symbol", "period", "time_idx", "timestamp")
    rows = staged(rows.join(idx, ["symbol", "period", "time_idx"]).join(ret, ["symbol", "timestamp"]), "stack_y")
    model = models.fit_stack(rows.filter("part = 'train'"), feats, "y", False)
    out = models.predict_stack(model, rows.filter("part = 'test'"), feats, False)
    out = stacking.equal_weight(out, feats, classes=False)
    tall = out.select("y", "model", "equal_weight").unpivot(["y"], ["model", "equal_weight"], "model_name", "pred")
    return metrics.regression(tall, ["model_name"], "pred", "y")


@query
def temperature_scaling(spark, sf):
    ev = evaluation.class_rows(spark, sf)
    p = metrics.clip_probability(F.col("prob"))
    ev = ev.withColumn("logit", F.ln(p / (1 - p)))
    t = models.temperature(ev, "logit", "label")
    scaled = ev.withColumn("prob", models.scaled_probability(F.col("logit"), t))
    before = metrics.expected_calibration_error(ev, [], "prob", "label", against="positive_rate").withColumn("stage", F.lit("before"))
    after = metrics.expected_calibration_error(scaled, [], "prob", "label", against="positive_rate").withColumn("stage", F.lit("after"))
    return before.unionByName(after).withColumn("temperature", F.lit(t))


@query
def label_evidence(spark, sf):
    """All kinds of evidence for one label, joined per feature."""
    train, val = _halves(spark, sf)
    return models.evidence_for(train, val, COLS, TARGET, ["vec_id"], trees=10, repeats=1, rounds=1)
