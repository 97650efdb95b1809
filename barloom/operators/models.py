"""Model evidence with MLlib: importances, shadow tests, linear paths, permutation, subset search, stacking.

Numbers differ from other tree libraries by nature; what is kept is the procedure. Every fit reads a
table of a label and one feature vector, which callers stage or cache once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from barloom.columns import is_class_target
from barloom.functions.nulls import ratio
from barloom.operators.scan import with_position
from barloom.operators.screening import impute_median

VEC, LABEL, PRED = "features", "label", "prediction"


def vector_table(df: DataFrame, cols: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, label, features) with unknown features as zero; class labels unknown count as 0 and stay in {0, 1}."""
    y = F.col(target).cast("double")
    if is_class_target(target):
        y = F.least(F.greatest(F.coalesce(y, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).cast("int").cast("double")
    filled = df.filter(y.isNotNull()).select(*keep, y.alias(LABEL), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return VectorAssembler(inputCols=list(cols), outputCol=VEC).transform(filled).select(*keep, LABEL, VEC)


def _forest(classes: bool, trees: int, seed: int, features: str = VEC):
    kind = RandomForestClassifier if classes else RandomForestRegressor
    return kind(featuresCol=features, labelCol=LABEL, numTrees=trees, maxDepth=5, seed=seed)


def tree_importance(data: DataFrame, cols: Sequence[str], classes: bool, trees: int = 40, seed: int = 42) -> DataFrame:
    model = _forest(classes, trees, seed).fit(data)
    return data.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())], "feature string, tree_importance double"
    )


def shuffled_vectors(data: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    """Adds `shadow`: another row's vector, by a random one-to-one assignment of rows.

    Rows are numbered twice, in the order of two independent hashes, and joined on the number.
    Numbering is a bucketed scan over hash ranges, so there is no global sort task.
    """

    def numbered(s: int) -> DataFrame:
        h = F.xxhash64(F.lit(s), *key)
        work = data.withColumns({"_all": F.lit(0), "_h": h, "_b": F.shiftright(h, 52)})
        return with_position(work, ["_all"], ["_h", *key], "_b", "_row").drop("_all", "_h", "_b")

    donors = numbered(2 * seed + 1).select("_row", F.col(VEC).alias("shadow"))
    return numbered(2 * seed).join(donors, "_row").drop("_row")


def shadow_test(data: DataFrame, cols: Sequence[str], key: Sequence[str], classes: bool, rounds: int = 5, trees: int = 40, seed: int = 42) -> DataFrame:
    """Share of rounds in which a feature beats the best of the shuffled copies."""
    wins = np.zeros(len(cols))
    for i in range(rounds):
        both = shuffled_vectors(data, key, seed + i)
        both = VectorAssembler(inputCols=[VEC, "shadow"], outputCol="both").transform(both)
        imp = _forest(classes, trees, seed + i, "both").fit(both).featureImportances.toArray()
        wins += imp[: len(cols)] > imp[len(cols) :].max(initial=0.0)
    return data.sparkSession.createDataFrame(
        [(c, float(w / rounds)) for c, w in zip(cols, wins)], "feature string, boruta_keep double"
    )


def linear_path(data: DataFrame, cols: Sequence[str], classes: bool, folds: int = 3, seed: int = 42) -> DataFrame:
    """Absolute standardised coefficients of a cross-validated penalised linear model, capped at the 99th percentile."""
    scaler = StandardScaler(inputCol=VEC, outputCol="scaled", withMean=True)
    scaled = scaler.fit(data).transform(data).select(LABEL, "scaled").cache()
    try:
        if classes:
            est = LogisticRegression(featuresCol="scaled", labelCol=LABEL, elasticNetParam=1.0, maxIter=50)
            grid = ParamGridBuilder().addGrid(est.regParam, [0.1, 0.01, 0.001]).build()
            judge = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="logLoss")
        else:
            est = LinearRegression(featuresCol="scaled", labelCol=LABEL, maxIter=50)
            grid = ParamGridBuilder().addGrid(est.elasticNetParam, [0.1, 0.5, 0.9]).addGrid(est.regParam, [0.1, 0.01]).build()
            judge = RegressionEvaluator(labelCol=LABEL, metricName="rmse")
        cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed, parallelism=4)
        coef = np.abs(cv.fit(scaled).bestModel.coefficients.toArray())
    finally:
        scaled.unpersist()
    coef = np.minimum(coef, np.percentile(coef, 99)) if len(coef) else coef
    return data.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, coef)], "feature string, linear_coef double")


# --- permutation --------------------------------------------------------------------------------


def score_by(df: DataFrame, keys: Sequence[str], classes: bool) -> DataFrame:
    """F1 of the predictions, or minus their RMSE, per key."""
    if not classes:
        e = F.col(PRED) - F.col(LABEL)
        return df.groupBy(*keys).agg((-F.sqrt(F.avg(e * e))).alias("score"))
    yes, y = F.col(PRED) >= 0.5, F.col(LABEL) >= 0.5
    tp2 = 2 * F.count_if(yes & y)
    f1 = ratio(tp2.cast("double"), (tp2 + F.count_if(yes & ~y) + F.count_if(~yes & y)).cast("double"))
    return df.groupBy(*keys).agg(F.coalesce(f1, F.lit(0.0)).alias("score"))


def _repeat_shift(repeat: Column, n: Column, block: int) -> Column:
    """A shift near the block length, drawn per repeat, between 1 and n - 1."""
    noise = F.pmod(F.xxhash64(repeat), F.lit(2001)) / 1000.0 - 1.0
    want = F.floor(F.lit(float(block)) + noise * max(1.0, block * 0.1) * 2)
    return F.greatest(F.lit(1), F.least(n - 1, want)).cast("long")


def cyclic_permutation(model, valid: DataFrame, cols: Sequence[str], group: Sequence[str], order: Sequence[str], bucket: Column, classes: bool, block: int = 24, repeats: int = 5, embargo: int = 0, purge: int = 0) -> DataFrame:
    """Effect of shifting one feature in time inside each group: mean and deviation over repeats.

    All repeats run in one job: each row meets its donor, (position - shift) mod n of its group, by an
    equality join on position; the features then fan out inside the scoring stage and are combined
    map-side, so the fan-out is never shuffled.
    """
    placed = with_position(valid.withColumn("_b", bucket), group, order, "_b", "_row").drop("_b")
    sizes = valid.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(sizes, list(group)).select(*group, "_row", "_n", LABEL, vector_to_array(VEC).alias("_x"))
    inside = (F.col("_row") >= embargo) & (F.col("_row") < F.col("_n") - purge)
    base = score_by(model.transform(placed.filter(inside).withColumn(VEC, array_to_vector("_x"))), [], classes).scalar()

    shifts = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    rows = placed.select("*", shifts).withColumn("_shift", _repeat_shift(F.col("repeat"), F.col("_n"), block))
    rows = rows.withColumn("_donor", F.pmod(F.col("_row") - F.col("_shift"), F.col("_n"))).filter(inside)
    donors = placed.select(*group, F.col("_row").alias("_donor"), F.col("_x").alias("_dx"))
    met = rows.join(donors, [*group, "_donor"])
    j = F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("j")
    fanned = met.select(LABEL, "repeat", "_x", "_dx", j)
    swapped = F.transform("_x", lambda x, i: F.when(i == F.col("j"), F.get(F.col("_dx"), i)).otherwise(x))
    scored = model.transform(fanned.select(LABEL, "repeat", "j", array_to_vector(swapped).alias(VEC)))
    each = score_by(scored, ["j", "repeat"], classes).withColumn("base_score", base)
    each = each.withColumn("delta", F.col("base_score") - F.col("score"))
    names = F.array(*[F.lit(c) for c in cols])
    return each.groupBy(F.get(names, F.col("j")).alias("feature")).agg(
        F.avg("delta").alias("perm_mean"), F.stddev_pop("delta").alias("perm_std"), F.max("base_score").alias("base_score")
    )


def shuffle_permutation(model, valid: DataFrame, cols: Sequence[str], key: Sequence[str], classes: bool, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Effect of shuffling one feature over all rows, with the same fan-out inside the scoring stage."""
    base = score_by(model.transform(valid), [], classes).scalar()
    out = None
    names = F.array(*[F.lit(c) for c in cols])
    for r in range(repeats):
        met = shuffled_vectors(valid, key, seed + r).select(
            LABEL, vector_to_array(VEC).alias("_x"), vector_to_array("shadow").alias("_dx"),
            F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("j"),
        )
        swapped = F.transform("_x", lambda x, i: F.when(i == F.col("j"), F.get(F.col("_dx"), i)).otherwise(x))
        one = score_by(model.transform(met.select(LABEL, "j", array_to_vector(swapped).alias(VEC))), ["j"], classes)
        out = one if out is None else out.unionByName(one)
    each = out.withColumn("base_score", base).withColumn("delta", F.col("base_score") - F.col("score"))
    return each.groupBy(F.get(names, F.col("j")).alias("feature")).agg(
        F.avg("delta").alias("perm_mean"), F.stddev_pop("delta").alias("perm_std"), F.max("base_score").alias("base_score")
    )


# --- subset search ------------------------------------------------------------------------------


def subset_score(train: DataFrame, valid: DataFrame, every: Sequence[str], subset: Sequence[str], targets: Mapping[str, float], trees: int = 20) -> float:
    """Weighted mean over labels of F1 (classes) or -RMSE of a forest on the subset.

    train and valid hold one vector of all features and the label columns; a subset is a slice of it.
    """
    at = [list(every).index(c) for c in subset]
    total = weight = 0.0
    for t, w in targets.items():
        classes = is_class_target(t)
        slicer = VectorSlicer(inputCol="all_features", outputCol=VEC, indices=at)
        known = lambda d: slicer.transform(d.withColumn(LABEL, F.coalesce(F.col(t).cast("double"), F.lit(0.0))))  # noqa: E731, B023
        model = _forest(classes, trees, 42).fit(known(train))
        total += w * score_by(model.transform(known(valid)), [], classes).first()["score"]
        weight += w
    return total / weight if weight else float("-inf")


def with_all_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    return VectorAssembler(inputCols=list(cols), outputCol="all_features").transform(filled)


def backward_elimination(train: DataFrame, valid: DataFrame, pool: Sequence[str], targets: Mapping[str, float], trees: int = 20, max_rounds: int | None = None) -> tuple[list[str], float]:
    """Drop one of the weakest twentieth of features while that improves the score."""
    train, valid = with_all_features(train, pool).cache(), with_all_features(valid, pool).cache()
    try:
        keep = list(pool)
        best = subset_score(train, valid, pool, keep, targets, trees)
        rounds = 0
        while len(keep) > 1 and (max_rounds is None or rounds < max_rounds):
            rounds += 1
            first = next(iter(targets))
            at = [list(pool).index(c) for c in keep]
            data = VectorSlicer(inputCol="all_features", outputCol=VEC, indices=at).transform(
                train.withColumn(LABEL, F.coalesce(F.col(first).cast("double"), F.lit(0.0)))
            )
            imp = _forest(False, trees, 0).fit(data).featureImportances.toArray()
            weakest = [keep[i] for i in np.argsort(imp, kind="stable")[: max(1, len(keep) // 20)]]
            trials = [(subset_score(train, valid, pool, [k for k in keep if k != c], targets, trees), c) for c in weakest]
            score, gone = max(trials)
            if score <= best + 1e-6:
                break
            best, keep = score, [k for k in keep if k != gone]
        return keep, best
    finally:
        train.unpersist()
        valid.unpersist()


def rolling_validation(rows: DataFrame, cols: Sequence[str], targets: Mapping[str, float], trees: int = 20) -> DataFrame:
    """Subset score of each fold of `rolling_folds` output, as (period, fold, score)."""
    data = with_all_features(rows, cols).cache()
    try:
        folds = data.select("period", "fold").distinct().orderBy("period", "fold").collect()
        out = []
        for f in folds:
            one = data.filter((F.col("period") == f["period"]) & (F.col("fold") == f["fold"]))
            score = subset_score(one.filter(~F.col("is_val")), one.filter("is_val"), cols, cols, targets, trees)
            out.append((f["period"], int(f["fold"]), float(score)))
    finally:
        data.unpersist()
    return rows.sparkSession.createDataFrame(out, "period string, fold int, score double")


def validation_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("period").agg(F.count(F.lit(1)).alias("folds"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"))


# --- stacking -----------------------------------------------------------------------------------


def fit_stack(train: DataFrame, features: Sequence[str], target: str, classes: bool):
    """Scaler and logistic model, or scaler and boosted trees for regression labels."""
    filled = train.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in features}).withColumn(LABEL, F.col(target).cast("double"))
    final = (
        LogisticRegression(featuresCol=VEC, labelCol=LABEL, maxIter=100)
        if classes
        else GBTRegressor(featuresCol=VEC, labelCol=LABEL, maxIter=20, seed=42)
    )
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol=VEC, withMean=True), final]
    return Pipeline(stages=stages).fit(filled)


def predict_stack(model, df: DataFrame, features: Sequence[str], classes: bool, out: str = "model") -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in features})
    scored = model.transform(filled)
    value = F.get(vector_to_array("probability"), F.lit(1)) if classes else F.col(PRED)
    return scored.withColumn(out, value).select(*df.columns, out)


def temperature(df: DataFrame, logit: str, label: str) -> float:
    """The one temperature that minimises cross-entropy: the inverse slope of a logistic model on the
    logit without intercept."""
    data = VectorAssembler(inputCols=[logit], outputCol=VEC).transform(df.select(logit, F.col(label).cast("double").alias(LABEL)))
    model = LogisticRegression(featuresCol=VEC, labelCol=LABEL, fitIntercept=False, standardization=False, maxIter=200, tol=1e-12).fit(data)
    return 1.0 / float(model.coefficients[0])


def scaled_probability(logit: Column, t: float) -> Column:
    return 1 / (1 + F.exp(-logit / t))


def evidence_for(train: DataFrame, valid: DataFrame, cols: Sequence[str], target: str, key: Sequence[str], trees: int = 40, repeats: int = 3, rounds: int = 3) -> DataFrame:
    """One label's evidence: tree importance, permutation effect, shadow share and linear coefficient per feature."""
    classes = is_class_target(target)
    train, valid = impute_median(train, [valid], cols)
    tr, va = vector_table(train, cols, target, key).cache(), vector_table(valid, cols, target, key).cache()
    try:
        model = _forest(classes, trees, 42).fit(tr)
        imp = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
        tree = train.sparkSession.createDataFrame(imp, "feature string, tree_importance double")
        perm = shuffle_permutation(model, va, cols, key, classes, repeats)
        rows = perm.collect()  # one row per feature
        perm = train.sparkSession.createDataFrame(rows, perm.schema)
        shadow = shadow_test(tr, cols, key, classes, rounds, trees)
        linear = linear_path(tr, cols, classes)
        return tree.join(perm, "feature").join(shadow, "feature").join(linear, "feature").withColumn("target", F.lit(target))
    finally:
        tr.unpersist()
        va.unpersist()
