"""Ranks, screening, evidence, metrics and models on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import audits, evidence, metrics, models, ranks, screening, stacking


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 5))
    p = pd.DataFrame(x, columns=[f"f{i}" for i in range(5)])
    p["target_binarytrend"] = (p["f0"] + 0.1 * rng.normal(size=300) > 0).astype(int)
    p["y"] = 2 * p["f0"] + 0.1 * rng.normal(size=300)
    p["copy"] = p["f1"] * 3
    p["id"] = np.arange(300)
    return p, spark.createDataFrame(p).repartition(4).cache()


def test_ranks_and_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"g": rng.integers(0, 3, 900), "v": rng.integers(0, 200, 900).astype(float)})
    p.loc[p.index % 3 == 0, "v"] = 77.0  # a third of the rows share one value
    p.loc[5, "v"] = np.nan
    df = spark.createDataFrame(p).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = ranks.with_average_rank(df, ["g"], "v").toPandas()
    want = p.assign(rank=p.groupby("g")["v"].rank())
    cols = ["g", "v", "rank"]
    pd.testing.assert_frame_equal(
        got[cols].sort_values(cols).reset_index(drop=True), want[cols].sort_values(cols).reset_index(drop=True), check_dtype=False
    )
    q = ranks.exact_quantiles(df, ["g"], "v", [0.005, 0.5, 0.9]).toPandas().set_index("g")
    for i, prob in enumerate((0.005, 0.5, 0.9)):
        np.testing.assert_allclose(q[f"q{i}"].sort_index(), p.groupby("g")["v"].quantile(prob), rtol=1e-12)


def test_inflation_equals_regression(matrix):
    p, df = matrix
    cols = ["f0", "f1", "f2", "y"]
    gram, sums, n = screening.gram_matrix(df, cols)
    x = p[cols].to_numpy()
    want = []
    for i in range(4):
        rest = np.delete(x, i, axis=1)
        beta = np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        ss = ((x[:, i] - rest @ beta) ** 2).sum()
        want.append(1 / (ss / ((x[:, i] - x[:, i].mean()) ** 2).sum()))
    np.testing.assert_allclose(screening.vif(gram, sums, n), want, rtol=1e-6)
    keep, dropped = screening.vif_selection(df, cols, pinned=("y",))
    assert keep == ["f1", "f2", "y"] and dropped[0][0] == "f0"


def test_clusters_and_relevance(matrix):
    p, df = matrix
    cols = ["f0", "f1", "f2", "copy"]
    groups = screening.clusters(screening.correlation_matrix(df, cols), cols)
    clustered = df.sparkSession.createDataFrame(sorted(groups.items()), "feature string, cluster string")
    reps = screening.representatives(clustered, audits.feature_moments(df, cols))
    assert {r["feature"]: r["representative"] for r in reps.collect()} == {"f0": "f0", "f1": "copy", "f2": "f2", "copy": "copy"}
    named = df.sparkSession.createDataFrame([("a_z", "a"), ("a", "b"), ("c", "c")], "feature string, cluster string")
    sizes = df.sparkSession.createDataFrame([("a_z", 0.9, 1.0), ("a", 0.8, 2.0), ("c", 1.0, None)], "feature string, coverage double, variance double")
    shared = {r["feature"]: r["representative"] for r in screening.representatives(named, sizes, ["_z"]).collect()}
    assert shared == {"a_z": "a_z", "a": "a_z", "c": "c"}
    ic = screening.information_coefficient(df, cols, "y").toPandas().set_index("feature")["ic"]
    np.testing.assert_allclose(ic["f0"], p["f0"].rank().corr(p["y"].rank()), rtol=1e-9)
    mi = screening.binned_information(df, cols, "target_binarytrend").toPandas().set_index("feature")["mi"]
    assert mi.idxmax() == "f0"


def test_planted_feature_wins_everywhere(matrix):
    _, df = matrix
    cols = ["f0", "f1", "f2", "f3", "f4"]
    train, valid = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    ev = models.evidence_for(train, valid, cols, "target_binarytrend", ["id"], trees=10, repeats=1, rounds=1).toPandas().set_index("feature")
    for c in ("tree_importance", "perm_mean", "linear_coef", "boruta_keep"):
        assert ev[c].idxmax() == "f0", c
    assert len(ev) == 5


def test_shuffle_is_a_permutation(matrix):
    _, df = matrix
    data = models.vector_table(df, ["f0", "f1"], "y", ["id"])
    out = models.shuffled_vectors(data, ["id"], 3).toPandas()
    a = sorted(tuple(v.toArray()) for v in out["features"])
    b = sorted(tuple(v.toArray()) for v in out["shadow"])
    assert a == b and len(out) == 300
    assert sum((x.toArray() != y.toArray()).any() for x, y in zip(out["features"], out["shadow"])) > 250


def test_metrics_with_ties_and_edges(spark):
    p = pd.DataFrame({"g": ["a"] * 6 + ["b"] * 2, "prob": [0.0, 0.5, 0.5, 0.5, 1.0, 0.2, 0.3, 0.4], "label": [0, 1, 0, 1, 1, 0, 1, 1]})
    df = spark.createDataFrame(p)
    ap = {r["g"]: r["pr_auc"] for r in metrics.average_precision(df, ["g"], "prob", "label").collect()}
    # thresholds 1.0, 0.5, 0.2, 0.0: gains 1/3 at precision 1 and 2/3 at precision 3/4
    assert ap["a"] == pytest.approx(1 / 3 + 2 / 3 * 0.75) and ap["b"] is None
    bins = metrics.calibration_bins(df.filter("g = 'a'"), [], "prob", "label", 10).toPandas()
    assert bins["n"].sum() == 5  # zero falls in no bin
    assert set(bins["bin"]) == {2, 5, 10}
    auc = metrics.roc_auc(df.filter("g = 'a'"), ["g"], "prob", "label").first()["roc_auc"]
    assert auc == pytest.approx((3 + 2 * (2 + 0.5)) / 9)


def test_temperature(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z / 2))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"z": z, "y": y}))
    assert models.temperature(df, "z", "y") == pytest.approx(2.0, abs=0.2)


def test_unified_core_gates(spark):
    rows = [(f, p, "t", v, 0.1 * i) for p in ("1h", "4h") for i, (f, v) in enumerate([("a", 3.0), ("b", 2.0), ("c", 1.0)])]
    pairs = evidence.pair_metrics(spark.createDataFrame(rows, "feature string, period string, target string, tree_importance double, perm_mean double"))
    core = evidence.unified_core(pairs, topk=2, topk_per_pair=1, min_appear_rate=0.0).toPandas().set_index("feature")
    assert core["keep"].sum() == 2
    assert core["appear_rate"].max() == 1.0


def test_versions_must_agree(spark):
    ok = spark.createDataFrame([("s", "d", "e", "w")], "schema_ver string, data_ver string, expert_ver string, train_window_id string")
    assert stacking.consistent_versions(ok)["data_ver"] == "d"
    with pytest.raises(ValueError):
        stacking.consistent_versions(ok.unionByName(ok.withColumn("data_ver", F.lit("x"))))
