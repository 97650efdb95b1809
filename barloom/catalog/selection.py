"""Screening statistics and evidence tables on the embedding features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.catalog.tables import settle_sql, settled, table
from barloom.operators import audits, evidence, ranks, screening

QUERIES: dict = {}
ORACLE: dict = {}
F64 = [f"f{i}" for i in range(64)]
EXTRA = ["f_planted", "f_const", "f_copy_20", "f_sparse"]
ALL = [*F64, *EXTRA]
DENSE = [*F64, "f_planted", "f_copy_20"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def matrix(spark, sf) -> DataFrame:
    """f0..f63 of the vectors, a feature that follows the label, a constant, a copy and a sparse one."""
    em = table(spark, sf, "embeddings")
    cols = [F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(64)]
    df = em.select("vec_id", "label", *cols)
    return df.withColumns(
        {
            "target_binarytrend": (F.col("label") == 0).cast("int"),
            "f_planted": (F.col("label") == 0).cast("double") + F.col("f3") / 4,
            "f_const": F.lit(1.0),
            "f_copy_20": F.col("f1") * 2 + 1,
            "f_sparse": F.when(F.col("vec_id") % 10 == 0, F.col("f2")),
        }
    )


MATRIX_SQL = "m AS (SELECT vec_id, label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64)
) + """ FROM embeddings),
x AS (SELECT *, CAST(label = 0 AS INT) AS target_binarytrend, CAST(label = 0 AS DOUBLE) + 0.0 + CASE WHEN true THEN f3 / 4 END AS f_planted, 1.0::DOUBLE AS f_const,
f1 * 2 + 1 AS f_copy_20, CASE WHEN vec_id % 10 = 0 THEN f2 END AS f_sparse FROM m)""".replace(
    "CAST(label = 0 AS DOUBLE) + 0.0", "CAST(CAST(label = 0 AS INT) AS DOUBLE)"
).replace("CASE WHEN true THEN f3 / 4 END", "f3 / 4")


def tall_sql(cols, name="l") -> str:
    return f"{name} AS (UNPIVOT (SELECT vec_id, label, target_binarytrend, {', '.join(cols)} FROM x) ON {', '.join(cols)} INTO NAME feature VALUE value)"


def moments_sql(cols=ALL) -> str:
    return "mo AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) / count(*) AS coverage, var_samp({c}) AS variance FROM x" for c in cols
    ) + ")"


@query
def coverage_variance_gate(spark, sf):
    moments = audits.feature_moments(matrix(spark, sf), ALL)
    out = screening.gate(moments, pinned=["f_const"], rich_prefixes=("f_sp",)).withColumn("keep", F.col("keep").cast("int"))
    return settled(out, ["feature", "reason", "keep"])


ORACLE["coverage_variance_gate"] = f"""WITH {MATRIX_SQL}, {moments_sql()},
g AS (SELECT *, CASE WHEN feature = 'f_const' THEN NULL WHEN coverage < CASE WHEN feature LIKE 'f_sp%' THEN 0.3 ELSE 0.6 END THEN 'coverage' WHEN NOT (variance >= 1e-8) THEN 'variance' END AS reason FROM mo)
SELECT feature, reason, CAST(reason IS NULL AS INT) AS keep, {settle_sql('coverage')}, {settle_sql('variance')} FROM g"""


@query
def family_dedup(spark, sf):
    """f_copy_20 strips to f_copy; f1 … f63 have no tail to strip."""
    df = matrix(spark, sf).withColumns({"f_copy": F.col("f1"), "f_copy_ewma_5_20": F.col("f2"), "f_copy_24h": F.col("f_sparse")})
    moments = audits.feature_moments(df, [*DENSE, "f_copy", "f_copy_ewma_5_20", "f_copy_24h"])
    out = screening.family_dedup(moments).withColumn("keep", F.col("keep").cast("int"))
    return out.select("feature", "family", "keep")


ORACLE["family_dedup"] = f"""WITH {MATRIX_SQL}, y AS (SELECT *, f1 AS f_copy, f2 AS f_copy_ewma_5_20, f_sparse AS f_copy_24h FROM x),
{moments_sql([*DENSE, 'f_copy', 'f_copy_ewma_5_20', 'f_copy_24h']).replace('FROM x', 'FROM y')},
f AS (SELECT *, CASE WHEN feature LIKE 'f_copy%' THEN 'f_copy' ELSE feature END AS family FROM mo)
SELECT feature, family, CAST(row_number() OVER (PARTITION BY family ORDER BY coverage DESC, variance DESC, feature) = 1 AS INT) AS keep FROM f"""


@query
def median_imputation(spark, sf):
    df = matrix(spark, sf)
    train, val = df.filter("vec_id % 2 = 0"), df.filter("vec_id % 2 = 1")
    a, b = screening.impute_median(train, [val], ["f_sparse", "f0"])
    return settled(a.unionByName(b).select("vec_id", "f_sparse", "f0"), ["vec_id"])


ORACLE["median_imputation"] = f"""WITH {MATRIX_SQL}, md AS (SELECT median(f_sparse) FILTER (WHERE vec_id % 2 = 0) AS a FROM x),
i AS (SELECT vec_id, coalesce(f_sparse, a) AS f_sparse, f0 FROM x, md) SELECT vec_id, {settle_sql('f_sparse')}, {settle_sql('f0')} FROM i"""


@query
def feature_medians(spark, sf):
    return settled(ranks.column_medians(matrix(spark, sf), ALL), ["feature"])


ORACLE["feature_medians"] = f"WITH {MATRIX_SQL}, u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, median({c}) AS median FROM x" for c in ALL
) + f") SELECT feature, {settle_sql('median')} FROM u"


@query
def information_coefficient(spark, sf):
    return settled(screening.information_coefficient(matrix(spark, sf), DENSE, "label"), ["feature"])


RANKED = """rk AS (SELECT feature, vec_id, label, target_binarytrend, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY feature ORDER BY label) + (count(*) OVER (PARTITION BY feature, label) - 1) / 2.0 AS ry, count(*) OVER (PARTITION BY feature) AS n FROM l)"""
ORACLE["information_coefficient"] = f"""WITH {MATRIX_SQL}, {tall_sql(DENSE)}, {RANKED}, c AS (SELECT feature, corr(rx, ry) AS ic FROM rk GROUP BY 1)
SELECT feature, {settle_sql('ic')} FROM c"""


@query
def binned_information(spark, sf):
    return settled(screening.binned_information(matrix(spark, sf), DENSE, "target_binarytrend"), ["feature"])


ORACLE["binned_information"] = f"""WITH {MATRIX_SQL}, {tall_sql(DENSE)}, {RANKED},
b AS (SELECT feature, least(floor((rx - 0.5) / n * 10), 9) AS bin, target_binarytrend AS c, count(*) AS k FROM rk GROUP BY ALL),
t AS (SELECT *, sum(k) OVER (PARTITION BY feature) AS a, sum(k) OVER (PARTITION BY feature, bin) AS kb, sum(k) OVER (PARTITION BY feature, c) AS kc FROM b),
r AS (SELECT feature, sum(k / a * ln(CAST(k AS DOUBLE) * a / (kb * kc))) AS mi FROM t GROUP BY 1) SELECT feature, {settle_sql('mi')} FROM r"""


@query
def relevance_by_target_kind(spark, sf):
    """Information for the class label, rank correlation for the other one."""
    return settled(screening.relevance(matrix(spark, sf), ["f0", "f_planted"], ["target_binarytrend", "label"]), ["feature", "target", "metric"])


ORACLE["relevance_by_target_kind"] = f"""WITH {MATRIX_SQL}, {tall_sql(['f0', 'f_planted'])}, {RANKED},
b AS (SELECT feature, least(floor((rx - 0.5) / n * 10), 9) AS bin, target_binarytrend AS c, count(*) AS k FROM rk GROUP BY ALL),
t AS (SELECT *, sum(k) OVER (PARTITION BY feature) AS a, sum(k) OVER (PARTITION BY feature, bin) AS kb, sum(k) OVER (PARTITION BY feature, c) AS kc FROM b),
r AS (SELECT feature, 'target_binarytrend' AS target, 'mi' AS metric, sum(k / a * ln(CAST(k AS DOUBLE) * a / (kb * kc))) AS v FROM t GROUP BY 1
UNION ALL SELECT feature, 'label', 'ic', corr(rx, ry) FROM rk GROUP BY 1) SELECT feature, target, metric, {settle_sql('v', 'value')} FROM r"""

PAIRS = """pr AS (SELECT a.feature AS a, b.feature AS b, corr({x}, {y}) AS rho FROM {s} a JOIN {s} b ON a.vec_id = b.vec_id AND a.ord < b.ord GROUP BY 1, 2)"""


def _ord(cols):
    return "o AS (SELECT *, list_position([" + ", ".join(f"'{c}'" for c in cols) + "], feature) AS ord FROM rk)"


@query
def strong_rank_correlations(spark, sf):
    """Pairs of features with a rank correlation of at least a fifth."""
    out = screening.correlation_pairs(matrix(spark, sf), DENSE, "spearman", 0.2)
    return settled(out, ["a", "b"])


ORACLE["strong_rank_correlations"] = f"""WITH {MATRIX_SQL}, {tall_sql(DENSE)}, {RANKED}, {_ord(DENSE)}, {PAIRS.format(x='a.rx', y='b.rx', s='o')}
SELECT a, b, {settle_sql('rho')} FROM pr WHERE abs(rho) >= 0.2"""


@query
def top_linear_correlations(spark, sf):
    """The ten strongest linear correlations of the upper triangle."""
    return settled(screening.correlation_pairs(matrix(spark, sf), DENSE, "pearson", top=10), ["a", "b"])


ORACLE["top_linear_correlations"] = f"""WITH {MATRIX_SQL}, {tall_sql(DENSE)}, {RANKED}, {_ord(DENSE)}, {PAIRS.format(x='a.value', y='b.value', s='o')},
t AS (SELECT * FROM pr ORDER BY abs(rho) DESC, a, b LIMIT 10) SELECT a, b, {settle_sql('rho')} FROM t"""


@query
def cluster_representatives(spark, sf):
    """Features to the representative of their cluster at a rank correlation of 0.97."""
    df = matrix(spark, sf)
    groups = screening.clusters(screening.correlation_matrix(df, DENSE), DENSE)
    clustered = spark.createDataFrame(sorted(groups.items()), "feature string, cluster string")
    return screening.representatives(clustered, audits.feature_moments(df, DENSE))


ORACLE["cluster_representatives"] = f"""WITH RECURSIVE {MATRIX_SQL}, {tall_sql(DENSE)}, {RANKED}, {_ord(DENSE)}, {PAIRS.format(x='a.rx', y='b.rx', s='o')}, {moments_sql(DENSE)},
e AS (SELECT a, b FROM pr WHERE abs(rho) >= 0.97 UNION SELECT b, a FROM pr WHERE abs(rho) >= 0.97 UNION SELECT feature, feature FROM mo),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
best AS (SELECT r.a AS feature, first(mo.feature ORDER BY coverage DESC, variance DESC, mo.feature) AS representative FROM reach r JOIN mo ON mo.feature = r.b GROUP BY 1)
SELECT feature, representative FROM best"""


@query
def vif_selection(spark, sf):
    """Features left after iterative variance-inflation pruning, and those dropped with their value."""
    keep, dropped = screening.vif_selection(matrix(spark, sf), DENSE)
    rows = [(k, "keep", None) for k in keep] + [(f, "drop", v) for f, v in dropped]
    return spark.createDataFrame(rows, "feature string, verdict string, vif double")


# --- evidence -----------------------------------------------------------------------------------


def evidence_rows(spark, sf) -> DataFrame:
    """Per feature and label class: evidence numbers made from the class statistics of the vectors."""
    df = matrix(spark, sf)
    rows = ranks.long_form(df, ["label"], F64)
    period = F.element_at(F.array(F.lit("1h"), F.lit("4h"), F.lit("1d")), (F.col("label") % 3 + 1).cast("int"))
    return rows.groupBy("feature", "label").agg(
        F.abs(F.avg("value")).alias("tree_importance"),
        (F.stddev_samp("value") - 0.1).alias("perm_mean"),
        F.var_samp("value").alias("perm_std"),
        F.max("value").alias("linear_coef"),
        F.min("value").alias("low"),
    ).select(
        "feature", period.alias("period"), F.concat(F.lit("t"), F.floor(F.col("label") / 3).cast("string")).alias("target"),
        "tree_importance", "perm_mean", "perm_std", "linear_coef",
        (F.col("low") > -0.3).cast("double").alias("boruta_keep"),
        F.when(F.col("label") < 5, F.col("label") / 10.0).otherwise(-F.col("label") / 10.0).alias("base_score"),
        F.when(F.col("label") < 4, "2023").otherwise("2024").alias("era"),
    )


EV_SQL = f"""{MATRIX_SQL}, {tall_sql(F64)}, g AS (SELECT feature, label, abs(avg(value)) AS tree_importance, stddev_samp(value) - 0.1 AS perm_mean, var_samp(value) AS perm_std,
max(value) AS linear_coef, CAST(CAST(min(value) > -0.3 AS INT) AS DOUBLE) AS boruta_keep FROM l GROUP BY 1, 2),
ev AS (SELECT feature, ['1h', '4h', '1d'][label % 3 + 1] AS period, 't' || CAST(label // 3 AS VARCHAR) AS target, tree_importance, perm_mean, perm_std, linear_coef, boruta_keep,
CASE WHEN label < 5 THEN label / 10.0 ELSE -label / 10.0 END AS base_score, CASE WHEN label < 4 THEN '2023' ELSE '2024' END AS era FROM g)"""


def _avg_rank(c):
    return f"rank() OVER (PARTITION BY period, target ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY period, target, {c}) - 1) / 2.0"


PM_SQL = f"""pm0 AS (SELECT *, {_avg_rank('tree_importance')} AS tree_rank, {_avg_rank('perm_mean')} AS perm_rank, count(*) OVER (PARTITION BY period, target) AS n FROM ev),
pm AS (SELECT *, 1 - (tree_rank - 1) / (n - 1) AS score_tree, 1 - (perm_rank - 1) / (n - 1) AS score_perm, 0.5 * (tree_rank + perm_rank) AS rank_avg,
0.5 * (1 - (tree_rank - 1) / (n - 1)) + 0.5 * (1 - (perm_rank - 1) / (n - 1)) AS score_local, 0.5 * (tree_rank + perm_rank) / n AS rank_pct FROM pm0)"""
_EK = ["feature", "period", "target"]


@query
def pair_metrics(spark, sf):
    cols = ["tree_rank", "perm_rank", "score_tree", "score_perm", "score_local", "rank_pct"]
    return settled(evidence.pair_metrics(evidence_rows(spark, sf)), _EK, cols)


ORACLE["pair_metrics"] = f"WITH {EV_SQL}, {PM_SQL} SELECT feature, period, target, " + ", ".join(
    settle_sql(c) for c in ("tree_rank", "perm_rank", "score_tree", "score_perm", "score_local", "rank_pct")
) + " FROM pm"


@query
def permutation_interval(spark, sf):
    return settled(evidence.permutation_interval(evidence_rows(spark, sf), 5), _EK, ["perm_ci95_low", "perm_ci95_high"])


ORACLE["permutation_interval"] = f"""WITH {EV_SQL}, c AS (SELECT *, perm_mean - 1.96 * perm_std / sqrt(5) AS lo, perm_mean + 1.96 * perm_std / sqrt(5) AS hi FROM ev)
SELECT feature, period, target, {settle_sql('lo', 'perm_ci95_low')}, {settle_sql('hi', 'perm_ci95_high')} FROM c"""


@query
def embedded_score(spark, sf):
    """Tree, linear and shadow evidence with an external score table joined in."""
    ev = evidence_rows(spark, sf)
    ext = ev.groupBy("feature").agg(F.sum("perm_mean").alias("score"))
    out = evidence.embedded_score(evidence.with_external(ev, ext, "tft_vsn_importance"), {"tree": 2.0})
    return settled(out, _EK, ["tft_vsn_importance", "score_embedded"])


ORACLE["embedded_score"] = f"""WITH {EV_SQL}, e AS (SELECT feature, sum(perm_mean) AS v FROM ev GROUP BY 1), j AS (SELECT ev.*, v FROM ev JOIN e USING (feature)),
r AS (SELECT *, {_avg_rank('tree_importance')} AS a, {_avg_rank('linear_coef')} AS b, {_avg_rank('v')} AS c, count(*) OVER (PARTITION BY period, target) AS n FROM j),
s AS (SELECT *, (2 * (1 - (a - 1) / (n - 1)) + (1 - (b - 1) / (n - 1)) + boruta_keep + (1 - (c - 1) / (n - 1))) / 6 AS sc FROM r)
SELECT feature, period, target, {settle_sql('v', 'tft_vsn_importance')}, {settle_sql('sc', 'score_embedded')} FROM s"""


@query
def unified_core(spark, sf):
    pairs = evidence.pair_metrics(evidence_rows(spark, sf))
    bonus = pairs.groupBy("feature").agg(F.max("linear_coef").alias("score"))
    out = evidence.unified_core(pairs, topk=20, weights={"t0": 2.0}, topk_per_pair=16, min_appear_rate=0.2, min_appear_rate_era=0.5, bonus=bonus, bonus_weight=0.1)
    out = out.withColumns({"keep": F.col("keep").cast("int"), "rank": F.col("rank").cast("int")})
    return settled(out, ["feature", "rank", "keep", "pair_coverage"])


CORE_SQL = f"""{EV_SQL}, {PM_SQL},
st AS (SELECT feature, target, avg(score_local) AS s, CASE WHEN target = 't0' THEN 2.0 ELSE 1.0 END AS w FROM pm GROUP BY 1, 2),
sg AS (SELECT feature, sum(s * w) / sum(w) AS sg0 FROM st GROUP BY 1),
rs AS (SELECT feature, avg(rank_pct) AS avg_rank_pct, stddev_samp(rank_pct) AS std_rank_pct, count(*) AS pair_coverage, max(linear_coef) AS bs FROM pm GROUP BY 1),
bo AS (SELECT feature, (bs - min(bs) OVER ()) / (max(bs) OVER () - min(bs) OVER ()) AS b FROM rs),
tp AS (SELECT feature, period, target FROM pm QUALIFY row_number() OVER (PARTITION BY period, target ORDER BY score_local DESC, feature) <= 16),
ap AS (SELECT feature, count(*) / (SELECT count(DISTINCT (period, target)) FROM tp) AS appear_rate FROM tp GROUP BY 1),
er AS (SELECT feature, count(DISTINCT era) / (SELECT count(DISTINCT era) FROM pm) AS appear_rate_era FROM pm GROUP BY 1),
co AS (SELECT feature, sg0 + 0.1 * b AS score_global, avg_rank_pct, std_rank_pct, pair_coverage, appear_rate, appear_rate_era FROM sg JOIN rs USING (feature) JOIN bo USING (feature)
JOIN ap USING (feature) JOIN er USING (feature) WHERE appear_rate >= 0.2 AND appear_rate_era >= 0.5),
core AS (SELECT *, row_number() OVER (ORDER BY score_global DESC, feature) AS rk FROM co)"""
ORACLE["unified_core"] = f"WITH {CORE_SQL} SELECT feature, CAST(rk AS INT) AS rank, CAST(rk <= 20 AS INT) AS keep, pair_coverage, " + ", ".join(
    settle_sql(c) for c in ("score_global", "avg_rank_pct", "std_rank_pct", "appear_rate", "appear_rate_era")
) + " FROM core"


def _core(spark, sf):
    pairs = evidence.pair_metrics(evidence_rows(spark, sf))
    return pairs, evidence.unified_core(pairs, topk=20)


@query
def boost_features(spark, sf):
    pairs, core = _core(spark, sf)
    return settled(evidence.boost_features(core, pairs, ["f1", "f2"], 4), _EK)


PLAIN_CORE = f"""{EV_SQL}, {PM_SQL}, st AS (SELECT feature, target, avg(score_local) AS s FROM pm GROUP BY 1, 2), sg AS (SELECT feature, avg(s) AS g FROM st GROUP BY 1),
core AS (SELECT feature FROM sg ORDER BY g DESC, feature LIMIT 20)"""
ORACLE["boost_features"] = f"""WITH {PLAIN_CORE}, r AS (SELECT * FROM pm WHERE (feature LIKE 'f1%' OR feature LIKE 'f2%') AND feature NOT IN (SELECT feature FROM core)
QUALIFY row_number() OVER (PARTITION BY period, target ORDER BY score_local DESC, feature) <= 4) SELECT feature, period, target, {settle_sql('score_local')} FROM r"""


@query
def core_with_pinned(spark, sf):
    return evidence.core_with_pinned(_core(spark, sf)[1], ["f0", "f1", "vwap"])


ORACLE["core_with_pinned"] = f"""WITH {PLAIN_CORE} SELECT feature, 'core' AS origin FROM core UNION ALL
SELECT feature, 'pinned' FROM (VALUES ('f0'), ('f1'), ('vwap')) v(feature) WHERE feature NOT IN (SELECT feature FROM core)"""


@query
def beyond_core(spark, sf):
    from barloom.operators.splits import top_k_per_group

    pairs, core = _core(spark, sf)
    return evidence.beyond_core(top_k_per_group(pairs, evidence.PAIR, "score_local", 8, ["feature"]), core)


ORACLE["beyond_core"] = f"""WITH {PLAIN_CORE} SELECT DISTINCT feature FROM (SELECT feature FROM pm QUALIFY row_number() OVER (PARTITION BY period, target
ORDER BY score_local DESC, feature) <= 8) WHERE feature NOT IN (SELECT feature FROM core)"""


@query
def channel_fusion(spark, sf):
    pairs = evidence.pair_metrics(evidence_rows(spark, sf)).drop("score_tree")
    n = F.substring("feature", 2, 2).cast("int")
    rich = pairs.filter(n >= 24).withColumn("base_score", F.col("base_score") / 2)
    out = evidence.fuse_channels(pairs.filter(n < 40), rich, {"4h": 0.7})
    return settled(out, _EK)


_UNIT = lambda c: f"CASE WHEN {c} IS NULL THEN 0.5 WHEN {c} >= 0 THEN least({c}, 1) ELSE 1 / (1 - {c}) END"
ORACLE["channel_fusion"] = f"""WITH {EV_SQL}, {PM_SQL}, q AS (SELECT *, CAST(substr(feature, 2) AS INT) AS i FROM pm),
w0 AS (SELECT period, target, {_UNIT('max(base_score)')} AS base_metric, {_UNIT('max(base_score / 2)')} AS rich_metric FROM q GROUP BY 1, 2),
w AS (SELECT *, greatest(0, least(1, rich_metric / greatest(1e-8, base_metric + rich_metric) * CASE WHEN period = '4h' THEN 0.7 ELSE 1 END)) AS w_rich FROM w0),
f AS (SELECT feature, q.period, q.target, q.era, CASE WHEN i < 40 THEN score_local ELSE 0 END AS score_base, CASE WHEN i >= 24 THEN score_local ELSE 0 END AS score_rich, w_rich, 1 - w_rich AS w_base, base_metric, rich_metric
FROM q JOIN w ON q.period = w.period AND q.target = w.target),
fz AS (SELECT *, w_base * score_base + w_rich * score_rich AS score_local FROM f),
h AS (SELECT *, ({_avg_rank('score_local')}) / count(*) OVER (PARTITION BY period, target) AS rank_pct FROM fz)
SELECT feature, period, target, era, """ + ", ".join(settle_sql(c) for c in ("score_base", "score_rich", "w_rich", "w_base", "base_metric", "rich_metric", "score_local", "rank_pct")) + " FROM h"


@query
def common_core(spark, sf):
    """Features among the best forty of every pair, and how many lists there are."""
    from barloom.operators.splits import top_k_per_group

    pairs = evidence.pair_metrics(evidence_rows(spark, sf))
    return evidence.common_features(top_k_per_group(pairs, evidence.PAIR, "score_local", 56, ["feature"]), evidence.PAIR)


ORACLE["common_core"] = f"""WITH {EV_SQL}, {PM_SQL}, t AS (SELECT * FROM pm QUALIFY row_number() OVER (PARTITION BY period, target ORDER BY score_local DESC, feature) <= 56)
SELECT feature, count(DISTINCT (period, target)) AS lists FROM t GROUP BY 1 HAVING count(DISTINCT (period, target)) = (SELECT count(DISTINCT (period, target)) FROM t)"""


@query
def union_targets(spark, sf):
    return evidence.union_targets(evidence_rows(spark, sf))


ORACLE["union_targets"] = f"WITH {EV_SQL} SELECT DISTINCT target FROM ev"
