"""Evidence tables: one row per (feature, period, target), ranked, merged and exported.

These tables have as many rows as there are columns and labels, so windows over a (period, target)
pair hold one row per feature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.nulls import ratio
from barloom.operators.ranks import group_rank
from barloom.operators.splits import top_k_per_group

PAIR = ("period", "target")


def rank_score(rank: str, n: Column) -> Column:
    """1 for the best rank down to 0 for the last."""
    return 1.0 - (F.col(rank) - 1.0) / F.when(n > 1, n - 1.0).otherwise(1.0)


def _pair_size() -> Column:
    return F.count("feature").over(Window.partitionBy(*PAIR)).cast("double")


def pair_metrics(ev: DataFrame) -> DataFrame:
    """Tree and permutation ranks inside each pair, their scores and the local score."""
    if "delta_metric" not in ev.columns:
        ev = ev.withColumn("delta_metric", F.col("perm_mean"))
    out = group_rank(ev, PAIR, "tree_importance", "tree_rank")
    out = group_rank(out, PAIR, "delta_metric", "perm_rank").withColumn("_n", _pair_size())
    n = F.col("_n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns({"score_tree": zero(rank_score("tree_rank", n)), "score_perm": zero(rank_score("perm_rank", n)),
                           "rank_avg": 0.5 * (F.col("tree_rank") + F.col("perm_rank"))})
    return out.withColumns(
        {"score_local": 0.5 * F.col("score_tree") + 0.5 * F.col("score_perm"), "rank_pct": F.col("rank_avg") / n}
    ).drop("_n")


def permutation_interval(ev: DataFrame, repeats: int) -> DataFrame:
    """95 % interval of the mean permutation effect."""
    se = F.col("perm_std") / (max(1, repeats) ** 0.5)
    return ev.withColumns({"perm_ci95_low": F.col("perm_mean") - 1.96 * se, "perm_ci95_high": F.col("perm_mean") + 1.96 * se})


def embedded_score(ev: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted mean of rank scores (tree, linear, external) and the shadow-test share."""
    w = {"tree": 1.0, "linear": 1.0, "boruta": 1.0, "shap": 1.0, "vsn": 1.0, **(weights or {})}
    sources = {"tree": "tree_importance", "linear": "linear_coef", "shap": "shap_value", "vsn": "tft_vsn_importance"}
    present = {k: c for k, c in sources.items() if c in ev.columns}
    out = ev
    for k, c in present.items():
        out = group_rank(out, PAIR, c, f"_rank_{k}")
    out = out.withColumn("_n", _pair_size())
    score = {k: rank_score(f"_rank_{k}", F.col("_n")) for k in present}
    score["boruta"] = F.coalesce(F.col("boruta_keep"), F.lit(0.0))
    # a source that is absent altogether still weighs in with zero
    total = sum((w[k] * s for k, s in score.items()), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), F.lit(w[k])).otherwise(0.0) for k, s in score.items()), F.lit(0.0))
    weight = weight + sum(w[k] for k in w if k not in score)
    return out.withColumn("score_embedded", F.coalesce(ratio(total, weight), F.lit(0.0))).drop(
        "_n", *[f"_rank_{k}" for k in present]
    )


def with_external(ev: DataFrame, external: DataFrame, name: str) -> DataFrame:
    """Join a (feature, score) table as another kind of evidence."""
    return ev.join(external.select("feature", F.col("score").alias(name)), "feature", "left")


def unified_core(
    pairs: DataFrame,
    topk: int | None,
    weights: Mapping[str, float] | None = None,
    topk_per_pair: int | None = None,
    min_appear_rate: float | None = None,
    min_appear_rate_era: float | None = None,
    bonus: DataFrame | None = None,
    bonus_weight: float = 0.0,
) -> DataFrame:
    """One score per feature over all pairs, appearance gates, rank and keep flag (of the best topk; None keeps all)."""
    local = pairs.withColumn("score_local", F.coalesce("score_local", F.lit(0.0)))
    w = F.lit(1.0)
    for t, v in (weights or {}).items():
        w = F.when(F.col("target") == t, F.lit(float(v))).otherwise(w)
    by_target = local.groupBy("feature", "target").agg(F.avg("score_local").alias("_s")).withColumn("_w", w)
    core = by_target.groupBy("feature").agg(
        (F.sum(F.col("_s") * F.col("_w")) / F.greatest(F.lit(1e-8), F.sum("_w"))).alias("score_global")
    )
    ranks = pairs.groupBy("feature").agg(
        F.avg("rank_pct").alias("avg_rank_pct"), F.stddev_samp("rank_pct").alias("std_rank_pct"), F.count("rank_pct").alias("pair_coverage")
    )
    core = core.join(ranks, "feature", "left")
    if bonus is not None and bonus_weight > 0:
        every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        lo, hi = F.min("score").over(every), F.max("score").over(every)
        scaled = bonus.select("feature", ((F.col("score") - lo) / F.greatest(F.lit(1e-8), hi - lo)).alias("_b"))
        core = core.join(scaled, "feature", "left").withColumn(
            "score_global", F.col("score_global") + bonus_weight * F.coalesce("_b", F.lit(0.0))
        ).drop("_b")
    if topk_per_pair:
        top = top_k_per_group(local, PAIR, "score_local", topk_per_pair, ["feature"]).select("feature", *PAIR).distinct()
        n_pairs = top.agg(F.count_distinct(*PAIR)).scalar()
        seen = top.groupBy("feature").agg(F.count(F.lit(1)).alias("_c"))
        core = core.join(seen, "feature", "left").withColumn("appear_rate", F.coalesce(F.col("_c") / n_pairs, F.lit(0.0))).drop("_c")
        if min_appear_rate is not None:
            core = core.filter(F.col("appear_rate") >= min_appear_rate)
    else:
        core = core.withColumn("appear_rate", F.lit(None).cast("double"))
    if "era" in pairs.columns:
        n_eras = pairs.agg(F.count_distinct("era")).scalar()
        eras = pairs.groupBy("feature").agg(F.count_distinct("era").alias("_e"))
        core = core.join(eras, "feature", "left").withColumn("appear_rate_era", F.coalesce(F.col("_e") / n_eras, F.lit(0.0))).drop("_e")
        if min_appear_rate_era is not None:
            core = core.filter(F.col("appear_rate_era") >= min_appear_rate_era)
    else:
        core = core.withColumn("appear_rate_era", F.lit(None).cast("double"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score_global"), "feature")  # one row per feature
    return core.withColumn("rank", F.row_number().over(order)).withColumn("keep", F.lit(True) if topk is None else F.col("rank") <= topk)


def boost_features(core: DataFrame, pairs: DataFrame, prefixes: Sequence[str], limit: int) -> DataFrame:
    """Per pair the best prefixed features that are not in the core."""
    named = reduce(lambda a, b: a | b, [F.col("feature").startswith(p) for p in prefixes])
    rest = pairs.filter(named).join(core.filter("keep").select("feature"), "feature", "left_anti")
    return top_k_per_group(rest, PAIR, "score_local", limit, ["feature"]).select(*PAIR, "feature", "score_local")


def metric_to_unit(score: Column) -> Column:
    """Validation metric to [0, 1]: F1 as it is, a negative RMSE as 1 / (1 + rmse), unknown as a half."""
    return (
        F.when(score.isNull(), 0.5)
        .when(score >= 0, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
        .otherwise(1.0 / (1.0 - score))
    )


def fuse_channels(base: DataFrame, rich: DataFrame, quality: Mapping[str, float] | None = None) -> DataFrame:
    """Base and rich scores weighted by each channel's validation metric and the period's rich quality.

    Where both channels have an era, scores meet and are ranked within it, and it stays.
    """
    era = [c for c in ("era",) if c in base.columns and c in rich.columns]
    keys = ["feature", *PAIR, *era]

    def pair_metric(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*PAIR).agg(metric_to_unit(F.max("base_score")).alias(name))

    metrics = pair_metric(base, "base_metric").join(pair_metric(rich, "rich_metric"), list(PAIR), "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    q = F.lit(1.0)
    for period, v in (quality or {}).items():
        q = F.when(F.col("period") == period, F.lit(float(v))).otherwise(q)
    share = zero("rich_metric") / F.greatest(F.lit(1e-8), zero("base_metric") + zero("rich_metric"))
    metrics = metrics.select(
        *PAIR, zero("base_metric").alias("base_metric"), zero("rich_metric").alias("rich_metric"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), share * q)).alias("w_rich"),
    ).withColumn("w_base", 1.0 - F.col("w_rich"))
    b = base.select(*keys, F.col("score_local").alias("score_base"))
    r = rich.select(*keys, F.col("score_local").alias("score_rich"))
    both = b.join(r, keys, "full_outer").join(metrics, list(PAIR))
    fused = both.select(
        *keys, zero("score_base").alias("score_base"), zero("score_rich").alias("score_rich"),
        "w_base", "w_rich", "base_metric", "rich_metric",
    ).withColumn("score_local", F.col("w_base") * F.col("score_base") + F.col("w_rich") * F.col("score_rich"))
    ranked = group_rank(fused, [*PAIR, *era], "score_local", "_rank").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*PAIR, *era)))
    return ranked.withColumn("rank_pct", F.col("_rank") / F.col("_n")).drop("_rank", "_n")


def common_features(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features present in every list; a list is one combination of the key columns."""
    n = lists.agg(F.count_distinct(*keys)).scalar()
    return lists.groupBy("feature").agg(F.count_distinct(*keys).alias("lists")).filter(F.col("lists") == n)


def union_targets(lists: DataFrame) -> DataFrame:
    return lists.select("target").distinct()


def core_with_pinned(core: DataFrame, pinned: Sequence[str]) -> DataFrame:
    """Core features and pinned ones, told apart."""
    names = core.filter("keep").select("feature", F.lit("core").alias("origin"))
    extra = core.sparkSession.createDataFrame([(p, "pinned") for p in pinned], "feature string, origin string")
    return names.unionByName(extra.join(names, "feature", "left_anti"))


def beyond_core(chosen: DataFrame, core: DataFrame) -> DataFrame:
    """Features chosen somewhere but not in the core."""
    return chosen.select("feature").distinct().exceptAll(core.filter("keep").select("feature"))
