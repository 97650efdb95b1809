"""Feature screening: filter, model evidence per period, aggregation, wrapper search, common core."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from barloom.operators import audits, evidence, models, screening, splits
from barloom.sources.staging import staged


@dataclass(frozen=True)
class ScreeningSettings:
    val_ratio: float = 0.2
    coverage_base: float = 0.6
    coverage_rich: float = 0.3
    variance: float = 1e-8
    corr_threshold: float = 0.97
    vif_threshold: float = 20.0
    topk: int | None = None
    topk_per_pair: int | None = None
    min_appear_rate: float | None = None
    trees: int = 40
    repeats: int = 3
    rounds: int = 3
    wrapper_rounds: int | None = None


def filter_features(df: DataFrame, cols: Sequence[str], pinned: Sequence[str] = (), s: ScreeningSettings = ScreeningSettings()) -> tuple[list[str], DataFrame]:
    """Features left after coverage, variance, family, correlation and inflation; and the verdict table.

    The verdicts are one row per column, so they pass through the driver; the data does not.
    """
    gated = screening.gate(audits.feature_moments(df, cols), s.coverage_base, s.coverage_rich, s.variance, pinned).collect()
    moments = {r["feature"]: (r["coverage"], r["variance"]) for r in gated}
    verdict = {r["feature"]: r["reason"] for r in gated}
    left = [c for c in cols if verdict[c] is None]
    family = screening.family_dedup(df.sparkSession.createDataFrame(
        [(c, float(moments[c][0]), float(moments[c][1] or 0.0)) for c in left], "feature string, coverage double, variance double"
    )).filter("not keep").collect()
    for r in family:
        if r["feature"] not in pinned:
            verdict[r["feature"]] = "family"
    left = [c for c in left if verdict[c] is None]
    filled = staged(screening.impute_median(df, [], left)[0].select(*left), "imputed")
    groups = screening.clusters(screening.correlation_matrix(filled, left), left, s.corr_threshold)
    clustered = df.sparkSession.createDataFrame(sorted(groups.items()), "feature string, cluster string")
    measured = df.sparkSession.createDataFrame([(c, float(moments[c][0]), float(moments[c][1] or 0.0)) for c in left], "feature string, coverage double, variance double")
    for r in screening.representatives(clustered, measured).filter("feature <> representative").collect():
        if r["feature"] not in pinned:
            verdict[r["feature"]] = "correlation"
    left = [c for c in left if verdict[c] is None]
    keep, dropped = screening.vif_selection(filled, left, s.vif_threshold, pinned=pinned)
    verdict.update({c: "inflation" for c, _ in dropped})
    rows = [(c, *map(lambda v: None if v is None else float(v), moments[c]), verdict[c]) for c in cols]
    return keep, df.sparkSession.createDataFrame(rows, "feature string, coverage double, variance double, reason string")


def screen(df: DataFrame, cols: Sequence[str], targets: Sequence[str], key: Sequence[str], pinned: Sequence[str] = (), s: ScreeningSettings = ScreeningSettings()) -> dict[str, DataFrame | list[str]]:
    """Evidence over all periods and targets, the unified core and the wrapper's choice."""
    df = staged(splits.ratio_split(df, s.val_ratio), "split")
    train, valid = df.filter(~F.col("is_val")), df.filter("is_val")
    keep, verdicts = filter_features(train, cols, pinned, s)
    rows = None
    for period in [r["period"] for r in df.select("period").distinct().orderBy("period").collect()]:
        tr, va = (d.filter(F.col("period") == period) for d in (train, valid))
        for t in targets:
            one = models.evidence_for(tr, va, keep, t, key, s.trees, s.repeats, s.rounds).withColumn("period", F.lit(period))
            rows = one if rows is None else rows.unionByName(one)
    ev = evidence.embedded_score(staged(rows, "evidence"))
    pairs = evidence.permutation_interval(evidence.pair_metrics(ev), s.repeats)
    core = staged(
        evidence.unified_core(pairs, s.topk, topk_per_pair=s.topk_per_pair, min_appear_rate=s.min_appear_rate), "core"
    )
    chosen = [r["feature"] for r in core.filter("keep").orderBy("rank").collect()]
    best, score = models.backward_elimination(train, valid, chosen, {t: 1.0 for t in targets}, s.trees, s.wrapper_rounds)
    return {
        "verdicts": verdicts,
        "evidence": pairs,
        "core": core,
        "final": evidence.core_with_pinned(core.filter(F.col("feature").isin(*best)), pinned),
        "chosen": best,
    }


def common_core(cores: Mapping[str, DataFrame]) -> DataFrame:
    """Features in every expert's core."""
    stacked = None
    for name, core in cores.items():
        one = core.filter("keep").select("feature", F.lit(name).alias("expert"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return evidence.common_features(stacked, ["expert"])
