"""Coverage, column health, null shape, time continuity and leakage audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.columns import normalise_name
from barloom.functions.nulls import ratio
from barloom.functions.times import period_ms, robust_timestamp
from barloom.operators.chunks import halo_chunks, time_bucket
from barloom.operators.ranks import exact_quantiles, long_form
from barloom.operators.scan import bucketed_scan, with_position
from barloom.schema import KEYS, TIME, VERSION_COLUMNS
from barloom.sources.staging import staged

# --- group and coverage summaries ---------------------------------------------------------------


def group_summary(df: DataFrame, name: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows and first/last time per group; with a dataset name for unions across datasets."""
    out = df.groupBy(*keys).agg(
        F.count(TIME).alias("rows"), F.min(TIME).alias("start_ts"), F.max(TIME).alias("end_ts")
    )
    return out.withColumn("dataset", F.lit(name)) if name else out


def dataset_summaries(datasets: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [group_summary(d, n) for n, d in datasets.items()])


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Known count and share per column: overall, per period and per (symbol, period), in one pass.

    The grouping sets expand only (keys, known flags), and are combined map-side.
    """
    known = {f"_k_{c}": F.col(c).isNotNull().cast("long") for c in cols}
    work = df.select(*KEYS, *[v.alias(k) for k, v in known.items()])
    sets = work.groupingSets([[], ["period"], ["symbol", "period"]], "symbol", "period")
    wide = sets.agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("total_rows"), *[F.sum(k).alias(c) for k, c in zip(known, cols)]
    )
    level = F.when(F.col("_gid") == 3, "overall").when(F.col("_gid") == 2, "period").otherwise("symbol_period")
    return (
        wide.withColumn("level", level)
        .unpivot(["level", "symbol", "period", "total_rows"], list(cols), "column", "non_null")
        .withColumn("non_null_ratio", F.col("non_null") / F.col("total_rows"))
    )


def first_known_time(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.min(F.when(F.col(c).isNotNull(), F.col(TIME))).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "first_ts")


def top_null_columns(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The k columns that miss most (the report's own limit)."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "null_ratio").orderBy(F.desc("null_ratio"), "column").limit(k)


def feature_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, coverage, variance) of each column.

    Long rows and two aggregates, combined map-side, rather than two aggregates per column: one
    generated method for hundreds of columns would be too large to compile.
    """
    return long_form(df, [], cols).groupBy("feature").agg(
        F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"), F.var_samp("value").alias("variance")
    )


def column_health(df: DataFrame, cols: Sequence[str], limit: float = 6.0) -> DataFrame:
    """Null share, distinct count, constancy and share of rows beyond `limit` global deviations."""
    rows = long_form(df, [], cols)
    moments = rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("value").alias("_known"), F.avg("value").alias("_mu"), F.stddev_samp("value").alias("_sd")
    )
    # value counts feed both the distinct count and the extreme share
    counts = rows.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    far = F.abs(ratio(F.col("value") - F.col("_mu"), F.col("_sd"))) > limit
    extreme = (
        counts.join(moments, "feature")
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("nunique"), F.sum(F.when(far, F.col("_n")).otherwise(0)).alias("_far"))
    )
    return moments.join(extreme, "feature", "left").select(
        "feature",
        (1 - F.col("_known") / F.col("_rows")).alias("null_ratio"),
        F.coalesce("nunique", F.lit(0)).alias("nunique"),
        (F.coalesce("nunique", F.lit(0)) <= 1).cast("int").alias("constant"),
        (F.coalesce("_far", F.lit(0)) / F.col("_rows")).alias("extreme_ratio"),
    )


def distribution(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, std, extremes and seven exact quantiles per column."""
    rows = long_form(df, [], cols)
    base = rows.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    names = ("p1", "p5", "p25", "p50", "p75", "p95", "p99")
    q = exact_quantiles(rows, ["feature"], "value", [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    return base.join(q.withColumnsRenamed({f"q{i}": n for i, n in enumerate(names)}), "feature")


def early_null_rate(df: DataFrame, cols: Sequence[str], head: int = 64) -> DataFrame:
    """Mean null share of the columns in the first `head` rows of each group."""
    placed = with_position(df.withColumn("_bucket", time_bucket(df)), KEYS, [TIME], "_bucket", "_row")
    nulls = sum((F.col(c).isNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNull().cast("int"))
    return (
        placed.filter(F.col("_row") < head)
        .groupBy(*KEYS)
        .agg((F.sum(nulls) / (F.count(F.lit(1)) * len(cols))).alias("early_null_rate"))
    )


def null_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Leading, inner and trailing unknown runs of each column in each group."""
    placed = with_position(df.withColumn("_bucket", time_bucket(df)), KEYS, [TIME], "_bucket", "_row")
    rows = placed.select(*KEYS, TIME, "_row", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [*KEYS, TIME, "_row"], list(cols), "column", "value"
    )
    known = F.col("value").isNotNull()
    g = rows.groupBy(*KEYS, "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("_known"),
        F.min(F.when(known, F.col("_row"))).alias("_first"),
        F.max(F.when(known, F.col("_row"))).alias("_last"),
        F.min(F.when(known, F.col(TIME))).alias("first_known_ts"),
        F.max(F.when(known, F.col(TIME))).alias("last_known_ts"),
    )
    lead = F.coalesce(F.col("_first"), F.col("n"))
    trail = F.coalesce(F.col("n") - 1 - F.col("_last"), F.col("n"))
    inner = F.coalesce(F.col("_last") - F.col("_first") + 1 - F.col("_known"), F.lit(0))
    return g.select(
        *KEYS,
        "column",
        (1 - F.col("_known") / F.col("n")).alias("nan_ratio"),
        lead.alias("leading"),
        inner.alias("inner"),
        trail.alias("trailing"),
        (F.col("_known").cast("boolean") & (trail == 0)).cast("int").alias("has_contiguous_tail"),
        ((lead > 0) & (lead < F.col("n")) & (inner == 0) & (trail == 0)).cast("int").alias("is_strict_early_gap"),
        "first_known_ts",
        "last_known_ts",
    ).withColumnRenamed("inner", "inner_nulls")


def time_column_scores(df: DataFrame, cols: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """How much each column looks like time: parse share, monotone, unique, name, plausible range.

    `order` is the order of rows in which monotony is judged. Neighbours are compared inside buckets
    and, through each bucket's first and last value, across them.
    """
    parsed = {c: F.unix_millis(robust_timestamp(F.col(c))) for c in cols}
    wide = staged(df.select(*order, bucket.alias("_bucket"), *[v.alias(f"c_{c}") for c, v in parsed.items()]), "times")  # parsed once
    prior = bucketed_scan(wide, [], list(order), "_bucket", lasts={f"_prev_{c}": F.col(f"c_{c}") for c in cols}, before=True)
    low, high = 1_230_768_000_000, 4_102_444_800_000
    counts = prior.agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.struct(
                F.count(ms := F.col(f"c_{c}")).alias("_k"),
                F.count_if(ms < F.col(f"_prev_{c}")).alias("_down"),
                F.count_if(ms > F.col(f"_prev_{c}")).alias("_up"),
                F.min(ms).alias("_min"),
                F.max(ms).alias("_max"),
            ).alias(f"s_{c}")
            for c in cols
        ],
    )
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("of")) for c in cols]))
    base = counts.filter("_n > 0").select("_n", each.alias("_each")).select("_n", "_each.column", "_each.of.*")
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("ms")) for c in cols])).alias("_each")).select("_each.*")
    distinct = rows.filter("ms is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("_u"))
    named = [c for c in cols if _looks_like_time(c)]
    ok = F.col("_k") / F.col("_n")
    mono = F.when((F.col("_down") == 0) | (F.col("_up") == 0), 0.15).otherwise(0.0)
    uniq = F.coalesce(ratio(F.col("_u").cast("double"), F.col("_k").cast("double")), F.lit(0.0)) * 0.15
    name = F.when(F.col("column").isin(*named), 0.10).otherwise(0.0) if named else F.lit(0.0)
    plausible = F.when((F.col("_min") >= low) & (F.col("_max") <= high), 0.10).otherwise(0.0)
    return base.join(distinct, "column", "left").select(
        "column", ok.alias("parse_ratio"), (ok + mono + uniq + name + plausible).alias("score")
    )


def _looks_like_time(name: str) -> bool:
    parts = normalise_name(name).split("_")
    return "time" in parts or "date" in parts or "timestamp" in normalise_name(name) or "datetime" in parts


def symbol_hygiene(df: DataFrame) -> DataFrame:
    """Null, literal nan, separators and glued pairs among the raw symbols."""
    s = F.trim("symbol")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("symbol").isNull()).alias("null_rows"),
        F.count_if(F.lower(s) == "nan").alias("literal_nan"),
        F.count_if(s.rlike("/|-")).alias("slash_or_dash"),
        F.count_if(s.rlike("(?i)^[a-z]+(usdt|usd|busd|usdc)$")).alias("glued_pairs"),
    )


def quality_suggestion(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per period: mean known share of the columns, mapped to [0.6, 1]."""
    known = sum((F.avg(F.col(c).isNotNull().cast("double")) for c in cols[1:]), F.avg(F.col(cols[0]).isNotNull().cast("double")))
    scores = df.groupBy("period").agg((known / len(cols)).alias("score"))
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo, hi = F.min("score").over(every), F.max("score").over(every)
    q = F.when(hi > lo, 0.6 + 0.4 * (F.col("score") - lo) / (hi - lo)).otherwise(1.0)
    return scores.withColumn("quality", q)


def group_counts(df: DataFrame, is_validation: Column) -> DataFrame:
    return df.groupBy(*KEYS).agg(
        F.count_if(~is_validation).alias("train_rows"), F.count_if(is_validation).alias("val_rows")
    )


def series_time_ranges(series: DataFrame, dataset: str) -> DataFrame:
    """First and last date of each dataset in a stack of series."""
    return series.groupBy(dataset).agg(F.min(TIME).alias("start_ts"), F.max(TIME).alias("end_ts"), F.count(F.lit(1)).alias("rows"))


# --- time continuity ----------------------------------------------------------------------------


def _steps(df: DataFrame) -> DataFrame:
    """Distinct times per group with the previous one."""
    times = df.select(*KEYS, TIME).distinct()
    ck = halo_chunks(times, back=1)
    return ck.owned(ck.df.withColumn("prev_ts", F.lag(TIME).over(ck.w)))


def modal_steps(steps: DataFrame) -> DataFrame:
    """Most frequent step per group, the smallest on ties."""
    diffs = steps.filter("prev_ts is not null").groupBy(*KEYS, (F.col(TIME) - F.col("prev_ts")).alias("_d")).count()
    return diffs.groupBy(*KEYS).agg(F.max_by("_d", F.struct("count", -F.col("_d"))).alias("step_ms_inferred"))


def continuity(df: DataFrame) -> DataFrame:
    """Per group: rows, distinct times, step (declared, else modal), expected rows, gaps, duplicates."""
    steps = _steps(df)
    rows = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"))
    declared = period_ms(F.col("period"))
    with_step = steps.join(modal_steps(steps), list(KEYS), "left").withColumn(
        "_step", F.coalesce(declared, F.col("step_ms_inferred"))
    )
    g = with_step.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("unique_ts"),
        F.min(TIME).alias("start_ts"),
        F.max(TIME).alias("end_ts"),
        F.first("_step").alias("_step"),
        F.first("step_ms_inferred").alias("step_ms_inferred"),
        F.count_if(F.col(TIME) - F.col("prev_ts") > F.col("_step")).alias("gaps"),
    )
    plain = F.col("_step").isNull() | (F.col("_step") <= 0) | (F.col("unique_ts") == 1)
    expected = F.when(plain, F.col("unique_ts")).otherwise(
        F.floor((F.col("end_ts") - F.col("start_ts")) / F.col("_step")) + 1
    )
    dup = F.col("rows") > F.col("unique_ts")
    return g.join(rows, list(KEYS)).select(
        *KEYS,
        "rows",
        "unique_ts",
        "start_ts",
        "end_ts",
        declared.alias("step_ms"),
        "step_ms_inferred",
        expected.cast("long").alias("expected_rows"),
        F.greatest(F.lit(0), expected - F.col("unique_ts")).cast("long").alias("missing_points"),
        "gaps",
        ((F.col("gaps") == 0) & ~dup).cast("int").alias("is_continuous"),
        dup.cast("int").alias("has_duplicates"),
    )


def missing_points(df: DataFrame, limit_per_group: int | None = None) -> DataFrame:
    """Every absent instant, or the first limit_per_group of each group. The step is the declared one, else the most frequent.

    Gaps are numbered by how many absent instants lie before them, so a gap beyond the limit is never
    expanded.
    """
    steps = _steps(df)
    steps = steps.join(modal_steps(steps), list(KEYS), "left").withColumn("_step", F.coalesce(period_ms(F.col("period")), F.col("step_ms_inferred")))
    gaps = steps.withColumn("_absent", F.floor((F.col(TIME) - F.col("prev_ts")) / F.col("_step")) - 1).filter("_absent > 0")
    if limit_per_group is None:
        wanted = gaps.withColumn("_take", F.col("_absent"))
    else:
        gaps = gaps.withColumn("_bucket", time_bucket(gaps))
        seen = bucketed_scan(gaps, KEYS, [TIME], "_bucket", sums={"_before": F.col("_absent")}, before=True)
        left = F.lit(limit_per_group) - F.coalesce("_before", F.lit(0))
        wanted = seen.withColumn("_take", F.least(F.col("_absent"), left)).filter("_take > 0")
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take")))
    return wanted.select(*KEYS, "prev_ts", "_step", k.alias("_k")).select(
        *KEYS, (F.col("prev_ts") + F.col("_k") * F.col("_step")).alias("missing_ts")
    )


def time_idx_breaks(df: DataFrame, idx: str = "time_idx", bucket_rows: int = 1024) -> DataFrame:
    """Groups whose time_idx does not advance by one."""
    work = df.withColumn("_bucket", F.floor(F.col(idx) / bucket_rows))
    prior = bucketed_scan(work, KEYS, [idx], "_bucket", lasts={"_prev": F.col(idx)}, before=True)
    return prior.groupBy(*KEYS).agg(F.count_if(F.col(idx) - F.col("_prev") != 1).alias("breaks")).filter("breaks > 0")


def leakage(df: DataFrame, max_gap: int = 1000, bucket_rows: int = 1024) -> DataFrame:
    """One summary row: duplicate keys, non-positive steps, largest gap, versions, missing scores, verdict."""
    scores = [c for c in df.columns if c.startswith("score__")]
    # duplicates collapse to one row with a count, so neighbours are distinct times
    keyed = df.groupBy(*KEYS, "time_idx").agg(F.count(F.lit(1)).alias("_n"))
    keyed = keyed.withColumn("_bucket", F.floor(F.col("time_idx") / bucket_rows))
    prior = bucketed_scan(keyed, KEYS, ["time_idx"], "_bucket", lasts={"_prev": F.col("time_idx")}, before=True)
    steps = prior.agg(
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum(F.col("_n") - 1).alias("non_positive_steps"),
        F.max(
            F.greatest(F.col("time_idx") - F.col("_prev"), F.when(F.col("_n") > 1, F.lit(0).cast("long")))
        ).alias("max_gap"),
    )
    versions = [c for c in VERSION_COLUMNS if c in df.columns]
    missing = sum((F.count_if(F.col(c).isNull()) for c in scores), F.lit(0).cast("long"))
    whole = df.agg(
        missing.alias("missing_scores"),
        (F.count_distinct(F.struct(*[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in versions])) if versions else F.lit(0).cast("long")).alias("version_tuples"),
        (F.count_distinct("train_window_id") if "train_window_id" in versions else F.lit(0).cast("long")).alias("window_ids"),
    )
    joined = steps.withColumn("_one", F.lit(1)).join(whole.withColumn("_one", F.lit(1)), "_one").drop("_one")
    ok = (F.col("duplicate_rows") == 0) & (F.coalesce("max_gap", F.lit(0)) <= max_gap) & (F.col("missing_scores") == 0)
    return joined.withColumn("passed", ok.cast("int"))


def truncation_breaks(compute, df: DataFrame, cut: int, cols: Sequence[str], halo_note: str = "") -> DataFrame:
    """Rows at or before `cut` that change when everything after `cut` is removed (none when leak-free)."""
    key = [*KEYS, TIME]
    full = compute(df).filter(F.col(TIME) <= cut).select(*key, *cols)
    short = compute(df.filter(F.col(TIME) <= cut)).select(*key, *cols)
    return full.exceptAll(short).unionByName(short.exceptAll(full))
