"""Train/validation splits, folds, masks and supervised windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.chunks import halo_chunks, time_bucket
from barloom.operators.ranks import ranked_values
from barloom.operators.scan import with_position
from barloom.schema import KEYS, TIME


def _placed(df: DataFrame, keys: Sequence[str] = KEYS, bucket: Column | None = None) -> DataFrame:
    """0-based position and size of each group."""
    work = df.withColumn("_bucket", time_bucket(df) if bucket is None else bucket)
    rows = with_position(work, keys, [TIME], "_bucket", "_row").drop("_bucket")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, list(keys))


def ratio_split(df: DataFrame, val_ratio: float = 0.2) -> DataFrame:
    """The first int(n * (1 - ratio)) rows of each group train."""
    cut = F.floor(F.col("_n") * F.lit(1 - val_ratio))
    return _placed(df).withColumn("is_val", F.col("_row") >= cut).drop("_row", "_n")


def days_split(df: DataFrame, days: int = 30, per_group: bool = True) -> DataFrame:
    """Rows later than `days` before the last one validate; the cut-off is per group or global."""
    span = days * 86_400_000
    if not per_group:
        last = df.agg(F.max(TIME)).first()[0]
        return df.withColumn("is_val", F.col(TIME) > F.lit(last) - span)
    ends = df.groupBy(*KEYS).agg(F.max(TIME).alias("_end"))
    return df.join(ends, list(KEYS)).withColumn("is_val", F.col(TIME) > F.col("_end") - span).drop("_end")


def fold_table(df: DataFrame, n_splits: int = 5, val_ratio: float = 0.2) -> DataFrame:
    """(period, fold, cut_ts, end_ts) on the distinct times of each period."""
    times = ranked_values(df.select("period", TIME).distinct(), ["period"], TIME)
    n = F.col("total")
    step = F.greatest(F.lit(1), F.floor(n * F.lit(1 - val_ratio) / (n_splits + 1)))
    folds = times.withColumn("_fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    cut = F.col("_fold") * step
    end = F.least(n - 1, cut + F.floor(n * F.lit(val_ratio)))
    at = F.col("before")
    return (
        folds.filter((n >= 10) & (cut < n - 1) & ((at == cut) | (at == end)))
        .groupBy("period", F.col("_fold").alias("fold"))
        .agg(F.min(TIME).alias("cut_ts"), F.max(TIME).alias("end_ts"))
    )


def rolling_folds(df: DataFrame, n_splits: int = 5, val_ratio: float = 0.2) -> DataFrame:
    """Rows of each expanding fold with is_val; the fold table has n_splits rows per period, joined on it."""
    folds = fold_table(df, n_splits, val_ratio)
    rows = df.join(folds, "period").filter(F.col(TIME) <= F.col("end_ts"))
    return rows.withColumn("is_val", F.col(TIME) > F.col("cut_ts")).drop("cut_ts", "end_ts")


def three_way_split(df: DataFrame, train: float = 0.6, val: float = 0.2, idx: str = "time_idx") -> DataFrame:
    """train / val / test by distinct times; with no test rows the validation rows serve as test too
    (`part` val_test), with fewer than three times everything is every part (`all`)."""
    times = ranked_values(df.select(idx).distinct(), [], idx)
    n = F.col("total")
    a = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
    b = F.greatest(a + 1, F.floor(n * F.lit(train + val)))
    at = F.col("before")
    cuts = times.agg(
        F.max(F.when(at == a - 1, F.col(idx))).alias("train_cut"),
        F.max(F.when(at == F.least(b, n - 1), F.col(idx))).alias("val_cut"),
        F.max(idx).alias("last"),
        F.max("total").alias("n"),
    ).first()
    t = F.col(idx)
    if cuts["n"] < 3:
        return df.withColumn("part", F.lit("all"))
    tail = "val_test" if cuts["val_cut"] >= cuts["last"] else "val"
    return df.withColumn(
        "part", F.when(t <= cuts["train_cut"], "train").when(t <= cuts["val_cut"], tail).otherwise("test")
    )


def edge_mask(df: DataFrame, embargo: int, purge: int) -> DataFrame:
    """valid = not among the first `embargo` or the last `purge` rows of its group."""
    valid = (F.col("_row") >= embargo) & (F.col("_row") < F.col("_n") - purge)
    return _placed(df).withColumn("valid", valid).drop("_row", "_n")


def sample_cap(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """A reproducible sample of n rows: the n smallest key hashes (a distributed top-n)."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def era_label(df: DataFrame) -> DataFrame:
    """Year of each group's last validation bar."""
    return df.filter("is_val").groupBy(*KEYS).agg(F.year(F.timestamp_millis(F.max(TIME))).cast("string").alias("era"))


def supervised_windows(df: DataFrame, features: Sequence[str], target: str, length: int) -> DataFrame:
    """Encoder windows: the last `length` rows of features and the next bar's label."""
    ck = halo_chunks(df, back=length, ahead=1)
    frame = ck.w.rowsBetween(-(length - 1), 0)
    out = ck.df.withColumns(
        {
            "window": F.collect_list(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])).over(frame),
            "label": F.lead(target).over(ck.w),
        }
    )
    rows = ck.owned(out).select(*KEYS, TIME, "window", "label")
    return rows.filter((F.size("window") == length) & F.col("label").isNotNull())


def with_time_idx(df: DataFrame, symbols: Sequence[str] = (), periods: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based bar number inside each group; with order lists, rows are also sorted by them."""
    ck = halo_chunks(df, back=0)
    out = ck.owned(ck.df.withColumn("time_idx", ck.position()))
    if not symbols and not periods:
        return out
    rank = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    order = ([rank(symbols, "symbol")] if symbols else []) + ([rank(periods, "period")] if periods else [])
    return out.orderBy(*order, TIME)


def top_k_per_group(df: DataFrame, keys: Sequence[str], score: str, k: int, tie: Sequence[str]) -> DataFrame:
    """Best k rows per group. Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *tie)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by the order columns (combined map-side)."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
