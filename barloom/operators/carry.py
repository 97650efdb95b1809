"""Exclusive scans over one row per (keys, bucket), in two levels.

Buckets are gathered into super-buckets of `barloom.super.buckets` consecutive numbers. The super-buckets of a group are
scanned first, then the buckets inside each, so a task reads the super-buckets of a group or the buckets of one super-bucket,
never all buckets of a long group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SUPER_BUCKETS_CONF = "barloom.super.buckets"
DEFAULT_SUPER_BUCKETS = 1024

_TOP = "_super"


def _over(kind: str, name: str, window) -> Column:
    if kind == "sum":
        return F.sum(name).over(window)
    if kind == "last":
        return F.last(name, ignorenulls=True).over(window)
    return F.max(name).over(window)


def _total(kind: str, name: str, bucket: str) -> Column:
    if kind == "sum":
        return F.sum(name)
    if kind == "last":
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(bucket)))
    return F.max(name)


def _both(kind: str, a: Column, b: Column) -> Column:
    """What comes before and what follows, either of which may be unknown."""
    if kind == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.coalesce(b, a) if kind == "last" else F.greatest(a, b)


def carried(parts: DataFrame, keys: Sequence[str], bucket: str, kinds: Mapping[str, str], whole: Mapping[str, str] | None = None) -> DataFrame:
    """(keys, bucket, name for each of `kinds`): the sum, last known value or maximum (`sum`, `last`, `max`) of earlier buckets.

    Names in `whole` are reduced over all buckets of the group instead, and come with every bucket. `parts` has one row per
    (keys, bucket); keys and buckets are known.
    """
    whole = dict(whole or {})
    span = int(parts.sparkSession.conf.get(SUPER_BUCKETS_CONF, str(DEFAULT_SUPER_BUCKETS)))
    parts = parts.withColumn(_TOP, F.floor(F.col(bucket) / span).cast("long"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys).orderBy(_TOP).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = parts.groupBy(*keys, _TOP).agg(*[_total(kind, n, bucket).alias(n) for n, kind in {**kinds, **whole}.items()])
    tops = tops.select(*keys, _TOP, *[_over(kind, n, before(*keys).orderBy(_TOP)).alias(f"_top_{n}") for n, kind in kinds.items()], *[_over(kind, n, every).alias(n) for n, kind in whole.items()])
    inside = parts.select(*keys, bucket, _TOP, *[_over(kind, n, before(*keys, _TOP).orderBy(bucket)).alias(n) for n, kind in kinds.items()])
    merged = [_both(kind, F.col(f"_top_{n}"), F.col(n)).alias(n) for n, kind in kinds.items()]
    return inside.join(tops, [*keys, _TOP]).select(*keys, bucket, *merged, *whole)
