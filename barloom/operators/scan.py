"""Running totals and last-known values over whole groups, computed bucket by bucket.

Both are associative: a bucket is reduced to one row, the reduced rows are scanned per group, and
each row combines its bucket's carry-in with a window inside its own bucket. No task ever holds
more than one bucket of rows, or the reduced rows of one super-bucket (`barloom.operators.carry`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.carry import carried
from barloom.operators.chunks import known_bucket, restored_keys, stand_in_keys

_IN = "_carry_"


def bucketed_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: str,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    peaks: Mapping[str, Column] | None = None,
    before: bool = False,
    carry_from: DataFrame | None = None,
) -> DataFrame:
    """Add columns: running sum, last non-null value, running maximum, up to and including each row.

    Rows with unknown keys are groups of their own, and rows of an unknown bucket come first; none is lost.

    `bucket` is a column that never decreases along `order` inside a group, and rows of one bucket
    must fit one task. The inputs must be row-local expressions. With `before=True` the current row
    is left out (an exclusive scan).

    The carries are computed from `carry_from` (the same rows, but only the columns the inputs need)
    where given: behind an Arrow step Spark cannot prune, and would run the step twice.
    """
    sums, lasts, peaks = dict(sums or {}), dict(lasts or {}), dict(peaks or {})
    every = {**sums, **lasts, **peaks}
    inputs = {f"_in_{k}": v for k, v in every.items()}
    own = [c for c in df.columns if c.startswith("_unknown_")]  # of a caller that has already replaced unknown keys
    tagged, source = (
        stand_in_keys(d, keys).withColumn(bucket, known_bucket(F.col(bucket))).withColumns(inputs) for d in (df, df if carry_from is None else carry_from)
    )
    stamp = F.struct(*[F.col(o) for o in order])

    partial = [F.sum(f"_in_{k}").alias(_IN + k) for k in sums]
    partial += [
        F.max_by(F.col(f"_in_{k}"), F.when(F.col(f"_in_{k}").isNotNull(), stamp)).alias(_IN + k) for k in lasts
    ]
    partial += [F.max(f"_in_{k}").alias(_IN + k) for k in peaks]
    kinds = {k: "sum" for k in sums} | {k: "last" for k in lasts} | {k: "max" for k in peaks}
    carry = carried(source.groupBy(*keys, bucket).agg(*partial), keys, bucket, {_IN + k: kind for k, kind in kinds.items()})

    end = -1 if before else Window.currentRow
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = {k: F.sum(f"_in_{k}").over(inside) for k in sums}
    local |= {k: F.last(f"_in_{k}", ignorenulls=True).over(inside) for k in lasts}
    local |= {k: F.max(f"_in_{k}").over(inside) for k in peaks}
    out = tagged.withColumns({f"_loc_{k}": v for k, v in local.items()}).join(carry, [*keys, bucket])
    merged: dict[str, Column] = {}
    for k in sums:
        a, b = F.col(_IN + k), F.col(f"_loc_{k}")
        merged[k] = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    for k in lasts:
        merged[k] = F.coalesce(F.col(f"_loc_{k}"), F.col(_IN + k))
    for k in peaks:
        merged[k] = F.greatest(F.col(f"_loc_{k}"), F.col(_IN + k))
    helpers = [p + k for k in every for p in ("_in_", _IN, "_loc_")]
    done = out.withColumns(merged).drop(*helpers)
    return done if own else restored_keys(done)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str, name: str) -> DataFrame:
    """Dense 0-based row number inside each group."""
    return bucketed_scan(df, keys, order, bucket, sums={name: F.lit(1).cast("long")}).withColumn(
        name, F.col(name) - 1
    )
