"""Null rules. Missing is always NULL: NaN and infinities are folded at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_INF = float("inf")


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(_INF)), F.lit(None).cast("double")).otherwise(c)


def safe(c: Column, fill: float = 0.0) -> Column:
    """NULL (from division by zero, short windows, NaN, inf) becomes the fill value."""
    return F.coalesce(finite(c), F.lit(float(fill)))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bound to [lo, hi], leaving NULL alone (greatest/least would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def flag(cond: Column) -> Column:
    """0/1 integer; an unknown comparison counts as false."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL where b is zero (and NULL, not an error, under ANSI)."""
    return F.try_divide(a, b)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Fold NaN and infinities of every floating column to NULL right after a scan."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: finite(F.col(c)) for c in floats}) if floats else df


def to_number(c: Column) -> Column:
    """Text to double; anything unreadable is NULL."""
    return finite(c.cast("string").try_cast("double"))


def narrow_for_sink(df: DataFrame, keep: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """double to float and long to int for storage, times excepted; only for sinks."""
    out = {}
    for f in df.schema.fields:
        if f.name in keep:
            continue
        if f.dataType.typeName() == "double":
            out[f.name] = F.col(f.name).cast("float")
        elif f.dataType.typeName() == "long":
            out[f.name] = F.col(f.name).cast("int")
    return df.withColumns(out) if out else df
