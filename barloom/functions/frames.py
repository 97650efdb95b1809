"""Rolling aggregates with an explicit minimum count of known values in the frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec, functions as F

from barloom.functions.nulls import ratio


def back(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end `lag` rows before the current one."""
    return w.rowsBetween(-(n - 1) - lag, -lag)


def rolling(
    agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int, mp: int | None = None, lag: int = 0
) -> Column:
    """agg over the last n rows, NULL until `mp` (default n) known values are inside."""
    frame = back(w, n, lag)
    need = n if mp is None else mp
    value = agg(x).over(frame)
    if need <= 1:
        return value
    return F.when(F.count(x).over(frame) >= need, value)


def mean(x: Column, w: WindowSpec, n: int, mp: int | None = None, lag: int = 0) -> Column:
    return rolling(F.avg, x, w, n, mp, lag)


def total(x: Column, w: WindowSpec, n: int, mp: int | None = None, lag: int = 0) -> Column:
    return rolling(F.sum, x, w, n, mp, lag)


def std(x: Column, w: WindowSpec, n: int, mp: int | None = None, lag: int = 0) -> Column:
    return rolling(F.stddev_samp, x, w, n, max(2, n if mp is None else mp), lag)


def std_pop(x: Column, w: WindowSpec, n: int, mp: int | None = None, lag: int = 0) -> Column:
    return rolling(F.stddev_pop, x, w, n, mp, lag)


def high(x: Column, w: WindowSpec, n: int, mp: int | None = None, lag: int = 0) -> Column:
    return rolling(F.max, x, w, n, mp, lag)


def low(x: Column, w: WindowSpec, n: int, mp: int | None = None, lag: int = 0) -> Column:
    return rolling(F.min, x, w, n, mp, lag)


def quantile(x: Column, q: float, w: WindowSpec, n: int, mp: int | None = None, lag: int = 0) -> Column:
    """Linear-interpolated quantile of a bounded frame."""
    return rolling(lambda c: F.percentile(c, F.lit(q)), x, w, n, mp, lag)


def slope(y: Column, pos: Column, w: WindowSpec, n: int, mp: int | None = None) -> Column:
    """Least-squares slope of y against its row position."""
    frame, need = back(w, n), n if mp is None else mp
    return F.when(F.count(y).over(frame) >= need, F.regr_slope(y, pos.cast("double")).over(frame))


def skew_unbiased(x: Column, w: WindowSpec, n: int, mp: int) -> Column:
    """Sample skewness with the bias correction."""
    frame = back(w, n)
    k = F.count(x).over(frame).cast("double")
    raw = F.skewness(x).over(frame)
    fixed = ratio(F.sqrt(k * (k - 1)), k - 2) * raw
    return F.when(k >= max(mp, 3), fixed)


def kurt_unbiased(x: Column, w: WindowSpec, n: int, mp: int) -> Column:
    """Sample excess kurtosis with the bias correction."""
    frame = back(w, n)
    k = F.count(x).over(frame).cast("double")
    raw = F.kurtosis(x).over(frame)
    fixed = ratio(k - 1, (k - 2) * (k - 3)) * ((k + 1) * raw + 6)
    return F.when(k >= max(mp, 4), fixed)


def values(x: Column, w: WindowSpec, n: int, lag: int = 0) -> Column:
    """Known values of a bounded frame as an array, oldest first."""
    return F.collect_list(x).over(back(w, n, lag))


def share_below(arr: Column, x: Column, size: Column) -> Column:
    """Share of the frame strictly below x."""
    return ratio(F.size(F.filter(arr, lambda y: y < x)).cast("double"), size)


def by(keys: tuple[str, ...] | list[str], order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)
