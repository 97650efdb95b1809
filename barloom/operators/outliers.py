"""Local outlier factors of single columns, exact, without neighbour lists.

In one dimension the k nearest values of a point are a window of k + 1 ranks, and the window's ends move one way as the point
does. So the window is found by an as-of match: the first window whose ends are on average not below the point. The ends of the
neighbourhoods, b - d(b) and b + d(b), move one way too, so the neighbours whose own distance d(b) counts instead of the gap are a range
of ranks, and every mean over neighbours is a difference of running totals. The work is a fixed number of sorts of the distinct values,
whatever k is, and no task holds more than a block of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.chunks import restored_keys, stand_in_keys
from barloom.operators.ranks import exact_quantiles, last_known, long_form, ranked_values
from barloom.operators.scan import bucketed_scan
from barloom.schema import KEYS
from barloom.sources.staging import staged

NEIGHBOURS = {"1h": 24, "4h": 12, "1d": 6}
SHARE, CONTAMINATION, EPS = 0.1, 0.01, 1e-10
#: Rows, values and densities up to 9, and totals of their products; the product of the first two types has the third's digits.
SMALL = 1e12
COUNT, UNIT, EXACT = "decimal(10,0)", "decimal(27,26)", "decimal(38,26)"


def packed(df: DataFrame, by: Sequence[str]) -> Column:
    return F.struct(*[c for c in df.columns if c not in by]).alias("_point")


def matched(right: DataFrame, left: DataFrame, by: Sequence[str], strict: bool | Column, name: str) -> DataFrame:
    """Left rows (keys, _at, _point) with `_hit` of the last right row (keys, _at, _tie, _hit) at or below `_at`; where strict, below it."""
    side = F.when(strict if isinstance(strict, Column) else F.lit(strict), 0).otherwise(2)
    asked = left.withColumns({"_tie": F.lit(0).cast("long"), "_side": side})
    met = last_known(right.withColumn("_side", F.lit(1)).unionByName(asked, allowMissingColumns=True), by, ["_at", "_side", "_tie"], {"_hit": F.col("_hit")}, name)
    return met.where(F.col("_point").isNotNull()).select(*by, "_at", "_point.*", "_hit")


def windows(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct values _v with the ranks [_first, _end) of one of its rows and the k nearest, and the distance _d of the farthest.

    Of two rows at one distance the one of smaller value counts as nearer.
    """
    here, none = F.struct(F.col("_v").alias("v")), F.lit(None).cast("struct<v:double>")
    lower = points.select(*by, "total", "k", F.col("before").alias("_l"), here.alias("_x"), none.alias("_y"))
    upper = points.select(*by, "total", "k", (F.col("before") - F.col("k")).alias("_l"), none.alias("_x"), here.alias("_y"))
    starts = last_known(lower.unionByName(upper), by, ["_l"], {"_x": F.col("_x"), "_y": F.col("_y")}, "window-starts")
    starts = starts.where((F.col("_l") >= 0) & (F.col("_l") + F.col("k") < F.col("total")))
    starts = starts.groupBy(*by, "_l").agg(F.max("_x.v").alias("_x"), F.max("_y.v").alias("_y"))  # the row that knows both ends
    starts = staged(starts.select(*by, "_l", (F.col("_x") + F.col("_y")).alias("_at"), F.struct("_l", "_x", "_y").alias("_hit")), "starts")
    rising = starts.select(*by, "_at", F.col("_l").alias("_tie"), "_hit")
    falling = starts.select(*by, (-F.col("_at")).alias("_at"), (-F.col("_l")).alias("_tie"), "_hit")
    met = matched(rising, points.select(*by, (F.col("_v") * 2).alias("_at"), packed(points, by)), by, True, "windows-below")
    met = met.withColumnRenamed("_hit", "_before").drop("_at")
    met = matched(falling, met.select(*by, (F.col("_v") * -2).alias("_at"), packed(met, by)), by, False, "windows-above")
    # the last window that lies low starts one rank before the first that does not; without such a one it is the last of all
    last = F.coalesce(F.col("_hit._l") - 1, F.col("total") - 1 - F.col("k"))
    gap_low, gap_high = F.col("_v") - F.col("_before._x"), F.col("_hit._y") - F.col("_v")
    crowd = F.col("n") > F.col("k")
    use_low = gap_high.isNull() | (gap_low.isNotNull() & (gap_low <= gap_high))
    first = F.when(crowd, F.col("before")).when(use_low, last).otherwise(F.col("_hit._l"))
    reach = F.when(crowd, F.lit(0.0)).when(use_low, gap_low).otherwise(gap_high)
    return met.withColumns({"_first": first, "_d": reach}).withColumn("_end", F.col("_first") + F.col("k") + 1).drop("_before", "_hit", "_at")


def _with_totals(points: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Running totals `_sum<value>` of n times each value over smaller rows, and `_all<value>` over all rows of the group."""
    exact = {v: (F.col("n").cast(COUNT) * F.col(v)).cast(EXACT) for v in values}
    placed = points.withColumn("_bucket", F.shiftright("before", 12))
    placed = bucketed_scan(placed, by, ["before"], "_bucket", sums={f"_sum{v}": exact[v] for v in values}, before=True).drop("_bucket")
    placed = placed.withColumns({f"_sum{v}": F.coalesce(F.col(f"_sum{v}"), F.lit(0)).cast(EXACT) for v in values})
    whole = points.groupBy(*by).agg(*[F.sum(exact[v]).cast(EXACT).alias(f"_all{v}") for v in values])
    return staged(placed.join(whole, by), "running-totals")


def _totals_at(points: DataFrame, by: Sequence[str], rank: str, out: Mapping[str, str]) -> DataFrame:
    """Points with totals over all rows of ranks before `rank`: out maps a value column to the new column. Ranks 0 and total need no match."""
    edge = (F.col(rank) <= 0) | (F.col(rank) >= F.col("total"))
    runs = points.select(*by, F.col("before").alias("_at"), F.lit(0).cast("long").alias("_tie"), F.struct("before", *out, *[f"_sum{v}" for v in out]).alias("_hit"))
    inner = points.where(~edge)
    met = matched(runs, inner.select(*by, F.col(rank).alias("_at"), packed(inner, by)), by, False, f"totals{rank}")
    inside = {o: (F.col(f"_hit._sum{v}") + ((F.col("_at") - F.col("_hit.before")).cast(COUNT) * F.col(f"_hit.{v}")).cast(EXACT)).cast(EXACT) for v, o in out.items()}
    outside = {o: F.when(F.col(rank) <= 0, F.lit(0)).otherwise(F.col(f"_all{v}")).cast(EXACT) for v, o in out.items()}
    return staged(met.withColumns(inside).drop("_hit", "_at").unionByName(points.where(edge).withColumns(outside)), f"totals{rank}")


def factors(df: DataFrame, keys: Sequence[str], value: str, least: Column, share: float = SHARE) -> DataFrame:
    """(keys, value, lof) of each distinct known value in groups of more than `least` known rows: the mean density of its k nearest over its own.

    k is the larger of `least` and `share` of the group, at most all other rows. A density is one over the mean reach, max(d(b), |a - b|), plus EPS.
    """
    ranked = stand_in_keys(ranked_values(df, list(keys), value).where(F.col("total") > least), keys)
    by = [*keys, *[c for c in ranked.columns if c.startswith("_unknown_")]]
    k = F.least(F.col("total") - 1, F.greatest(least, F.floor(F.col("total") * F.lit(float(share)))).cast("long"))
    # times a power of two every value is below 1, and no digit of it changes
    largest = ranked.groupBy(*by).agg(F.pow(F.lit(2.0), -F.ceil(F.log2(F.greatest(F.max(F.abs(value)), F.lit(1e-290)))) - 1).alias("_scale"))
    points = ranked.join(largest, by).withColumns({"k": k, "_v": F.col(value).cast("double") * F.col("_scale")})
    points = staged(points.select(*by, "n", "before", "total", "k", "_scale", "_v"), "points")
    points = staged(windows(points, by).withColumns({"_x": F.col("_v").cast(UNIT), "_k": F.col("_d").cast(UNIT)}), "windows")
    points = _with_totals(points, by, ["_x", "_k"])
    # ranks before _c1 have neighbourhoods that end below the value, those from _c2 on ones that begin above it
    after = (F.col("before") + F.col("n")).alias("_hit")
    ends = points.select(*by, (F.col("_v") + F.col("_d")).alias("_at"), F.col("before").alias("_tie"), after)
    begins = points.select(*by, (F.col("_v") - F.col("_d")).alias("_at"), F.col("before").alias("_tie"), after)
    near = matched(ends, points.select(*by, F.col("_v").alias("_at"), packed(points, by)), by, True, "ends").withColumnRenamed("_hit", "_c1").drop("_at")
    far = matched(begins, near.select(*by, F.col("_v").alias("_at"), packed(near, by)), by, False, "begins").withColumnRenamed("_hit", "_c2").drop("_at")
    low, high = F.least(F.coalesce("_c1", F.lit(0)), F.col("before")), F.greatest(F.coalesce("_c2", F.lit(0)), F.col("before") + F.col("n"))
    rows = staged(far.withColumns({"_from": F.greatest("_first", low), "_to": F.least("_end", high)}).drop("_c1", "_c2"), "ranges")
    for rank, out in (("_first", {"_x": "_x0"}), ("_end", {"_x": "_x3"}), ("_from", {"_x": "_x1", "_k": "_k1"}), ("_to", {"_x": "_x2", "_k": "_k2"})):
        rows = _totals_at(rows, by, rank, out)
    times = lambda a, b: ((F.col(a) - F.col(b)).cast(COUNT) * F.col("_x")).cast(EXACT)
    added = lambda *terms: reduce(lambda a, b: (a + b).cast(EXACT), terms)  # noqa: E731  (each step would give up a digit)
    gap_sum = added(times("_from", "_first"), -F.col("_x1"), F.col("_x0"), F.col("_x3"), -F.col("_x2"), -times("_end", "_to"))
    reach = added(gap_sum, F.col("_k2"), -F.col("_k1"), -F.col("_k")).cast("double") / F.col("k") / F.col("_scale")
    rows = rows.withColumn("_dense", F.lit(EPS) / (F.greatest(reach, F.lit(0.0)) + EPS))  # in units of 1 / EPS
    # small ones are added up on their own, multiplied, so that each keeps its digits
    large = F.col("_dense") >= 1 / SMALL
    rows = rows.withColumns({"_p": F.when(large, F.col("_dense")).otherwise(0.0).cast(UNIT), "_q": F.when(large, 0.0).otherwise(F.col("_dense") * SMALL).cast(UNIT)})
    rows = staged(rows.select(*by, "n", "before", "total", "k", "_scale", "_v", "_first", "_end", "_dense", "_p", "_q"), "densities")
    rows = _with_totals(rows, by, ["_p", "_q"])
    for rank, out in (("_first", {"_p": "_p0", "_q": "_q0"}), ("_end", {"_p": "_p1", "_q": "_q1"})):
        rows = _totals_at(rows, by, rank, out)
    near = added(F.col("_p1"), -F.col("_p0"), -F.col("_p")).cast("double") + added(F.col("_q1"), -F.col("_q0"), -F.col("_q")).cast("double") / SMALL
    lof = near / F.col("k") / F.col("_dense")
    return restored_keys(rows.withColumns({value: F.col("_v") / F.col("_scale"), "lof": lof})).select(*keys, value, "lof")


def local_outliers(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, share: float = SHARE, contamination: float = CONTAMINATION) -> DataFrame:
    """Rows with lof_score_<column>, the factor below zero, and is_outlier_<column>: whether it is below that quantile of its group's scores.

    Neighbours are a share of the group's known rows, at least NEIGHBOURS of the period (24 for others). A value that is unknown, or in a
    group too small for so many neighbours, has no score and no flag. Equal values have equal scores. Every column is scored by itself.
    """
    least = F.lit(24)
    for period, n in NEIGHBOURS.items():
        least = F.when(F.col("period") == period, n).otherwise(least)
    work = stand_in_keys(df, keys)
    rows, by = long_form(work, list(keys), cols), [*keys, "feature"]
    scores = staged(factors(rows, by, "value", least, share).withColumn("lof", -F.col("lof")), "outlier-scores")
    bounds = exact_quantiles(rows.join(scores, [*by, "value"]), by, "lof", [contamination])
    scores = staged(scores.join(bounds, by).withColumn("flag", (F.col("lof") < F.col("q0")).cast("int")), "outlier-flags")
    for c in cols:
        own = scores.where(F.col("feature") == c).select(*keys, F.col("value").alias(c), F.col("lof").alias(f"lof_score_{c}"), F.col("flag").alias(f"is_outlier_{c}"))
        work = work.join(own, [*keys, c], "left")
    return restored_keys(work).select(*df.columns, *[f"{kind}_{c}" for c in cols for kind in ("lof_score", "is_outlier")])
