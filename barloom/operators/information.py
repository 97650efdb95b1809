"""Mutual information of a column and a class by nearest neighbours, from sorted order.

For each point: the distance d to its k-th nearest value of the same class, and the number m of all values nearer than d. The
estimate is psi(N) + <psi(k)> - <psi(N of the class)> - <psi(m)>, in nats, at least 0. Distances come from windows of ranks
(`barloom.operators.outliers.windows`) and counts from as-of matches, so no neighbour is listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.outliers import matched, packed, windows
from barloom.operators.ranks import long_form, ranked_values
from barloom.sources.staging import staged

NEIGHBOURS = 3


def digamma(x: Column) -> Column:
    """psi of a positive number: an asymptotic series six steps up, brought down by its recurrence."""
    y = x + 6.0
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4.0))) - 1 / (252 * F.pow(y, F.lit(6.0)))
    for step in range(6):
        series = series - 1 / (x + float(step))
    return series


def neighbour_information(df: DataFrame, cols: Sequence[str], target: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(feature, rows, information) of each column with the classes of `target`.

    Rows with an unknown value or class do not count, nor classes of one row; a class of fewer rows takes all others as neighbours. Equal
    values are no distance apart: where d is 0, m counts the equal ones. A column without rows has no result.
    """
    rows = long_form(df.withColumn("_class", F.col(target)), ["_class"], cols).where(F.col("value").isNotNull() & F.col("_class").isNotNull())
    by = ["feature", "_class"]
    own = ranked_values(rows, by, "value").where(F.col("total") > 1)
    own = own.withColumns({"k": F.least(F.lit(neighbours), F.col("total") - 1).cast("long"), "_v": F.col("value").cast("double")})
    own = staged(own.select(*by, "n", "before", "total", "k", "_v"), "class-points")
    points = staged(windows(own, by).select("feature", "n", "total", "k", "_v", "_d"), "class-windows")
    counts = own.groupBy("feature", F.col("_v").alias("value")).agg(F.sum("n").alias("_m"))
    whole = ranked_values(counts, ["feature"], "value", sums={"m": F.col("_m")})
    runs = staged(whole.select("feature", F.col("value").alias("_at"), F.lit(0).cast("long").alias("_tie"), (F.col("before_m") + F.col("m")).alias("_hit")), "runs")
    equal = F.col("_point._d") == 0
    upto = matched(runs, points.select("feature", (F.col("_v") + F.col("_d")).alias("_at"), packed(points, ["feature"])), ["feature"], ~equal, "upper-counts")
    upto = upto.withColumnRenamed("_hit", "_high").drop("_at")
    met = matched(runs, upto.select("feature", (F.col("_v") - F.col("_d")).alias("_at"), packed(upto, ["feature"])), ["feature"], equal, "lower-counts")
    inside = (F.col("_high") - F.coalesce("_hit", F.lit(0))).cast("double")
    psi = lambda c: digamma(c.cast("double"))
    weighed = F.sum(F.col("n") * (psi(F.col("k")) - psi(F.col("total")) - psi(inside)))
    sums = met.groupBy("feature").agg(F.sum("n").alias("rows"), weighed.alias("_sum"))
    return sums.select("feature", "rows", F.greatest(F.lit(0.0), psi(F.col("rows")) + F.col("_sum") / F.col("rows")).alias("information"))
