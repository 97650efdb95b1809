"""Two-level scans with tiny buckets: results, and the most rows that one window partition reads."""

import random

from pyspark.sql import Window, functions as F

from barloom.operators import chunks
from barloom.operators.carry import carried
from barloom.operators.scan import bucketed_scan


def parts(spark, rnd, buckets=400):
    rows = [(k, b, rnd.choice([None, rnd.randrange(-50, 50)])) for k in "xy" for b in range(-7, buckets) if k == "x" or b % 5 == 0]
    rows += [("x", -(1 << 40), 3), ("z", 0, None)]
    return spark.createDataFrame(rows, "k string, b long, s long").withColumns({"l": F.col("s"), "m": F.col("s"), "ws": F.col("s"), "wl": F.col("s")})


def test_equals_one_window(spark):
    df = parts(spark, random.Random(1))
    w = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = df.select("k", "b", F.sum("s").over(w).alias("s"), F.last("l", True).over(w).alias("l"), F.max("m").over(w).alias("m"), F.sum("ws").over(every).alias("ws"), F.last("wl", True).over(every).alias("wl"))
    for span in ("20", "1", "1024"):
        spark.conf.set("barloom.super.buckets", span)
        try:
            got = carried(df, ["k"], "b", {"s": "sum", "l": "last", "m": "max"}, {"ws": "sum", "wl": "last"})
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        finally:
            spark.conf.unset("barloom.super.buckets")


def test_windows_partition_by_super_bucket(spark, tiny_chunks):
    """400 buckets in super-buckets of 20: windows run over 8 rows, 20 buckets or 20 super-buckets, and totals come out right."""
    spark.conf.set("barloom.super.buckets", "20")
    try:
        symbol = F.concat(F.lit("s"), (F.col("id") % 1).cast("string"))
        df = spark.range(3200).select(symbol.alias("symbol"), (F.col("id") * 3_600_000).alias("timestamp"), F.col("id").cast("double").alias("x"))
        df = df.withColumn("b", chunks.time_bucket(df))
        tops = df.select("b").distinct().groupBy(F.floor(F.col("b") / 20)).count()
        assert tops.count() == 20 and tops.agg(F.max("count")).first()[0] == 20
        got = bucketed_scan(df, ["symbol"], ["timestamp"], "b", sums={"s": F.col("x")})
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        specs = [line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in plan.splitlines() if "Window [" in line]
        names = sorted(",".join(c.split("#")[0].strip() for c in spec.split(",")) for spec in specs)
        assert names == ["symbol,_super", "symbol,_super,b", "symbol,b,timestamp"]
        assert [r.s for r in got.orderBy("timestamp").select("s").collect()] == [i * (i + 1) / 2 for i in range(3200)]
    finally:
        spark.conf.unset("barloom.super.buckets")
