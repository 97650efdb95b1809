"""Columns that look like time: parsed once, and numbers are never tried as dates."""

from pyspark.sql import functions as F

from barloom.functions import times
from barloom.operators import audits

TEXTS = [
    None, "", "-", "/", "5", "-5", "1e-5", "1704067200000", "2024-01-01", "2024/01/02", "2024/01/02 03:04:05", "2024-01-01 05:06", "2024-01-01 05:06:07",
    "2024-01-01T05:06:07", "2024-01-01T05:06:07Z", "2024-01-01T05:06:07.123+02:00", " 2024-01-01 ", "-0044-03-15", "+12024-01-01", "x-y", "2024-13-01", "24-01-01",
]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_the_guard_changes_no_date(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in times._DATE_FORMATS])
    out = rows.select("t", F.unix_millis(times.parse_datetime(F.col("t"))).alias("a"), F.unix_millis(plain).alias("b")).collect()
    assert all(r.a == r.b for r in out) and sum(r.a is not None for r in out) > 8


def test_columns_are_parsed_once_and_numbers_not_as_dates(spark):
    rows = [(i, "2024-01-01 00:00:%02d" % (i % 60) if i % 7 else None, float(i), None) for i in range(200)]
    df = spark.createDataFrame(rows, "row long, open_time string, value double, nothing double")
    out = audits.time_column_scores(df, ["open_time", "value", "nothing"], ["row"], F.floor(F.col("row") / 16))
    assert "gettimestamp" not in plan(out)
    found = {r["column"]: (round(r.parse_ratio, 6), round(r.score, 6)) for r in out.collect()}
    known = sum(1 for r in rows if r[1])
    assert found["open_time"] == (round(known / 200, 6), round(known / 200 + 0.15 * len({r[1] for r in rows if r[1]}) / known + 0.2, 6))
    assert found["value"] == (1.0, 1.3) and found["nothing"] == (0.0, 0.15)
    empty = audits.time_column_scores(df.limit(0), ["open_time"], ["row"], F.floor(F.col("row") / 16))
    assert empty.count() == 0
    assert "rlike" in plan(df.select(times.parse_datetime(F.col("value").cast("string"))))
