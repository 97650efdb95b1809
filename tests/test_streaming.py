"""Keyed stream state: bars that come out of order but within the allowed lateness count."""

import pandas as pd

from barloom.sources.staging import staging_path
from barloom.streaming import bars as st

DAY = 86_400_000


def test_late_bar_counts(spark):
    path = staging_path(spark, "late-bars")
    close = {0: 1.0, 1: 5.0, 2: 2.0, 3: 8.0, 4: 3.0}
    for days in ([0, 1, 3], [2, 4, 1], [90]):
        rows = [("A", "1d", (100 + d) * DAY, 1.0, 1.0, close.get(d, 0.0)) for d in days]
        part = spark.createDataFrame(rows, "symbol string, period string, timestamp long, high double, low double, close double")
        part.selectExpr("*", "timestamp_millis(timestamp) AS datetime").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    before = spark.conf.get(st.STATE_CONF)
    spark.conf.set(st.STATE_CONF, st.ROCKSDB)
    try:
        found = st.run_available(st.stateful(stream, st.EmaState((3,))), staging_path(spark, "late-ema")).collect()
    finally:
        spark.conf.set(st.STATE_CONF, before)
    wanted = pd.Series(close).ewm(span=3, adjust=False).mean()
    assert {r.timestamp // DAY - 100: round(r.ema_3, 9) for r in found} == {d: round(v, 9) for d, v in wanted.items()}
