"""Joins, audits, sources and scalar functions on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import columns
from barloom.functions import nulls, symbols, times
from barloom.operators import audits, indicators, joins, norms, rows, splits
from barloom.plans import experts
from barloom.sources import bars as bar_source, files, series
from frames import STEP, bars, by_key


def test_asof_join_equals_pandas(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.integers(0, 3, 80), "t": rng.integers(0, 500, 80)}).drop_duplicates()
    right = pd.DataFrame({"k": rng.integers(0, 3, 60), "t": rng.integers(0, 500, 60), "v": np.arange(60.0)}).drop_duplicates(["k", "t"])
    for tol in (None, 20):
        got = joins.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", ["v"], tol, bucket_ms=16)
        got = got.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
        want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k", tolerance=tol)
        want = want.sort_values(["k", "t"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got[["k", "t", "v"]], want[["k", "t", "v"]], check_dtype=False)


def test_slow_series_take_effect_one_bar_later(spark):
    p = bars(10, symbols=("A_USDT",), gap=0)
    slow = pd.DataFrame({"timestamp": [p["timestamp"][2], p["timestamp"][6]], "rate": [1.0, 2.0]})
    out = joins.fuse(spark.createDataFrame(p), None, spark.createDataFrame(slow)).orderBy("timestamp").toPandas()
    assert out["rate"].isna().tolist() == [True] * 3 + [False] * 7
    assert out["rate"].tolist()[3:] == [1.0] * 4 + [2.0] * 3


def test_series_assembly_takes_the_first_known_value(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None)], "timestamp long, x double")
    b = spark.createDataFrame([(2, 7.0, 1.0), (3, 8.0, 2.0)], "timestamp long, x double, y double")
    got = {r["timestamp"]: (r["x"], r["y"]) for r in joins.assemble_series([a, b], ["timestamp"]).collect()}
    assert got == {1: (5.0, None), 2: (7.0, 1.0), 3: (8.0, 2.0)}


def test_null_shape_and_continuity(spark, tiny_chunks):
    p = bars(30, symbols=("A_USDT",), gap=0)
    p["x"] = [None] * 4 + [1.0] * 10 + [None] * 3 + [2.0] * 11 + [None] * 2
    df = spark.createDataFrame(p).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    r = audits.null_shape(df, ["x", "close"]).filter("column = 'x'").first()
    assert (r["leading"], r["inner_nulls"], r["trailing"], r["has_contiguous_tail"]) == (4, 3, 2, 0)
    gone = df.filter(~F.col("timestamp").isin(int(p["timestamp"][5]), int(p["timestamp"][6])))
    twice = gone.unionByName(gone.limit(1))
    c = audits.continuity(twice).first()
    assert (c["rows"], c["unique_ts"], c["missing_points"], c["gaps"], c["is_continuous"], c["has_duplicates"]) == (29, 28, 2, 1, 0, 1)
    assert [x["missing_ts"] for x in audits.missing_points(twice).orderBy("missing_ts").collect()] == p["timestamp"][5:7].tolist()
    assert audits.missing_points(twice, 1).count() == 1


def test_features_do_not_see_the_future(spark, tiny_chunks):
    p = bars(160, symbols=("A_USDT",))
    work = lambda d: indicators.compute(d, ["bollinger", "supertrend", "macd"]).select(
        "symbol", "period", "timestamp", F.round("boll_upper", 6).alias("a"), F.round("supertrend_10_3", 6).alias("b"), F.round("macd_hist", 6).alias("c")
    )
    cut = int(p["timestamp"].iloc[100])
    assert audits.truncation_breaks(work, spark.createDataFrame(p), cut, ["a", "b", "c"]).count() == 0


def test_longest_run_and_pruning(spark):
    p = bars(12, symbols=("A_USDT",), gap=0)
    p["x"] = [1, None, 1, 1, 1, None, 1, 1, None, 1, 1, 1]
    df = spark.createDataFrame(p).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    kept = joins.without_nulls(df, ["x"], "longest_run").toPandas()
    assert sorted(kept["timestamp"]) == p["timestamp"][2:5].tolist()
    assert rows.prune_rows(df, ["x"], "any").count() == 9
    assert rows.prune_rows(df, ["x"], "any", periods=["4h"]).count() == 12
    filled = rows.fill_gaps(df, ["x"]).toPandas()
    assert filled["x"].notna().all()


@pytest.mark.parametrize("raw", ["btcusdt", "BTC/USDT", "BTC-USDT", "BTC/USDT:USDT", " btc_usdt "])
def test_symbol_spellings(spark, raw):
    r = spark.range(1).select(symbols.canonical_symbol(F.lit(raw)), symbols.coin(F.lit(raw)), symbols.pair(F.lit(raw))).first()
    assert tuple(r) == ("BTC_USDT", "BTC", "BTCUSDT")


def test_time_literals_and_periods(spark):
    want = {"1700000000000": 1_700_000_000_000, "1700000000": 1_700_000_000_000, "20231114": 1_699_920_000_000,
            "2023-11-14": 1_699_920_000_000, "2023-11-14T00:00:00Z": 1_699_920_000_000, "later": None}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r["s"]: r["ms"] for r in df.select("s", times.time_literal_ms(F.col("s")).alias("ms")).collect()}
    assert got == want
    df = spark.createDataFrame([("60min",), (" 1 Day",), ("15m",), ("2w",), ("7",)], "s string")
    assert [r[0] for r in df.select(times.period_ms(F.col("s"))).collect()] == [3_600_000, 86_400_000, 900_000, None, None]


def test_epoch_column_rule(spark):
    ms = spark.createDataFrame([(1_700_000_000_000,), (5,), (1_700_000_000_001,)], "t long")
    assert times.with_epoch_ms(ms, "t").agg(F.min("t")).first()[0] == 5
    s = spark.createDataFrame([(1_700_000_000,), (1_700_000_001,)], "t long")
    assert times.with_epoch_ms(s, "t").agg(F.min("t")).first()[0] == 1_700_000_000_000


def test_nan_becomes_null(spark):
    df = nulls.nan_to_null(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double"))
    assert df.filter("x is null").count() == 2


def test_name_rules():
    assert columns.feature_candidates(["timestamp", "close", "target_vol_jump_prob", "future_close", "rsi"]) == ["close", "rsi"]
    assert columns.family_key("x_roll_20") == columns.family_key("x_ewma_5_24h") == columns.family_key("x") == "x"
    assert columns.normalise_name(" Open - Time/ms ") == "open_time_ms"
    assert columns.match_normalised(["close_zn96", "rsi"], ["close_zn56", "rsi"], "4h") == {"close_zn96": "close_zn56", "rsi": "rsi"}
    assert columns.foreign_window_columns(["a_zn96", "a_zn56", "a_mm30"], "4h") == ["a_zn96", "a_mm30"]
    assert experts.pinned_features("Z-Combiner", "rich", ["close", "vwap", "funding_rate"]) == ["close", "vwap"]
    assert "funding_rate_z" in experts.pinned_features("Risk-TFT", "rich", ["atr", "funding_rate_z"])


def test_bar_files_with_any_header(spark, tmp_path):
    d = tmp_path / "1h"
    d.mkdir()
    p = bars(5, symbols=("AAA_USDT",), gap=0)
    plain = p[["timestamp", "open", "high", "low", "close", "volume"]]
    plain.to_csv(d / "AAA_USDT_1h_all.csv", index=False)
    odd = plain.rename(columns={c: f"{c}_BBB_USDT_1h" for c in ("open", "high", "low", "close", "volume")})
    odd.to_csv(d / "BBB_USDT_1h_all.csv")
    got = bar_source.read_bars_csv(spark, str(tmp_path), "1h")
    assert got.columns[0] == "timestamp" and got.count() == 10
    assert {r["symbol"] for r in bar_source.symbols_in(got).collect()} == {"AAA_USDT", "BBB_USDT"}
    assert got.filter("close is null or datetime is null").count() == 0


def test_stored_tables(spark, tmp_path):
    p = bars(20, symbols=("A_USDT",), gap=0)
    df = spark.createDataFrame(p)
    path = str(tmp_path / "bars")
    files.write_long_table(df.limit(15).orderBy("timestamp"), path, narrow=False)
    first = spark.read.parquet(path).agg(F.max("timestamp")).first()[0]
    files.append_bars(df.unionByName(df), path)
    assert spark.read.parquet(path).filter(F.col("timestamp") > first).count() == (p["timestamp"] > first).sum()
    files.write_names(spark, ["a", "b"], str(tmp_path / "names.txt"))
    assert files.read_names(spark, str(tmp_path / "names.txt")) == ["a", "b"]
    (tmp_path / "noted.txt").write_text("# note\na\n\nb\n")
    assert files.read_names(spark, str(tmp_path / "noted.txt")) == ["a", "b"]
    files.write_csv(df, str(tmp_path / "csv"))
    files.csv_to_parquet(spark, str(tmp_path / "csv"), str(tmp_path / "pq"), ["1h"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 20
    checks = files.schema_check(spark, {"a": df, "b": df.select(*reversed(df.columns))}, "a").collect()
    assert [(r["same_set"], r["same_order"]) for r in checks] == [(True, True), (True, False)]


def test_predictions_and_evidence_by_path(spark, tmp_path):
    for e in ("x", "y"):
        d = tmp_path / "pred" / e
        d.mkdir(parents=True)
        pd.DataFrame({"symbol": ["A"], "expert": [e], "score": [0.5]}).to_parquet(d / f"predictions_{e}.parquet")
        (d / "other.parquet").write_bytes((d / f"predictions_{e}.parquet").read_bytes())
    assert files.read_predictions(spark, str(tmp_path / "pred")).count() == 2
    d = tmp_path / "ev" / "1h"
    d.mkdir(parents=True)
    pd.DataFrame({"feature": ["f"], "tree_importance": [0.1]}).to_csv(d / "target_x_importances.csv", index=False)
    r = files.read_evidence(spark, str(tmp_path / "ev")).first()
    assert (r["period"], r["target"]) == ("1h", "target_x")


def test_series_registry(spark, tmp_path):
    idx = tmp_path / "index"
    idx.mkdir()
    (idx / "premium-index.csv").write_text("timestamp,premium,premium_rate\n1700000000,1.5,0.1\n1700086400,2.5,0.2\n")
    (idx / "bitcoin-rhodl_ratio.csv").write_text("a,b\n3.5,1700000000000\n")
    got = series.read_global_series(spark, str(tmp_path))
    row = got.filter("timestamp = 1700000000000").first()
    assert row["premium_premium_index"] == 1.5 and row["cb_premium"] == 1.5
    assert row["rhodl_ratio_bitcoin_bitcoin_rhodl_ratio"] == 3.5
    only = series.read_global_series(spark, str(tmp_path), {"cb_premium": True})
    assert only.columns == ["timestamp", "cb_premium"]
    oi = tmp_path / "futures" / "open-interest"
    oi.mkdir(parents=True)
    (oi / "BTC_USDT_1d.csv").write_text("timestamp,oi_mean_oc,oi_vol\n1700000000000,5,6\n")
    sym = series.read_symbol_series(spark, str(tmp_path), ["BTC_USDT", "ETH_USDT"])
    assert sym.first()["oi_vol"] == 6.0
    assert series.switched_on(series.SYMBOL_SERIES, {"oi": False}, True) == [k for k in series.SYMBOL_SERIES if k != "oi"]


def test_tick_ties_are_settled_by_price(spark):
    t = spark.createDataFrame([("a", 5, 2.0), ("a", 5, 1.0), ("a", 9, 4.0)], "s string, t long, p double")
    r = bar_source.ticks_to_bars(t, "1h", F.col("s"), F.col("t"), F.col("p"), F.lit(1)).first()
    assert (r["open"], r["high"], r["low"], r["close"], r["volume"], r["timestamp"]) == (1.0, 4.0, 1.0, 4.0, 3.0, 0)
    assert STEP == 3_600_000 and len(by_key(bars(3, gap=0))) == 6


def test_no_row_of_an_unknown_key_is_lost(spark):
    """Unknown symbols, periods and times keep their rows through layouts, scans, fills and joins."""
    given = [("a", "1d", DAY * 86_400_000, 1.0), (None, "1d", DAY * 86_400_000, 2.0), ("a", None, DAY * 86_400_000, 3.0), ("a", "1d", None, 4.0), (None, "1d", (DAY + 1) * 86_400_000, None)]
    df = spark.createDataFrame(given, "symbol string, period string, timestamp long, close double").withColumn("volume", F.lit(1.0))
    filled = rows.fill_gaps(df, ["close"]).collect()
    assert len(filled) == 5
    assert sorted((r["close"] for r in filled if r["symbol"] is None)) == [2.0, 2.0], "a group of unknown symbol fills like any other"
    assert splits.with_time_idx(df, ["a"], ["1d"]).count() == 5 and norms.rolling_norms(df, ["close"], 3).count() == 5
    right = spark.createDataFrame([("a", 0, 7.0), (None, 0, 8.0)], "symbol string, timestamp long, x double")
    out = joins.asof_join(df, right, ["symbol"], "timestamp", ["x"]).collect()
    assert len(out) == 5 and {r["x"] for r in out if r["symbol"] is None or r["timestamp"] is None} == {None}
    assert {r["x"] for r in out if r["symbol"] and r["timestamp"]} == {7.0}


DAY = 19_000
