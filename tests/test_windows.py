"""Chunked windows, scans and kernels against plain pandas on whole groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import frames as fr
from barloom.operators import indicators, kernels, labels, market, norms, splits
from barloom.operators.chunks import halo_chunks, time_bucket
from barloom.operators.scan import bucketed_scan
from frames import bars, by_key

KEYS = ["symbol", "period"]


def test_frames_across_chunk_seams(spark, tiny_chunks):
    p = by_key(bars())
    ck = halo_chunks(spark.createDataFrame(p), back=30, ahead=4)
    assert ck.df.select("_chunk").distinct().count() > 4
    out = ck.df.withColumns(
        {
            "m": fr.mean(F.col("close"), ck.w, 30),
            "s": fr.std(F.col("close"), ck.w, 20, 5, lag=1),
            "nxt": F.lead("close", 4).over(ck.w),
            "pos": ck.position(),
        }
    )
    got = by_key(ck.owned(out).toPandas())
    assert len(got) == len(p)
    g = p.groupby(KEYS)["close"]
    np.testing.assert_allclose(got["m"], g.transform(lambda s: s.rolling(30).mean()), rtol=1e-12)
    np.testing.assert_allclose(got["s"], g.transform(lambda s: s.shift(1).rolling(20, min_periods=5).std()), rtol=1e-9)
    np.testing.assert_allclose(got["nxt"], g.transform(lambda s: s.shift(-4)), rtol=0)
    assert (got["pos"] == p.groupby(KEYS).cumcount()).all()


def test_scan_over_buckets(spark):
    p = by_key(bars(200, gap=0.3))
    p["x"] = p["volume"].where(p["volume"] > 25)
    df = spark.createDataFrame(p).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    df = df.withColumn("b", F.floor(F.col("timestamp") / (3_600_000 * 7)))
    out = bucketed_scan(df, KEYS, ["timestamp"], "b", sums={"s": F.col("x")}, lasts={"l": F.col("x")}, peaks={"m": F.col("x")})
    got = by_key(out.toPandas())
    g = p.groupby(KEYS)["x"]
    np.testing.assert_allclose(got["s"], g.cumsum().groupby([p[k] for k in KEYS]).ffill(), rtol=1e-12)
    np.testing.assert_allclose(got["l"], g.ffill(), rtol=0)
    np.testing.assert_allclose(got["m"], g.cummax().groupby([p[k] for k in KEYS]).ffill(), rtol=0)
    before = by_key(bucketed_scan(df, KEYS, ["timestamp"], "b", lasts={"l": F.col("x")}, before=True).toPandas())
    np.testing.assert_allclose(before["l"], g.ffill().groupby([p[k] for k in KEYS]).shift(1), rtol=0)


def test_recursive_averages_across_chunks(spark, tiny_chunks):
    p = by_key(bars(1500, symbols=("AAA_USDT",)))
    got = by_key(indicators.compute(spark.createDataFrame(p), ["macd", "adx", "kdj", "tsi"]).toPandas())
    c = p["close"]
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd_hist"], line - line.ewm(span=9, adjust=False).mean(), rtol=1e-9, atol=1e-9)
    lo, hi = p["low"].rolling(9, min_periods=1).min(), p["high"].rolling(9, min_periods=1).max()
    k = ((c - lo) / (hi - lo) * 100).ewm(com=2).mean()
    np.testing.assert_allclose(got["kdj_k"], k.fillna(0), rtol=1e-9, atol=1e-9)
    assert got["adx"].between(0, 100).all() and got["tsi"].between(-1.0001, 1.0001).all()


def _stop_by_hand(high, low, step=0.02, cap=0.2):
    out, bull, af, top, bottom = [0.0], True, step, high[0], low[0]
    for i in range(1, len(high)):
        two = i - 2 if i > 1 else i - 1
        if bull:
            s = min(out[-1] + af * (top - out[-1]), low[i - 1], low[two])
            if high[i] > top:
                top, af = high[i], min(cap, af + step)
            if low[i] < s:
                bull, s, bottom, af = False, top, low[i], step
        else:
            s = max(out[-1] + af * (bottom - out[-1]), high[i - 1], high[two])
            if low[i] < bottom:
                bottom, af = low[i], min(cap, af + step)
            if high[i] > s:
                bull, s, top, af = True, bottom, high[i], step
        out.append(s)
    return out


@pytest.mark.parametrize("warmup", [2, 64])
def test_parabolic_stop_repairs_its_seams(spark, tiny_chunks, warmup):
    """With a warm-up of two rows most guesses are wrong and have to be repaired."""
    p = by_key(bars(300))
    got = by_key(kernels.parabolic_stop(spark.createDataFrame(p), warmup=warmup).toPandas())
    want = np.concatenate([_stop_by_hand(g["high"].tolist(), g["low"].tolist()) for _, g in p.groupby(KEYS)])
    np.testing.assert_array_equal(got["psar"], want)


def test_groups_do_not_touch_and_row_order_is_free(spark, tiny_chunks):
    both, one = bars(200), bars(200, symbols=("AAA_USDT",))
    cols = ["rsi", "boll_upper", "obv", "vwap"]
    run = lambda p: by_key(
        indicators.compute(spark.createDataFrame(p), ["relative_strength", "bollinger", "on_balance"]).toPandas()
    )
    whole = run(both.sample(frac=1, random_state=1))
    alone = run(one)
    part = whole[whole.symbol == "AAA_USDT"].reset_index(drop=True)
    np.testing.assert_allclose(part[cols], alone[cols], rtol=1e-12)
    assert whole["rsi"].between(0, 100).all()


def test_short_and_flat_groups(spark):
    p = pd.DataFrame(
        {"timestamp": [0, 3_600_000], "open": 5.0, "high": 5.0, "low": 5.0, "close": 5.0, "volume": 0.0, "symbol": ["A", "A"], "period": "1h"}
    )
    p = pd.concat([p, p.iloc[:1].assign(symbol="B")])
    names = ["bollinger", "relative_strength", "money_flow", "channels", "on_balance", "tail_risk", "true_range", "adx", "kdj"]
    got = indicators.compute(spark.createDataFrame(p), names).toPandas()
    assert len(got) == 3
    assert got[["boll_upper", "mfi", "cmf", "obv", "vwap", "kdj_k"]].notna().all().all()
    assert (got["kdj_k"] == 0).all() and (got["vwap"] == 0).all()


def test_wide_norms_equal_frames(spark, tiny_chunks):
    p = by_key(bars(300))
    p.loc[p.index % 7 == 0, "open"] = np.nan
    df = spark.createDataFrame(p).withColumn("open", F.when(~F.isnan("open"), F.col("open")))
    cols = ["open", "close", "volume"]
    a = by_key(norms.rolling_norms(df, cols, 24, min_periods=10, wide=False).toPandas())
    b = by_key(norms.rolling_norms(df, cols, 24, min_periods=10, wide=True).toPandas())
    names = [f"{c}_{k}24" for c in cols for k in ("zn", "mm")]
    np.testing.assert_allclose(a[names], b[names], rtol=1e-7, atol=1e-9)
    assert a[[n for n in names if "zn" in n]].abs().max().max() <= 5
    assert a[[n for n in names if "mm" in n]].stack().between(0, 1).all()


def test_volume_profile_is_the_histogram(spark, tiny_chunks):
    p = by_key(bars(150, symbols=("AAA_USDT",), period="1d").assign(timestamp=lambda d: d["timestamp"] * 24))
    got = by_key(market.volume_profile(spark.createDataFrame(p), "1d").toPandas())
    want = [np.nan] * len(p)
    for i in range(29, len(p)):
        c, v = p["close"].iloc[max(0, i - 59) : i + 1], p["volume"].iloc[max(0, i - 59) : i + 1]
        hist, edges = np.histogram(c, bins=20, range=(c.min(), c.max()), weights=v)
        want[i] = (edges[hist.argmax()] + edges[hist.argmax() + 1]) / 2
    np.testing.assert_allclose(got["volume_profile_hvn"], pd.Series(want).shift(1), rtol=1e-12)


def test_labels_keep_runs_across_chunks(spark, tiny_chunks):
    p = by_key(bars(600, symbols=("AAA_USDT",)))
    p["atr"] = p["high"] - p["low"]
    got = by_key(labels.with_labels(spark.createDataFrame(p), "1h").toPandas())
    f = np.log(p["close"].shift(-1) / p["close"])
    d = np.sign(f.fillna(0))
    same = d.shift(1).fillna(0) == d
    assert (got["target_trend_persistence"] == same.groupby((~same).cumsum()).cumsum() + 1).all()
    up = f > 0
    assert (got["target_breakout_count"] == up.groupby((~up).cumsum()).cumsum()).all()
    cum = f.cumsum()
    np.testing.assert_allclose(got["target_max_drawdown"], cum - cum.rolling(96, min_periods=1).max(), atol=1e-10)


def test_splits_and_windows(spark, tiny_chunks):
    p = by_key(bars(120))
    df = spark.createDataFrame(p)
    got = by_key(splits.ratio_split(df, 0.25).toPandas())
    for _, g in got.groupby(KEYS):
        assert g["is_val"].tolist() == [False] * int(len(g) * 0.75) + [True] * (len(g) - int(len(g) * 0.75))
    w = splits.supervised_windows(df, ["close"], "volume", 5).toPandas()
    assert len(w) == sum(len(g) - 5 for _, g in p.groupby(KEYS))
    capped = splits.sample_cap(df, 20, ["symbol", "timestamp"])
    assert sorted(capped.toPandas()["timestamp"]) == sorted(splits.sample_cap(df.repartition(5), 20, ["symbol", "timestamp"]).toPandas()["timestamp"])


def test_warm_up(spark, tiny_chunks):
    p = by_key(bars(100))
    df = norms.rolling_norms(spark.createDataFrame(p), ["close"], 24)
    got = norms.trim_warm_up(df, 24, ["close_zn24"], time_bucket(df)).toPandas()
    assert len(got) == sum(len(g) - 24 for _, g in p.groupby(KEYS)) and got["close_zn24"].notna().all()


def test_undeclared_periods_are_kept(spark, tiny_chunks):
    p = by_key(bars(90, period="2h"))
    df = spark.createDataFrame(p)
    assert indicators.compute(df, ["moving_averages"]).count() == len(p)
    got = by_key(splits.with_time_idx(df).toPandas())
    assert (got["time_idx"] == p.groupby(KEYS).cumcount()).all()
