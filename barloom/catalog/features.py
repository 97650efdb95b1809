"""Normalisation, cross-section, regime core, derivative series and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from barloom.catalog.indicators import ALL, ATR, BASE, KEY, RSI, W, full, over
from barloom.catalog.tables import bars, bars_sql, settle_sql, settled
from barloom.operators import indicators as ind, labels, market, norms
from barloom.operators.chunks import time_bucket
from barloom.schema import PERIODS
from barloom.sources.staging import staged

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def each_period(fn, periods=ALL):
    """Run fn(bars of p, p) per period and union the results."""

    def run(spark, sf):
        return reduce(DataFrame.unionByName, [fn(bars(spark, sf, p), p) for p in periods])

    return run


def select_sql(p: tuple[str, ...], ctes: str, cols, src: str, ints=(), where: str = "", recursive: str = "RECURSIVE "):
    sel = ", ".join(c if c in ints else settle_sql(c) for c in cols)
    return f"WITH {recursive}{bars_sql(*p)},{BASE},\n{ctes}\nSELECT symbol, period, timestamp, {sel} FROM {src} {where}"


def union_sql(build, periods=ALL):
    return " UNION ALL ".join(f"SELECT * FROM ({build(p)})" for p in periods)


# --- the minimum slice --------------------------------------------------------------------------

_SLICE = ["rsi", "boll_upper", "boll_lower", "close_zn96", "target_binarytrend"]


@query
def feature_label_slice(spark, sf):
    df = ind.compute(bars(spark, sf, "1h"), ["relative_strength", "bollinger"])
    df = norms.rolling_norms(staged(df, "indicators"), ["close"], 96, methods=("z",))
    df = labels.with_future_close(staged(df, "norms"))
    up = F.coalesce((F.col("future_close") > F.col("close")).cast("int"), F.lit(0))
    return settled(df.withColumn("target_binarytrend", up), KEY, _SLICE)


ORACLE["feature_label_slice"] = select_sql(
    ("1h",),
    RSI
    + f""", q0 AS (SELECT *, {full('avg(close)', 'close', 20)} AS m, {full('stddev_samp(close)', 'close', 20)} AS dev,
        {full('avg(close)', 'close', 96, lag=1)} AS zm, {full('stddev_samp(close)', 'close', 96, lag=1)} AS zs,
        lead(close) OVER ({W}) AS nc FROM rs),
    q AS (SELECT *, coalesce(coalesce(m, 0) + 2 * dev, 0) AS boll_upper, coalesce(coalesce(m, 0) - 2 * dev, 0) AS boll_lower,
        CASE WHEN zm IS NOT NULL THEN least(greatest((close - zm) / (abs(zs) + 1e-7), -5), 5) END AS close_zn96,
        CAST(coalesce(nc > close, false) AS INT) AS target_binarytrend FROM q0)""",
    _SLICE,
    "q",
    ("target_binarytrend",),
)

# --- rolling normalisation, lag guard, slopes, warm-up ------------------------------------------


def _norm_cols(p):
    w = PERIODS[p].norm_window
    return [f"{c}_{k}{w}" for c in ("close", "volume", "amplitude_range") for k in ("zn", "mm")]


def _norms(b, p):
    df = b.withColumn("amplitude_range", F.col("high") - F.col("low"))
    w = PERIODS[p].norm_window
    out = norms.rolling_norms(df, ["close", "volume", "amplitude_range"], w)
    plain = {c: c.replace(f"_zn{w}", "_zn").replace(f"_mm{w}", "_mm") for c in _norm_cols(p)}
    return settled(out, KEY, _norm_cols(p)).withColumnsRenamed(plain)


QUERIES["rolling_norms"] = each_period(_norms)


def _norms_sql(p):
    w = PERIODS[p].norm_window
    xs = {"close": "close", "volume": "volume", "amplitude_range": "amp"}
    stats, out = [], []
    for name, x in xs.items():
        for agg, k in (("avg", "m"), ("stddev_samp", "s"), ("min", "lo"), ("max", "hi")):
            stats.append(f"{full(f'{agg}({x})', x, w, lag=1)} AS {x}_{k}")
        out.append(f"CASE WHEN {x}_m IS NOT NULL THEN least(greatest(({x} - {x}_m) / (abs({x}_s) + 1e-7), -5), 5) END AS {name}_zn")
        out.append(f"CASE WHEN {x}_lo IS NOT NULL THEN least(greatest(({x} - {x}_lo) / (abs({x}_hi - {x}_lo) + 1e-7), 0), 1) END AS {name}_mm")
    ctes = f"a0 AS (SELECT *, high - low AS amp FROM b), n0 AS (SELECT *, {', '.join(stats)} FROM a0), n AS (SELECT *, {', '.join(out)} FROM n0)"
    return select_sql((p,), ctes, [f"{c}_{k}" for c in xs for k in ("zn", "mm")], "n")


ORACLE["rolling_norms"] = union_sql(_norms_sql)


@query
def lag_guard_and_slopes(spark, sf):
    """The 24h differences and slopes of lagged indicators."""
    df = ind.compute(bars(spark, sf, "4h"), ["relative_strength", "money_flow"])
    df = norms.guarded_slopes(staged(df.select(*KEY, "stoch_rsi", "mfi"), "indicators"), "4h")
    return settled(df, KEY)


ORACLE["lag_guard_and_slopes"] = select_sql(
    ("4h",),
    RSI
    + f""", z AS (SELECT *, (rsi - min(rsi) {over(14)}) / (max(rsi) {over(14)} - min(rsi) {over(14)} + 1e-10) AS sr, lag(tp) OVER ({W}) AS ptp FROM rs),
    y AS (SELECT *, sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) {over(14)} AS p, sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) {over(14)} AS n FROM z),
    g1 AS (SELECT *, lag(sr) OVER ({W}) AS stoch_rsi, lag(100 - 100 / (1 + p / (n + 1e-10))) OVER ({W}) AS mfi FROM y),
    g2 AS (SELECT *, stoch_rsi - lag(stoch_rsi) OVER ({W}) AS stoch_rsi_diff1, mfi - lag(mfi) OVER ({W}) AS mfi_diff1,
        CASE WHEN count(mfi) {over(6)} >= 3 AND count(mfi) {over(6)} = count(*) {over(6)} THEN regr_slope(mfi, pos) {over(6)} END AS mfi_slope_24h,
        CASE WHEN count(stoch_rsi) {over(6)} >= 3 AND count(stoch_rsi) {over(6)} = count(*) {over(6)} THEN regr_slope(stoch_rsi, pos) {over(6)} END AS stoch_rsi_slope_24h
        FROM g1)""",
    ["stoch_rsi", "mfi", "stoch_rsi_diff1", "mfi_diff1", "mfi_slope_24h", "stoch_rsi_slope_24h"],
    "g2",
)


@query
def warm_up_trim(spark, sf):
    b = bars(spark, sf, "1d")
    out = norms.rolling_norms(b, ["close", "volume"], 30)
    cols = ["close_zn30", "close_mm30", "volume_zn30", "volume_mm30"]
    return settled(norms.trim_warm_up(out, 30, cols, time_bucket(out)), KEY, ["close_zn30", "volume_mm30"])


ORACLE["warm_up_trim"] = select_sql(
    ("1d",),
    f"""n0 AS (SELECT *, {full('avg(close)', 'close', 30, lag=1)} AS m, {full('stddev_samp(close)', 'close', 30, lag=1)} AS s,
        {full('min(volume)', 'volume', 30, lag=1)} AS lo, {full('max(volume)', 'volume', 30, lag=1)} AS hi FROM b),
    n AS (SELECT *, least(greatest((close - m) / (abs(s) + 1e-7), -5), 5) AS close_zn30,
        least(greatest((volume - lo) / (abs(hi - lo) + 1e-7), 0), 1) AS volume_mm30 FROM n0 WHERE pos > 30 AND m IS NOT NULL AND lo IS NOT NULL)""",
    ["close_zn30", "volume_mm30"],
    "n",
)

# --- cross-section ------------------------------------------------------------------------------

_BENCH = {"1h": "click", "4h": "click", "1d": "BUILDING"}


def _beta(b, p):
    out = market.benchmark_beta(b, market.benchmark_returns(b, _BENCH[p]), p)
    return settled(out, KEY, ["r_sym", "r_btc", "beta_btc_60d"])


QUERIES["benchmark_beta"] = each_period(_beta)


def _beta_sql(p):
    n = PERIODS[p].bars_60d
    mp = max(n // 2, 30)
    m = lambda x: full(f"avg({x})", x, n, mp)
    ctes = f"""bm AS (SELECT period, timestamp, r AS rb FROM b WHERE symbol = '{_BENCH[p]}'),
    j0 AS (SELECT b.*, r AS r_sym, rb AS r_btc, r * rb AS xy, rb * rb AS yy FROM b LEFT JOIN bm USING (period, timestamp)),
    j AS (SELECT *, {m('xy')} - {m('r_sym')} * {m('r_btc')} AS cov, {m('yy')} - {m('r_btc')} * {m('r_btc')} AS vb FROM j0),
    x AS (SELECT *, lag(CASE WHEN vb <> 0 THEN cov / vb END) OVER ({W}) AS beta_btc_60d FROM j)"""
    return select_sql((p,), ctes, ["r_sym", "r_btc", "beta_btc_60d"], "x")


ORACLE["benchmark_beta"] = union_sql(_beta_sql)


def _profile(b, p):
    return settled(market.volume_profile(b, p), KEY, ["volume_profile_hvn", "volume_profile_lvn"])


QUERIES["volume_profile"] = each_period(_profile)


def _profile_sql(p):
    s = PERIODS[p]
    n, k, mp = s.bars_60d, s.profile_bins, max(s.bars_60d // 2, 30)
    ctes = f"""win AS (SELECT a.symbol, a.period, a.timestamp, a.pos, c.close, c.volume FROM b a JOIN b c
        ON c.symbol = a.symbol AND c.period = a.period AND c.pos BETWEEN a.pos - {n - 1} AND a.pos WHERE a.pos >= {mp}),
    ext AS (SELECT symbol, period, pos, min(close) AS lo, max(close) AS hi FROM win GROUP BY ALL HAVING max(close) > min(close)),
    hist AS (SELECT symbol, period, pos, lo, hi, least(CAST(floor((close - lo) / (hi - lo) * {k}) AS INT), {k - 1}) AS bin, sum(volume) AS v
        FROM win JOIN ext USING (symbol, period, pos) GROUP BY ALL),
    node AS (SELECT symbol, period, pos, any_value(lo) AS lo, any_value(hi) AS hi, arg_max(bin, v * 1000 - bin) AS top,
        arg_min(bin, v * 1000 + bin) FILTER (WHERE v > 0) AS bot FROM hist GROUP BY ALL),
    y AS (SELECT b.symbol, b.period, b.timestamp, b.pos, lo + (top + 0.5) * (hi - lo) / {k} AS h0, lo + (bot + 0.5) * (hi - lo) / {k} AS l0
        FROM b LEFT JOIN node USING (symbol, period, pos)),
    x AS (SELECT *, lag(h0) OVER ({W}) AS volume_profile_hvn, lag(l0) OVER ({W}) AS volume_profile_lvn FROM y)"""
    return select_sql((p,), ctes, ["volume_profile_hvn", "volume_profile_lvn"], "x")


ORACLE["volume_profile"] = union_sql(_profile_sql)


@query
def trend_agreement(spark, sf):
    """Hourly bars with the latest 4h direction; daily bars come from other symbols and add nothing."""
    trends = {
        p: ind.compute(bars(spark, sf, p), ["moving_averages"]).select("symbol", "timestamp", "ma5", "ma20")
        for p in ("1h", "4h")
    }
    return market.trend_agreement(trends, on="1h")


ORACLE["trend_agreement"] = f"""WITH {bars_sql('1h', '4h')},{BASE},
m AS (SELECT *, sign(coalesce({full('avg(close)', 'close', 5)}, 0) - coalesce({full('avg(close)', 'close', 20)}, 0)) AS dir FROM b),
h AS (SELECT * FROM m WHERE period = '1h'), f AS (SELECT symbol, timestamp, dir FROM m WHERE period = '4h')
SELECT h.symbol, h.period, h.timestamp, CAST(h.dir + coalesce(f.dir, 0) AS DOUBLE) AS trend_agree_multi
FROM h ASOF LEFT JOIN f ON h.symbol = f.symbol AND h.timestamp >= f.timestamp"""

_REGIME = ["realized_vol", "ewma_vol", "volume_change", "funding_rate_slope", "open_interest_slope", "momentum_fast",
           "momentum_slow", "atr_slope", "structural_gap"]


@query
def regime_core(spark, sf):
    df = ind.compute(bars(spark, sf, "1d"), ["true_range"]).drop("atr_slope")
    df = df.withColumns({"funding_rate": F.col("open") / F.col("high"), "open_interest": F.col("volume") * 2})
    return settled(market.regime_core(df), KEY, _REGIME)


def ewm_variance(src: str, x: str, alpha: str, adjust: bool, name: str = "ev") -> str:
    """Debiased exponential variance as a recursion; the input is unknown only on the first bar."""
    f, new = f"(1 - {alpha})", "1.0" if adjust else alpha
    old = f"(p.ow * {f})"
    mean = f"(({old} * p.mu + {new} * n.{x}) / ({old} + {new}))"
    cov = f"(({old} * (p.cv + (p.mu - {mean}) ** 2) + {new} * (n.{x} - {mean}) ** 2) / ({old} + {new}))"
    w1, w2, ow = f"(p.w1 * {f} + {new})", f"(p.w2 * {f} * {f} + {new} * {new})", f"({old} + {new})"
    start = {"mu": f"n.{x}", "cv": "0.0", "w1": "1.0", "w2": "1.0", "ow": "1.0"}
    if adjust:
        step = {"mu": mean, "cv": cov, "w1": w1, "w2": w2, "ow": ow}
    else:
        step = {"mu": mean, "cv": cov, "w1": f"({w1} / {ow})", "w2": f"({w2} / ({ow} * {ow}))", "ow": "1.0"}
    from barloom.catalog.recursive import recursion

    state = {c: ("NULL", f"CASE WHEN p.mu IS NULL THEN {start[c]} ELSE {step[c]} END") for c in start}
    return (
        recursion(name + "_rec", src, state)
        + f""", {name} AS (SELECT symbol, period, timestamp,
        CASE WHEN w1 * w1 - w2 > 0 THEN sqrt(w1 * w1 / (w1 * w1 - w2) * cv) END AS {name}_std FROM {name}_rec)"""
    )


ORACLE["regime_core"] = select_sql(
    ("1d",),
    f"""a0 AS (SELECT *, avg(tr) {over(14)} AS atr, open / high AS fr, volume * 2 AS oi, close / pc - 1 AS ret FROM b),
    g AS MATERIALIZED (SELECT *, {full('stddev_samp(ret)', 'ret', 24)} AS realized_vol, dv AS volume_change,
        fr - lag(fr) OVER ({W}) AS funding_rate_slope, oi - lag(oi) OVER ({W}) AS open_interest_slope,
        close / lag(close, 24) OVER ({W}) - 1 AS momentum_fast, close / lag(close, 72) OVER ({W}) - 1 AS momentum_slow,
        atr - lag(atr) OVER ({W}) AS atr_slope,
        (close - ({full('max(high)', 'high', 72)} + {full('min(low)', 'low', 72)}) / 2) / close AS structural_gap FROM a0),
    {ewm_variance('g', 'ret', '(2.0/13)', True)},
    x AS (SELECT g.*, ev_std AS ewma_vol FROM g JOIN ev USING (symbol, period, timestamp))""",
    _REGIME,
    "x",
)


@query
def open_interest_features(spark, sf):
    return settled(
        market.open_interest_features(bars(spark, sf, "1d"), "1d"),
        KEY,
        ["oi_mean_oc", "oi_logret", "oi_vol", "oi_mean_oc_z"],
    )


ORACLE["open_interest_features"] = select_sql(
    ("1d",),
    f"""o0 AS (SELECT *, (open + close) / 2 AS oi_mean_oc FROM b),
    o1 AS (SELECT *, r AS oi_logret, {full('avg(tr)', 'tr', 30, 10)} AS oi_vol, {full('avg(oi_mean_oc)', 'oi_mean_oc', 30, 10, 1)} AS mu,
        {full('stddev_pop(oi_mean_oc)', 'oi_mean_oc', 30, 10, 1)} AS sd FROM o0),
    o AS (SELECT *, CASE WHEN sd > 0 THEN (oi_mean_oc - mu) / (sd + 1e-12) END AS oi_mean_oc_z FROM o1)""",
    ["oi_mean_oc", "oi_logret", "oi_vol", "oi_mean_oc_z"],
    "o",
)

for _m in ("z", "r", "m"):

    def _taker(spark, sf, m=_m):
        df = bars(spark, sf, "1d").withColumns({"buy": F.col("high") * F.col("volume"), "sell": F.col("low") * F.col("volume")})
        out = market.taker_imbalance(df, "buy", "sell", 30, method=m)
        return settled(out, KEY, ["taker_imbalance", f"buy_{m}", f"sell_{m}", f"taker_imbalance_{m}"])

    def _taker_sql(m=_m):
        a, b = {
            "z": ("avg({x})", "stddev_pop({x})"),
            "r": ("median({x})", None),
            "m": ("min({x})", None),
        }[m]
        stats, out = [], []
        for x in ("buy", "sell", "imb"):
            f = lambda agg: full(agg.format(x=x), x, 30, 8, 1)  # noqa: E731, B023
            scale = {
                "z": f("stddev_pop({x})"),
                "r": f("quantile_cont({x}, 0.75)") + " - " + f("quantile_cont({x}, 0.25)"),
                "m": f("max({x})") + " - " + f("min({x})"),
            }[m]
            stats.append(f"{f(a)} AS {x}_a, {scale} AS {x}_b")
            name = "taker_imbalance" if x == "imb" else x
            out.append(f"CASE WHEN {x}_b <> 0 THEN ({x} - {x}_a) / {x}_b END AS {name}_{m}")
        ctes = f"""k0 AS (SELECT *, high * volume AS buy, low * volume AS sell,
            (high * volume - low * volume) / (high * volume + low * volume + 1e-12) AS imb FROM b),
        k1 AS (SELECT *, {', '.join(stats)} FROM k0), k AS (SELECT *, imb AS taker_imbalance, {', '.join(out)} FROM k1)"""
        return select_sql(("1d",), ctes, ["taker_imbalance", f"buy_{m}", f"sell_{m}", f"taker_imbalance_{m}"], "k")

    QUERIES[f"taker_imbalance_{_m}"] = _taker
    ORACLE[f"taker_imbalance_{_m}"] = _taker_sql()


@query
def compounded_rate(spark, sf):
    """Seven-day compounded rate at every 4h bar."""
    df = bars(spark, sf, "4h").withColumn("rate", (F.col("close") - F.col("open")) / F.col("open") / 100)
    return settled(market.compounded_rate(df, "rate", 7 * 86_400_000), KEY, ["accumulated"])


ORACLE["compounded_rate"] = select_sql(
    ("4h",),
    """x AS (SELECT *, exp(sum(ln(1 + coalesce((close - open) / open / 100, 0))) OVER (PARTITION BY symbol, period ORDER BY timestamp
        RANGE BETWEEN 604799999 PRECEDING AND CURRENT ROW)) - 1 AS accumulated FROM b)""",
    ["accumulated"],
    "x",
)

# --- labels -------------------------------------------------------------------------------------

_LABELS = [
    "future_close", "rolling_volatility", "parkinson_volatility", "ewmavolatility", "return_skewness", "tail_bias_norm",
    "amplitude_range", "atr_slope", "target_logreturn", "target_logsharpe_ratio", "target_return_outlier_lower_10",
    "target_return_outlier_upper_90", "logreturn_pct_rank", "target_binarytrend", "target_max_drawdown",
    "target_drawdown_prob", "target_trend_persistence", "target_pullback_prob", "target_sideway_detect",
    "target_breakout_count", "target_vol_jump_prob", "target_realized_vol", "target_breakout_prob",
]
_LABEL_INTS = (
    "target_return_outlier_lower_10", "target_return_outlier_upper_90", "target_binarytrend", "target_drawdown_prob",
    "target_trend_persistence", "target_pullback_prob", "target_sideway_detect", "target_breakout_count",
    "target_vol_jump_prob", "target_breakout_prob",
)


def _labelled(b, p, forward=False):
    df = ind.compute(b, ["true_range"]).select(*KEY, "open", "high", "low", "close", "volume", "atr")
    return labels.with_labels(staged(df, "indicators"), p, forward)


# The first-bar tie rule: a drawdown of a running total is compared with zero, so it is settled first.
QUERIES["labels"] = each_period(lambda b, p: settled(_labelled(b, p), KEY, _LABELS))


def label_ctes(p: str, forward: bool = False) -> str:
    s = PERIODS[p]
    n, jw, jl, bn = s.norm_window, s.jump_window, s.jump_base, s.breakout_window
    ahead = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND {jw - 1} FOLLOWING)"
    fwd = lambda agg: f"(CASE WHEN count(f1) {ahead} >= {jw} THEN {agg} {ahead} END)"
    jump = fwd("stddev_samp(f1)") if forward else full("stddev_samp(f1)", "f1", jw)
    square = fwd("sum(f1 * f1)") if forward else full("sum(f1 * f1)", "f1", jw)
    return f"""{ATR},
    l0 AS MATERIALIZED (SELECT *, lead(close) OVER ({W}) AS future_close, ln(lead(close) OVER ({W}) / close) AS f,
        ln(high / low) ** 2 AS hl2, atr - patr AS atr_slope FROM t),
    {ewm_variance('l0', 'r', f'(2.0/{max(2, n // 2) + 1})', False)},
    l1 AS (SELECT l0.*, coalesce(ev_std, 0) AS ewmavolatility, ln(1 + coalesce({full('stddev_samp(r)', 'r', n)}, 0)) AS rolling_volatility,
        ln(1 + coalesce({full('avg(hl2)', 'hl2', n)}, 0)) AS parkinson_volatility,
        {full('quantile_cont(r, 0.1)', 'r', n)} AS p10, {full('quantile_cont(r, 0.9)', 'r', n)} AS p90,
        {full('skewness(r)', 'r', n)} * ({n} - 2) / sqrt({n}.0 * ({n} - 1)) AS return_skewness,
        list(r) {over(n)} AS rs_, lead(f) OVER ({W}) AS f1, sign(coalesce(f, 0)) AS dir, CAST(coalesce(f > 0, false) AS INT) AS up,
        CASE WHEN f IS NOT NULL THEN sum(f) OVER ({W} ROWS UNBOUNDED PRECEDING) END AS cum,
        {full('max(high)', 'high', bn, 2)} AS hi, {full('min(low)', 'low', bn, 2)} AS lo, {full('avg(volume)', 'volume', max(2, bn // 4))} AS vm
        FROM l0 JOIN ev USING (symbol, period, timestamp)),
    l2 AS (SELECT *, cum - max(cum) {over(n)} AS dd, coalesce(lag(dir) OVER ({W}), 0) AS pdir, list_filter(rs_, lambda e: e IS NOT NULL) AS rs2,
        {full('avg(rolling_volatility)', 'rolling_volatility', max(2, n // 2))} AS calm,
        {full('avg(rolling_volatility)', 'rolling_volatility', jl)} AS hist, {jump} AS jump, {square} AS sq FROM l1),
    l3 AS (SELECT *, last_value(CASE WHEN pdir <> dir THEN pos END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS turn,
        last_value(CASE WHEN up = 0 THEN pos END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS fall FROM l2),
    lab AS (SELECT *, (high + low - 2 * close) / (atr + 1e-6) AS tail_bias_norm, high - low AS amplitude_range, f AS target_logreturn,
        f / (rolling_volatility + 1e-6) AS target_logsharpe_ratio,
        CAST(coalesce(f < p10, false) AS INT) AS target_return_outlier_lower_10, CAST(coalesce(f > p90, false) AS INT) AS target_return_outlier_upper_90,
        CASE WHEN len(rs2) = {n} THEN (len(list_filter(rs2, lambda e: e < r)) + (len(list_filter(rs2, lambda e: e = r)) + 1) / 2.0) / {n} END AS logreturn_pct_rank,
        up AS target_binarytrend, dd AS target_max_drawdown, CAST(coalesce(dd < 0, false) AS INT) AS target_drawdown_prob,
        pos - coalesce(turn, 0) + 1 AS target_trend_persistence, pos - coalesce(fall, 0) AS target_breakout_count,
        CAST(coalesce(lag(up) OVER ({W}) <> up AND lag(up, 2) OVER ({W}) = up, false) AS INT) AS target_pullback_prob,
        CAST(coalesce(calm < 0.02 AND abs(f) < 0.001, false) AS INT) AS target_sideway_detect,
        CAST(coalesce(jump / (hist + 1e-6), 0) >= {s.jump_tau} AS INT) AS target_vol_jump_prob,
        sqrt(sq + 1e-12) * sqrt({s.bars_per_year}.0) AS target_realized_vol,
        CAST(coalesce((future_close >= hi * (1 + {s.breakout_eps}) OR future_close <= lo * (1 - {s.breakout_eps}))
            AND volume / (vm + 1e-6) >= {s.breakout_volume}, false) AS INT) AS target_breakout_prob FROM l3)"""


ORACLE["labels"] = union_sql(lambda p: select_sql((p,), label_ctes(p), _LABELS, "lab", _LABEL_INTS))

_FWD = ["target_vol_jump_prob", "target_realized_vol"]
QUERIES["labels_forward_windows"] = each_period(lambda b, p: settled(_labelled(b, p, True), KEY, _FWD), ("1d",))
ORACLE["labels_forward_windows"] = select_sql(("1d",), label_ctes("1d", True), _FWD, "lab", _LABEL_INTS)


@query
def essential_label_rows(spark, sf):
    out = labels.drop_unlabelled(_labelled(bars(spark, sf, "1d"), "1d"))
    return settled(out, KEY, ["target_logreturn", "target_realized_vol"])


ORACLE["essential_label_rows"] = select_sql(
    ("1d",), label_ctes("1d"), ["target_logreturn", "target_realized_vol"], "lab", (),
    "WHERE target_logreturn IS NOT NULL AND target_logsharpe_ratio IS NOT NULL AND target_realized_vol IS NOT NULL",
)


@query
def label_fill_report(spark, sf):
    return settled(labels.label_fill(_labelled(bars(spark, sf, "1d"), "1d")), ["rows", "label", "valid"])


_T = [c for c in _LABELS if c.startswith("target_")]
ORACLE["label_fill_report"] = (
    f"WITH RECURSIVE {bars_sql('1d')},{BASE},\n{label_ctes('1d')}\n"
    + " UNION ALL ".join(
        f"SELECT count(*) AS rows, '{c}' AS label, count({c}) AS valid, {settle_sql(f'(count({c}) / count(*))', 'share')} FROM lab"
        for c in _T
    )
)


@query
def fund_flow_strength(spark, sf):
    df = bars(spark, sf, "1d").select(
        *KEY,
        F.col("open").alias("exch_netflow"),
        F.col("volume").alias("stablecoin_mcap"),
        (F.col("high") - F.col("low")).alias("etf_flow"),
        (F.col("close") - F.col("open")).alias("cb_premium"),
    )
    return settled(labels.fund_flow_strength(df), KEY, ["target_fundflow_strength"])


def _z(x):
    return f"(({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER ())"


ORACLE["fund_flow_strength"] = select_sql(
    ("1d",),
    f"""q AS (SELECT *, high - low AS ef, close - open AS cb, volume - pv AS st FROM b),
    x AS (SELECT *, -0.35 * {_z('open')} + 0.25 * {_z('st')} + 0.25 * {_z('ef')} + 0.15 * {_z('cb')} AS target_fundflow_strength FROM q)""",
    ["target_fundflow_strength"],
    "x",
)
