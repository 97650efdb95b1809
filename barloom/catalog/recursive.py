"""Recursive indicators, regime flags and squeeze; the SQL side is a recursive CTE over bar numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.indicators import ALL, ATR, BOLL, DAILY, KEY, W, families, full, over, sql
from barloom.catalog.tables import bars, bars_sql, settle_sql, settled
from barloom.operators import indicators as ind, kernels

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, wanted, cols, ctes, src, periods=DAILY, ints=(), by_period=False):
    QUERIES[name] = families(wanted, cols, periods, by_period)
    ORACLE[name] = sql(periods, ctes, cols, src, ints)


def recursion(name: str, source: str, state: dict[str, tuple[str, str]], carry: str = "") -> str:
    """state: column -> (first value, next value); `p.` is the previous state, `n.` the new row."""
    first = ", ".join(f"CAST({a} AS DOUBLE) AS {c}" for c, (a, _) in state.items())
    after = ", ".join(f"CAST({b} AS DOUBLE)" for _, b in state.values())
    return f"""{name} AS (
    SELECT n.symbol, n.period, n.timestamp, n.pos, {first} FROM {source} n WHERE n.pos = 1
    UNION ALL
    SELECT n.symbol, n.period, n.timestamp, n.pos, {after} FROM {name} p
    JOIN {source} n ON n.symbol = p.symbol AND n.period = p.period AND n.pos = p.pos + 1)"""


def ema(col: str, x: str, alpha: str) -> str:
    return f"{alpha} * {x} + (1 - {alpha}) * p.{col}"


_E12, _E26 = ema("e12", "n.close", "(2.0/13)"), ema("e26", "n.close", "(2.0/27)")
MACD = recursion(
    "rec",
    "b",
    {
        "e12": ("n.close", _E12),
        "e26": ("n.close", _E26),
        "sig": ("0.0", ema("sig", f"(({_E12}) - ({_E26}))", "0.2")),
    },
)
register(
    "macd_ppo",
    ["macd_cross"],
    ["macd_line", "macd_signal", "macd_hist", "ppo", "macd_bullish_cross"],
    MACD
    + f""", m AS (SELECT *, e12 - e26 AS macd_line, sig AS macd_signal, e12 - e26 - sig AS macd_hist,
        (e12 - e26) / (e26 + 1e-10) AS ppo FROM rec),
    x AS (SELECT *, CAST(coalesce(macd_hist > 0 AND lag(macd_hist) OVER ({W}) <= 0, false) AS INT) AS macd_bullish_cross FROM m)""",
    "x",
    ints=("macd_bullish_cross",),
)
RSV = f"""kin AS MATERIALIZED (SELECT *, CASE WHEN max(high) {over(9)} > min(low) {over(9)}
    THEN (close - min(low) {over(9)}) / (max(high) {over(9)} - min(low) {over(9)}) * 100 END AS rsv FROM b)"""
_WK = "CASE WHEN p.k IS NULL THEN CASE WHEN n.rsv IS NOT NULL THEN 1.0 END ELSE p.wk * 2/3.0 + CASE WHEN n.rsv IS NULL THEN 0 ELSE 1 END END"
_K = "CASE WHEN p.k IS NULL THEN n.rsv WHEN n.rsv IS NULL THEN p.k ELSE (p.wk * 2/3.0 * p.k + n.rsv) / (p.wk * 2/3.0 + 1) END"
KDJ = RSV + ", " + recursion(
    "rec",
    "kin",
    {
        "k": ("n.rsv", _K),
        "wk": ("CASE WHEN n.rsv IS NOT NULL THEN 1.0 END", _WK),
        "dd": ("n.rsv", f"CASE WHEN p.dd IS NULL THEN {_K} ELSE (p.wd * 2/3.0 * p.dd + ({_K})) / (p.wd * 2/3.0 + 1) END"),
        "wd": (
            "CASE WHEN n.rsv IS NOT NULL THEN 1.0 END",
            f"CASE WHEN p.dd IS NULL THEN CASE WHEN ({_K}) IS NOT NULL THEN 1.0 END ELSE p.wd * 2/3.0 + 1 END",
        ),
    },
)
register(
    "kdj",
    ["kdj"],
    ["kdj_k", "kdj_d", "kdj_j"],
    KDJ + """, x AS (SELECT *, coalesce(k, 0) AS kdj_k, coalesce(dd, 0) AS kdj_d, coalesce(3 * k - 2 * dd, 0) AS kdj_j FROM rec)""",
    "x",
)
_FLAT, _GONE = (739_000_000_000, 852_000_000_000), (868_000_000_000, 884_000_000_000)  # epoch ms: 1993 to 1996, and half of 1997
_PRICES = ("open", "high", "low", "close")


def recursive_flat_stretch(spark, sf):
    """Averages of the close's place in its range, over bars that stand still and then are unknown for longer than any look-back."""
    df = bars(spark, sf, "1d")
    within = lambda span: F.col("timestamp").between(*span)
    df = df.withColumns({c: F.when(within(_GONE), None).when(within(_FLAT), 100.0).otherwise(F.col(c)) for c in _PRICES})
    return settled(ind.compute(df, ["kdj"]), KEY, ["kdj_k", "kdj_d", "kdj_j"])


QUERIES["recursive_flat_stretch"] = recursive_flat_stretch
_STILL = ", ".join(f"CASE WHEN timestamp BETWEEN {_GONE[0]} AND {_GONE[1]} THEN NULL WHEN timestamp BETWEEN {_FLAT[0]} AND {_FLAT[1]} THEN 100.0 ELSE {c} END AS {c}" for c in _PRICES)
ORACLE["recursive_flat_stretch"] = ORACLE["kdj"].replace("bars AS (", "given AS (", 1).replace("\nb0 AS (", f"\nbars AS (SELECT symbol, period, timestamp, {_STILL}, volume FROM given),\nb0 AS (", 1)
DM = """dm AS MATERIALIZED (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM b)"""
_A14 = "(1.0/14)"
_T, _P, _M = ema("t", "n.tr", _A14), ema("pp", "n.pdm", _A14), ema("mm", "n.mdm", _A14)


def _dx(t, p, m):
    pdi, mdi = f"(100.0 * ({p}) / (({t}) + 1e-10))", f"(100.0 * ({m}) / (({t}) + 1e-10))"
    return f"(100.0 * abs({pdi} - {mdi}) / ({pdi} + {mdi} + 1e-10))"


ADX = DM + ", " + recursion(
    "arec",
    "dm",
    {
        "t": ("n.tr", _T),
        "pp": ("n.pdm", _P),
        "mm": ("n.mdm", _M),
        "ax": (_dx("n.tr", "n.pdm", "n.mdm"), ema("ax", _dx(_T, _P, _M), _A14)),
    },
) + """, ad AS (SELECT *, least(greatest(ax, 0), 100) AS adx, least(greatest(100.0 * pp / (t + 1e-10), 0), 100) AS plus_di,
    least(greatest(100.0 * mm / (t + 1e-10), 0), 100) AS minus_di FROM arec)"""
register(
    "directional_movement",
    ["adx"],
    ["adx", "plus_di", "minus_di", "adx_scaled"],
    ADX + ", x AS (SELECT *, adx / 100.0 AS adx_scaled FROM ad)",
    "x",
)
_M1, _A1 = ema("m1", "n.d", "(2.0/26)"), ema("a1", "abs(n.d)", "(2.0/26)")


def _start(col, x, nxt):
    """An average whose input is unknown on the first bar."""
    return ("NULL", f"CASE WHEN p.{col} IS NULL THEN {x} ELSE {nxt} END")


def _val(col, x, nxt):
    return f"(CASE WHEN p.{col} IS NULL THEN {x} ELSE {nxt} END)"


register(
    "true_strength",
    ["tsi"],
    ["tsi"],
    recursion(
        "rec",
        "b",
        {
            "m1": _start("m1", "n.d", _M1),
            "a1": _start("a1", "abs(n.d)", _A1),
            "m2": _start("m2", "n.d", ema("m2", _val("m1", "n.d", _M1), "(2.0/14)")),
            "a2": _start("a2", "abs(n.d)", ema("a2", _val("a1", "abs(n.d)", _A1), "(2.0/14)")),
        },
    )
    + ", x AS (SELECT *, coalesce(m2 / (a2 + 1e-10), 0) AS tsi FROM rec)",
    "x",
)
KELT = recursion("krec", "b", {"e20": ("n.close", ema("e20", "n.close", "(2.0/21)"))}) + f""",
    atr20 AS (SELECT *, avg(tr) {over(20)} AS a20 FROM b),
    ke AS (SELECT atr20.*, e20 + 1.5 * a20 AS keltner_upper_20, e20 - 1.5 * a20 AS keltner_lower_20
        FROM atr20 JOIN krec USING (symbol, period, timestamp))"""
register("keltner", ["keltner"], ["keltner_upper_20", "keltner_lower_20"], KELT, "ke")
register(
    "squeeze",
    ["squeeze"],
    ["squeeze_on"],
    KELT
    + ", "
    + BOLL
    + f""", kw AS (SELECT ke.*, boll_bandwidth, (keltner_upper_20 - keltner_lower_20) / (abs(mid) + 1e-9) AS kcw
        FROM ke JOIN bo USING (symbol, period, timestamp)),
    ks AS (SELECT *, list(kcw) {over(500)} AS ws FROM kw),
    x AS (SELECT *, CAST(boll_bandwidth < kcw AND CASE WHEN len(ws) >= 100
        THEN len(list_filter(ws, lambda e: e < kcw)) / len(ws) < 0.3 ELSE false END AS INT) AS squeeze_on FROM ks)""",
    "x",
    ints=("squeeze_on",),
)


def _flags(period: str) -> str:
    day = {"1h": 24, "4h": 6, "1d": 1}[period]
    dev = full("stddev_samp(r)", "r", day, 2) if day > 1 else "NULL"
    return f"""{ADX}, {BOLL}, {ATR.replace('t0', 'tt0').replace('t AS', 'ta AS')},
    f0 AS (SELECT bo.*, adx, atr / (abs(bo.close) + 1e-9) AS atr_ratio FROM bo JOIN ad USING (symbol, period, timestamp)
        JOIN tt0 USING (symbol, period, timestamp)),
    f1 AS (SELECT *, {full('stddev_samp(r)', 'r', 20, 10)} AS s20, {full('sum(r)', 'r', 20, 10)} AS r20,
        CASE WHEN {dev} <> 0 THEN {dev} END AS sday, {full('quantile_cont(boll_bandwidth, 0.3)', 'boll_bandwidth', 500)} AS bw30 FROM f0),
    f2 AS (SELECT *, {full('quantile_cont(s20, 0.7)', 's20', 100)} AS s70 FROM f1),
    f3 AS (SELECT *, CAST(coalesce(adx > 25 AND abs(r20) > 2.0 * s20, false) AS INT) AS trend_flag,
        CAST(coalesce(atr_ratio < 0.008 AND adx < 15 AND boll_bandwidth < bw30, false) AS INT) AS range_flag,
        CAST(coalesce(s20 > s70 AND adx < 15, false) AS INT) AS high_vol_flag,
        CAST(coalesce(r < -4.0 * sday, false) AS INT) AS stress_flag FROM f2)"""


_FLAGS = ["trend_flag", "range_flag", "high_vol_flag", "stress_flag"]
QUERIES["regime_flags"] = families(["regime_flags"], _FLAGS, ALL, by_period=True)
ORACLE["regime_flags"] = " UNION ALL ".join(
    f"(SELECT * FROM ({sql((p,), _flags(p), _FLAGS, 'f3', tuple(_FLAGS))}))" for p in ALL
)


def _parabolic(spark, sf):
    return settled(kernels.parabolic_stop(bars(spark, sf, "1d")), KEY, ["psar", "psar_flip_flag"])


_UP_STOP = "least(p.stop + p.af * (p.top - p.stop), n.l1, n.l2)"
_DN_STOP = "greatest(p.stop + p.af * (p.bot - p.stop), n.h1, n.h2)"
_TOP, _BOT = "greatest(p.top, n.high)", "least(p.bot, n.low)"
QUERIES["parabolic_stop"] = _parabolic
ORACLE["parabolic_stop"] = f"""WITH RECURSIVE {bars_sql('1d')},
s0 AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS pos, lag(low) OVER ({W}) AS l1, lag(high) OVER ({W}) AS h1,
    coalesce(lag(low, 2) OVER ({W}), lag(low) OVER ({W})) AS l2, coalesce(lag(high, 2) OVER ({W}), lag(high) OVER ({W})) AS h2 FROM bars),
{recursion('rec', 's0', {
    "bull": ("1", f"CASE WHEN p.bull = 1 THEN CASE WHEN n.low < {_UP_STOP} THEN 0 ELSE 1 END ELSE CASE WHEN n.high > {_DN_STOP} THEN 1 ELSE 0 END END"),
    "af": ("0.02", f"CASE WHEN p.bull = 1 THEN CASE WHEN n.low < {_UP_STOP} THEN 0.02 WHEN n.high > p.top THEN least(0.2, p.af + 0.02) ELSE p.af END ELSE CASE WHEN n.high > {_DN_STOP} THEN 0.02 WHEN n.low < p.bot THEN least(0.2, p.af + 0.02) ELSE p.af END END"),
    "top": ("n.high", f"CASE WHEN p.bull = 1 THEN {_TOP} ELSE CASE WHEN n.high > {_DN_STOP} THEN n.high ELSE p.top END END"),
    "bot": ("n.low", f"CASE WHEN p.bull = 1 THEN CASE WHEN n.low < {_UP_STOP} THEN n.low ELSE p.bot END ELSE {_BOT} END"),
    "stop": ("0", f"CASE WHEN p.bull = 1 THEN CASE WHEN n.low < {_UP_STOP} THEN {_TOP} ELSE {_UP_STOP} END ELSE CASE WHEN n.high > {_DN_STOP} THEN {_BOT} ELSE {_DN_STOP} END END"),
})},
z AS (SELECT r.*, high, low, lag(stop) OVER (PARTITION BY r.symbol, r.period ORDER BY r.timestamp) AS ps FROM rec r JOIN s0 USING (symbol, period, timestamp)),
y AS (SELECT symbol, period, timestamp, stop AS psar,
    CAST(coalesce((ps > high AND stop <= low) OR (ps < low AND stop >= high), false) AS INT) AS psar_flip_flag FROM z)
SELECT symbol, period, timestamp, {settle_sql('psar')}, psar_flip_flag FROM y"""
