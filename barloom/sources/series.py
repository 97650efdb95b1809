"""Declarative scans of slow series: what a file holds, how its columns are called, who switches it on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.nulls import nan_to_null
from barloom.sources.delimited import delimited_rows


@dataclass(frozen=True)
class Series:
    """One slow series: a CSV below the data root and the columns taken from it.

    `keep` maps source to output name; a column in `suffixed` is kept under its name plus `suffix`;
    with `every` all columns but time are kept under `prefix` + name + `suffix`. `positional` names
    the columns of files whose header lost its time column.
    """

    path: str
    keep: Mapping[str, str] = field(default_factory=dict)
    suffixed: Sequence[str] = ()
    suffix: str = ""
    prefix: str = ""
    every: bool = False
    positional: Sequence[str] = ()

    def columns(self, have: Sequence[str]) -> dict[str, str]:
        rest = [c for c in have if c not in ("timestamp", "time", "datetime", "symbol")]
        if self.every:
            return {c: f"{self.prefix}{c}{self.suffix}" for c in rest}
        wanted = {**self.keep, **{c: c + self.suffix for c in self.suffixed}}
        return {c: n for c, n in wanted.items() if c in rest}


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _btc(file: str, column: str, suffix: str | None = None, positional: Sequence[str] = ()) -> Series:
    return Series(f"index/bitcoin-{file}.csv", suffixed=(column,), suffix=suffix or f"_bitcoin_bitcoin_{file}", positional=positional)


def _ls(folder: str, stem: str, tail: str) -> Series:
    kinds = {"long_short_ratio": "long_short_ratio", "long_percent": "long_percent", "short_percent": "short_percent"}
    return Series(
        f"futures/long-short/{folder}/Binance_{{pair}}_1d.csv",
        keep={f"{stem}_{k}": f"{v}_ls_{tail}" for k, v in kinds.items()},
    )


# File layout and column names of the slow series.
SYMBOL_SERIES: dict[str, Series] = {
    "funding_oi": Series("futures/funding-rate/funding-rate-oi/Agg_{coin}_1d.csv", {"close": "funding_rate_oi_close"}),
    "funding_vol": Series("futures/funding-rate/funding-rate-volume/Agg_{coin}_1d.csv", {"close": "funding_rate_vol_close"}),
    "oi": Series("futures/open-interest/{symbol}_1d.csv", _same("oi_mean_oc", "oi_vol", "oi_mean_oc_z")),
    "ls_global": _ls("global-long-short-account-ratio", "global_account", "acc_global"),
    "ls_top_acc": _ls("top-long-short-account-ratio", "top_account", "acc_top"),
    "ls_top_pos": _ls("top-long-short-position-ratio", "top_position", "pos_top"),
    "basis": Series(
        "futures/futures-basis-Binance-{pair}-1d.csv",
        suffixed=("open_basis", "close_basis", "open_change", "close_change"),
        suffix="_futures_basis",
    ),
    "whale": Series("futures/whale-index-Binance-{pair}-1d.csv", suffixed=("whale_index_value",), suffix="_whale_index"),
    "taker": Series(
        "spot/taker-buy-sell-volume/{pair}_1d.csv",
        _same(
            "taker_buy_volume_usd", "taker_sell_volume_usd", "taker_imbalance",
            "taker_buy_volume_usd_z", "taker_sell_volume_usd_z", "taker_imbalance_z",
        ),
    ),
    "funding_rate": Series(""),  # a switch without a file: the rich column is derived after fusing
    "oi_total": Series("futures/open-interest/{symbol}_1d.csv", {c: "oi_total" for c in ("oi_total", "total_oi", "open_interest")}),
    "taker_buy_sell_imbalance": Series("spot/taker-buy-sell-volume/{pair}_1d.csv", {"taker_imbalance": "taker_buy_sell_imbalance"}),
    "basis_z": Series("futures/futures-basis-Binance-{pair}-1d.csv", {"close_basis": "basis_raw"}),
    "cgdi": Series("futures/futures-cgdi-Binance-{pair}-1d.csv", suffixed=("cgdi_index_value",), suffix="_futures_cgdi"),
    "cdri": Series("futures/futures-cdri-Binance-{pair}-1d.csv", suffixed=("cdri_index_value",), suffix="_futures_cdri"),
    "borrow_interest": Series(
        "index/borrow_interest_rate-Binance-{coin}-1d.csv", {"interest_rate": "interest_rate_borrow_interest_rate_binance"}
    ),
}

_ETF_BTC = "futures/futures-etf-btc.csv"
GLOBAL_SERIES: dict[str, Series] = {
    "premium": Series("index/premium-index.csv", suffixed=("premium", "premium_rate"), suffix="_premium_index"),
    "altcoin": Series("index/altcoin-season.csv", suffixed=("altcoin_index", "altcoin_marketcap"), suffix="_index"),
    "reserve": Series(
        "index/bitcoin-reserve_risk.csv",
        suffixed=("reserve_risk_index", "movcd", "hodl_bank", "vocd"),
        suffix="_bitcoin_bitcoin_reserve_risk",
    ),
    "ahr999": Series("index/ahr999.csv", suffixed=("average_price", "ahr999_value", "current_value"), suffix="_ahr999"),
    "active_addresses": _btc("active_addresses", "active_address_count", "_bitcoin_active_addresses"),
    "new_addresses": _btc("new_addresses", "new_address_count", "_bitcoin_new_addresses"),
    "nupl": _btc("net_unrealized_profit_loss", "net_unpnl"),
    "sth_sopr": _btc("sth_sopr", "sth_sopr", "_bitcoin_sth_sopr"),
    "lth_sopr": _btc("lth_sopr", "lth_sopr", "_bitcoin_lth_sopr"),
    "sth_realized_price": _btc("sth_realized_price", "sth_realized_price", "_bitcoin_sth_realized_price"),
    "lth_realized_price": _btc("lth_realized_price", "lth_realized_price", "_bitcoin_lth_realized_price"),
    "lth_supply": _btc("long_term_holder_supply", "long_term_holder_supply", positional=("long_term_holder_supply", "timestamp")),
    "sth_supply": _btc("short_term_holder_supply", "short_term_holder_supply", positional=("short_term_holder_supply", "timestamp")),
    "macro_oscillator": _btc("macro_oscillator", "bmo_value", positional=("bmo_value", "timestamp")),
    "rhodl": _btc("rhodl_ratio", "rhodl_ratio", positional=("rhodl_ratio", "timestamp")),
    "dominance": Series(
        "index/bitcoin-dominance.csv", suffixed=("market_cap", "bitcoin_dominance"), suffix="_bitcoin_bitcoin_dominance"
    ),
    "m2_global": Series(
        "index/bitcoin-vs-global-m2-growth.csv",
        suffixed=("global_m2_yoy_growth", "global_m2_supply"),
        suffix="_bitcoin_bitcoin_vs_global_m2_growth",
    ),
    "m2_us": Series(
        "index/bitcoin-vs-us-m2-growth.csv",
        suffixed=("us_m2_yoy_growth", "us_m2_supply"),
        suffix="_bitcoin_bitcoin_vs_us_m2_growth",
    ),
    "stablecoin_mcap": Series("index/stableCoin-marketCap-history.csv", {"total": "stablecoin_marketcap_total"}),
    "bubble_index": Series(
        "index/bitcoin/bubble_index.csv",
        suffixed=("bubble_index", "google_trend_percent", "mining_difficulty", "transaction_count", "address_send_count", "tweet_count"),
        suffix="_bitcoin_bubble_index",
    ),
    "rainbow_chart": Series("index/bitcoin/rainbow_chart.csv", every=True, suffix="_bitcoin_rainbow_chart"),
    "pi_cycle": Series("index/pi_cycle_indicator.csv", suffixed=("ma_110", "ma_350_mu_2"), suffix="_pi_cycle_indicator"),
    "puell_multiple": Series(
        "index/puell_multiple.csv", {"puell_multiple": "puell_multiple_puell_multiple"}, positional=("timestamp", "puell_multiple")
    ),
    "stock_flow": Series("index/stock_flow.csv", {"next_halving": "next_halving_stock_flow"}),
    "correlation": Series("index/bitcoin-correlation.csv", every=True, prefix="correlation_"),
    "etf_btc": Series(_ETF_BTC, suffixed=("net_assets_usd", "change_usd", "price_usd"), prefix="etf_btc_"),
    "etf_eth": Series("futures/futures-etf-eth.csv", suffixed=("net_assets_usd", "change_usd"), prefix="etf_eth_"),
    "exch_netflow": Series("index/bitcoin-exchange_netflow.csv", every=True),
    "cb_premium": Series("index/premium-index.csv", {"premium": "cb_premium"}),
    "etf_flow": Series(_ETF_BTC, {"change_usd": "etf_flow"}),
    "etf_premium": Series(_ETF_BTC, {"price_usd": "etf_premium"}),
}


def switched_on(registry: Mapping[str, Series], include: Mapping[str, bool] | None, missing_is_on: bool) -> list[str]:
    """Series to read. Without a map all are on; with one, unnamed symbol series stay on and unnamed
    global series go off."""
    if include is None:
        return list(registry)
    return [k for k in registry if include.get(k, missing_is_on)]


def _named(key: str, spec: Series, header: Sequence[str]) -> tuple[int | None, dict[int, str]]:
    """Of one header: the place of the time column, and the places of the columns taken and their output names."""
    names = list(spec.positional) if not {"timestamp", "time"} & set(header) and len(spec.positional) == len(header) else list(header)
    time = next((names.index(t) for t in ("timestamp", "time") if t in names), None)
    taken = spec.columns(names)
    if key == "exch_netflow":
        taken = {c: "exch_netflow" for c in list(taken)[:1]}
    if spec.prefix and not spec.every:
        taken = {c: f"{spec.prefix}{c}" for c in taken}
    if key == "oi_total":
        taken = dict(list(taken.items())[:1])
    return time, {names.index(c): n for c, n in taken.items()}


def _read(spark: SparkSession, root: str, registry: Mapping[str, Series], chosen: Sequence[str], paths: Sequence[tuple[str, str, str | None]], keys: Sequence[str]) -> DataFrame | None:
    """Series (key, path, symbol) below the root as one table on `keys`, from one scan; None if no file gives a column.

    The scan's distinct headers, a few for each series, tell the columns; files that are not there are left out.
    """
    paths = [(k, p, s, chosen.index(k)) for k, p, s in paths if p]
    if not paths:
        return None
    places = spark.createDataFrame(paths, "key string, file string, symbol string, _at int")
    rows = delimited_rows(spark, root, F.col("file").isin(*sorted({p for _, p, _, _ in paths}))).join(places, "file")
    known = sorted((chosen.index(r.key), tuple(r.header)) for r in rows.select("key", "header").distinct().collect())
    values: dict[str, list] = {}
    time = F.lit(None).cast("string")
    for at, header in known:
        when, taken = _named(chosen[at], registry[chosen[at]], header)
        if when is None:
            continue
        here = (F.col("_at") == at) & (F.col("header") == F.array(*[F.lit(h) for h in header]))
        time = F.when(here, F.get("fields", F.lit(when))).otherwise(time)
        for place, name in taken.items():
            values.setdefault(name, []).append(F.when(here, F.get("fields", F.lit(place)).try_cast("double")))
    if not values:
        return None
    wide = rows.select("file", "symbol", "_at", time.try_cast("double").try_cast("long").alias("timestamp"), *[F.coalesce(*v).alias(n) for n, v in values.items()])
    short = F.length(F.abs("timestamp").cast("string")) <= 10  # a file whose middle time is that short holds seconds
    units = wide.groupBy("file").agg((F.count_if(short) * 2 > F.count("timestamp")).alias("seconds"))
    stamp = F.when(F.col("seconds"), F.col("timestamp") * 1000).otherwise(F.col("timestamp"))
    wide = nan_to_null(wide.join(units, "file").withColumn("timestamp", stamp))
    pick = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("_at", c))).alias(c)
    return wide.groupBy(*keys).agg(*[pick(n) for n in values])


def read_global_series(spark: SparkSession, root: str, include: Mapping[str, bool] | None = None) -> DataFrame | None:
    chosen = switched_on(GLOBAL_SERIES, include, False)
    return _read(spark, root, GLOBAL_SERIES, chosen, [(k, GLOBAL_SERIES[k].path, None) for k in chosen], ["timestamp"])


def read_symbol_series(spark: SparkSession, root: str, symbols: Sequence[str], include: Mapping[str, bool] | None = None) -> DataFrame | None:
    """All symbols' series on (timestamp, symbol)."""
    chosen, paths = switched_on(SYMBOL_SERIES, include, True), []
    for symbol in symbols:
        base, quote = symbol.split("_", 1)
        paths += [(k, SYMBOL_SERIES[k].path.format(coin=base, pair=base + quote, symbol=symbol), symbol) for k in chosen]
    return _read(spark, root, SYMBOL_SERIES, chosen, paths, ["timestamp", "symbol"])
