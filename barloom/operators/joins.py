"""Fusing slow series into bars, as-of joins, and column-set joins of datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barloom.columns import feature_candidates, is_target
from barloom.functions.nulls import clip, safe
from barloom.operators.chunks import halo_chunks, time_bucket
from barloom.operators.ranks import exact_quantiles, long_form
from barloom.operators.scan import bucketed_scan
from barloom.schema import KEYS, TIME

# The rich columns, their possible sources in order, and the ones that are winsorised.
RICH_COLUMNS = (
    "funding_rate", "oi_total", "taker_buy_sell_imbalance", "basis_z", "etf_flow", "etf_premium", "active_addresses",
    "new_addresses", "stablecoin_mcap", "exch_netflow", "cb_premium",
)
RICH_SOURCES = {
    "taker_buy_sell_imbalance": ("taker_imbalance_z", "taker_imbalance"),
    "basis_z": ("basis_raw", "close_basis_futures_basis"),
    "active_addresses": ("active_address_count_bitcoin_active_addresses",),
    "new_addresses": ("new_address_count_bitcoin_new_addresses",),
    "stablecoin_mcap": ("stablecoin_marketcap_total",),
}
WINSORISED_SOURCES = ("taker_imbalance", "basis_raw", "close_basis_futures_basis")
WINSORISED = ("funding_rate", "basis_z", "taker_buy_sell_imbalance", "etf_flow", "etf_premium", "exch_netflow", "cb_premium")


def assemble_series(series: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer merge of any number of series: a union and one aggregation instead of a join chain.

    Columns that two series share keep the first known value in the order given.
    """
    tagged = [s.withColumn("_at", F.lit(i)) for i, s in enumerate(series)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    values = [c for c in rows.columns if c not in keys and c != "_at"]
    pick = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    return rows.groupBy(*keys).agg(*[pick(c) for c in values])


def attach_series(bars: DataFrame, symbol_series: DataFrame | None, global_series: DataFrame | None) -> DataFrame:
    """Left joins on (timestamp, symbol) and on timestamp. No broadcast is forced: daily series are
    usually small enough for Spark to choose one, and long ones are shuffled."""
    out = bars
    if symbol_series is not None:
        out = out.join(symbol_series, [TIME, "symbol"], "left")
    if global_series is not None:
        out = out.join(global_series, [TIME], "left")
    return out


def hold_last(df: DataFrame, cols: Sequence[str], lag: int = 1, keys: Sequence[str] = KEYS, bucket: Column | None = None) -> DataFrame:
    """Last known value of slow columns, effective `lag` bars after it appears (0 or 1)."""
    if lag not in (0, 1):
        raise ValueError("lag is 0 or 1")
    work = df.withColumn("_bucket", time_bucket(df) if bucket is None else bucket)
    held = bucketed_scan(
        work, keys, [TIME], "_bucket", lasts={f"_held_{c}": F.col(c) for c in cols}, before=bool(lag)
    )
    rest = [c for c in df.columns if c not in cols]
    return held.select(*rest, *[F.col(f"_held_{c}").alias(c) for c in cols])


def fuse(bars: DataFrame, symbol_series: DataFrame | None, global_series: DataFrame | None, fundamentals_only: bool = False) -> DataFrame:
    """Bars with slow series that take effect from the bar after they are published."""
    joined = attach_series(bars, symbol_series, None if fundamentals_only else global_series)
    added = [c for c in joined.columns if c not in bars.columns]
    return hold_last(joined, added, lag=1) if added else joined


def broadcast_and_fill(slow: DataFrame, fast: DataFrame, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Pivot a long slow table (last value per timestamp), join it on time and carry it forward by symbol."""
    wide = slow.groupBy(TIME).agg(
        *[F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col("seq"))).alias(n) for n in names]
    )
    joined = fast.join(wide, [TIME], "left")
    return hold_last(joined, list(names), lag=0)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    time: str,
    take: Sequence[str],
    tolerance_ms: int | None = None,
    bucket_ms: int = 3_600_000,
    right_order: Sequence[str] = (),
) -> DataFrame:
    """Latest right row at or before each left row, per `by`; right rows count as earlier at equal times.

    Union, then a bucketed scan: each (key, time bucket) is one small task and a bucket's carry-in is
    the last right row of earlier buckets, so a hot key is spread over its buckets and no right row
    is copied. Unmatched left rows, those of an unknown key or time too, keep NULL; with a tolerance, so do matches that are too old.
    """
    picked = F.struct(F.col(time).alias("_t"), *[F.col(c) for c in take])
    extra = [c for c in left.columns if c not in by and c != time]
    l_rows = left.withColumns({"_side": F.lit(1), "_hit": F.lit(None)})
    r_rows = right.select(*by, time, F.lit(0).alias("_side"), picked.alias("_hit"), *[F.col(o).alias(f"_o_{o}") for o in right_order])
    rows = r_rows.unionByName(l_rows.drop("_hit"), allowMissingColumns=True)
    rows = rows.withColumn("_bucket", F.floor(F.col(time) / F.lit(bucket_ms)))
    order = [time, "_side", *[f"_o_{o}" for o in right_order]]
    hit = bucketed_scan(rows, by, order, "_bucket", lasts={"_match": F.col("_hit")}).filter(F.col("_side") == 1)
    match = F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, time]]), F.col("_match"))
    if tolerance_ms is not None:
        match = F.when(F.col(time) - F.col("_match._t") <= tolerance_ms, match)
    return hit.select(*by, time, *extra, *[match[c].alias(c) for c in take])


def next_close_asof(fast: DataFrame, slow: DataFrame, tolerance_ms: int = 14_400_000) -> DataFrame:
    """Fast bars with the slow period's next close as of each bar; unmatched bars are dropped."""
    ck = halo_chunks(slow, back=0, ahead=1)
    led = ck.owned(ck.df.withColumn("future_close_4h", F.lead("close").over(ck.w)))
    out = asof_join(fast, led, ["symbol"], TIME, ["future_close_4h"], tolerance_ms, bucket_ms=86_400_000)
    return out.filter(F.col("future_close_4h").isNotNull())


# --- rich columns -------------------------------------------------------------------------------


def winsorised_z(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), lower: float = 0.005, upper: float = 0.995, eps: float = 1e-6) -> DataFrame:
    """Clip at the quantiles, then (x - mean) / std with a floor; over the whole column or per key.

    The bounds are one row per key. Without keys they are read to the plan as constants, so nothing
    is joined; with keys they are joined on the key.
    """
    rows = long_form(df, list(keys), cols)
    bounds = exact_quantiles(rows, [*keys, "feature"], "value", [lower, upper])
    clipped = rows.join(bounds, [*keys, "feature"]).withColumn("_v", F.least(F.greatest("value", "q0"), F.col("q1")))
    clipped = clipped.withColumn("_v", F.when(F.col("value").isNotNull(), F.col("_v")))
    stats = clipped.groupBy(*keys, "feature").agg(
        F.first("q0").alias("lo"), F.first("q1").alias("hi"), F.avg("_v").alias("mu"), F.stddev_pop("_v").alias("sd")
    )
    fields = ("lo", "hi", "mu", "sd")
    wide = stats.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == c, F.struct(*fields))).alias(f"_s_{c}") for c in cols]
    )
    if keys:
        joined = df.join(wide, list(keys), "left")
        stat = lambda c, f: F.col(f"_s_{c}")[f]
    else:
        joined, one = df, wide.first()
        stat = lambda c, f: F.lit(one[f"_s_{c}"][f] if one[f"_s_{c}"] else None).cast("double")
    out = {}
    for c in cols:
        x = F.least(F.greatest(F.col(c), stat(c, "lo")), stat(c, "hi"))
        sd = F.when(stat(c, "sd") > eps, stat(c, "sd")).otherwise(F.lit(eps))
        out[c] = F.when(F.col(c).isNotNull(), (x - stat(c, "mu")) / sd)
    return joined.withColumns(out).drop(*[f"_s_{c}" for c in cols if keys])


def with_rich_columns(df: DataFrame) -> DataFrame:
    """The rich columns: own values where any exist, else the first present source column."""
    missing = [c for c in RICH_COLUMNS if c not in df.columns]
    out = df.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else df
    known = out.agg(*[F.count(c).alias(c) for c in RICH_COLUMNS]).first()
    funding = [c for c in df.columns if c.startswith("funding_rate_")]
    sources = {**RICH_SOURCES, "funding_rate": tuple(funding)}
    renamed: dict[str, str] = {}
    for target, candidates in sources.items():
        source = next((c for c in candidates if c in df.columns), None)
        if source and not known[target]:
            renamed[target] = source
    out = out.withColumns({t: F.col(s).cast("double") for t, s in renamed.items()}) if renamed else out
    twice = [t for t, s in renamed.items() if s in WINSORISED_SOURCES]
    return winsorised_z(out, twice) if twice else out


def with_rich_flags(df: DataFrame) -> DataFrame:
    """rich_available: all rich columns known; rich_quality: share known."""
    known = sum((F.col(c).isNotNull().cast("int") for c in RICH_COLUMNS[1:]), F.col(RICH_COLUMNS[0]).isNotNull().cast("int"))
    n = len(RICH_COLUMNS)
    return df.withColumns({"rich_available": (known == n).cast("int"), "rich_quality": known / F.lit(float(n))})


def drop_sparse_rows(df: DataFrame, cols: Sequence[str], max_missing: float) -> DataFrame:
    """Columns missing more often than allowed become the focus; rows that miss any of them go."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    focus = [c for c in cols if shares[c] is not None and shares[c] > max_missing]
    return df.na.drop(subset=focus) if focus else df


def without_nulls(df: DataFrame, cols: Sequence[str], method: str = "drop") -> DataFrame:
    """Keep rows complete in the columns that are not empty altogether.

    `intersect` and `drop` coincide: rows between the first and the last complete one are filtered
    again. `longest_run` keeps each group's longest unbroken run of complete rows.
    """
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    used = [c for c in cols if counts[c]]
    if not used:
        return df
    if method in ("drop", "intersect"):
        return df.na.drop(subset=used)
    if method != "longest_run":
        raise ValueError(f"unknown method {method!r}")
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in used])
    work = df.withColumns({"_bucket": time_bucket(df), "_whole": whole})
    placed = bucketed_scan(
        work, KEYS, [TIME], "_bucket", sums={"_breaks": F.when(~F.col("_whole"), 1).otherwise(0).cast("long")}
    ).filter("_whole")
    runs = placed.groupBy(*KEYS, "_breaks").agg(F.count(F.lit(1)).alias("_len"), F.min(TIME).alias("_from"))
    best = runs.groupBy(*KEYS).agg(F.max_by("_breaks", F.struct("_len", -F.col("_from"))).alias("_breaks"))
    return placed.join(best, [*KEYS, "_breaks"], "left_semi").select(*df.columns)


def intersect_datasets(base: DataFrame, rich: DataFrame) -> DataFrame:
    """Rows whose key is in both, features in both; labels from the base, absent ones from the other."""
    key = [*KEYS, TIME]
    shared = [c for c in feature_candidates(base.columns) if c in set(rich.columns)]
    own = [c for c in base.columns if is_target(c)]
    extra = [c for c in rich.columns if is_target(c) and c not in own]
    rows = base.join(rich.select(*key).distinct(), key, "left_semi").select(*key, *shared, *own)
    if not extra:
        return rows
    return rows.join(rich.select(*key, *extra).dropDuplicates(key), key, "left")


def modality_views(df: DataFrame, rich: Sequence[str]) -> Mapping[str, DataFrame]:
    """Base columns, rows with complete rich columns, and the rich columns alone."""
    complete = df.na.drop(subset=list(rich))
    keys = [c for c in df.columns if c in (*KEYS, TIME, "datetime", "time_idx") or is_target(c)]
    return {
        "base": df.drop(*rich),
        "rich_complete": complete,
        "rich_only": complete.select(*keys, *rich),
    }


def pair_spread(bars: DataFrame, symbols: Sequence[tuple[str, str]]) -> DataFrame:
    """Log price spread of named symbol pairs at equal (period, time)."""
    price = bars.select("symbol", *["period", TIME], F.ln("close").alias("_lc"))
    parts = []
    for a, b in symbols:
        x = price.filter(F.col("symbol") == a).select("period", TIME, F.col("_lc").alias("_a"))
        y = price.filter(F.col("symbol") == b).select("period", TIME, F.col("_lc").alias("_b"))
        parts.append(
            x.join(y, ["period", TIME]).select(
                F.lit(f"{a}/{b}").alias("symbol"), "period", TIME, (F.col("_a") - F.col("_b")).alias("spread")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def implied_price(predictions: DataFrame, bars: DataFrame) -> DataFrame:
    """Predicted log return as a simple return and as a price."""
    joined = predictions.join(bars.select(*KEYS, TIME, "close"), [*KEYS, TIME])
    return joined.withColumns(
        {"simple_return": F.expm1("score"), "implied_price": F.col("close") * F.exp("score")}
    )


def calibrate_scores(predictions: DataFrame, params: DataFrame, classes: Sequence[str], lo: float = 0.1, hi: float = 10.0) -> DataFrame:
    """score * clipped scale + bias per symbol, then a sigmoid for class labels."""
    joined = predictions.join(params, ["symbol"], "left")
    raw = F.col("score") * F.coalesce(clip(F.col("scale"), lo, hi), F.lit(1.0)) + safe(F.col("bias"))
    return joined.withColumn(
        "calibrated", F.when(F.col("target").isin(*classes), 1 / (1 + F.exp(-raw))).otherwise(raw)
    ).drop("scale", "bias")
