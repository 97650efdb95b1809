"""Scalar functions, payload shaping, incremental loads and row pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fusing import ATTACHED_SQL, SLOW, attached, settle_all
from barloom.catalog.indicators import KEY, W
from barloom.catalog.tables import bars, bars_sql, settle_sql, settled, table
from barloom.functions import nulls, symbols, times
from barloom.operators import labels, rows, splits
from barloom.plans.experts import BASE_FEATURES, SYNONYMS
from barloom.sources import bars as bar_source, files, payloads, staging

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


DAILY = f"WITH {bars_sql('1d')} "


@query
def epoch_units_by_row(spark, sf):
    """Event times, every second one in seconds, back to ms."""
    ev = table(spark, sf, "events")
    s = F.unix_seconds("ts")
    mixed = F.when(F.col("event_id") % 2 == 0, s).otherwise(s * 1000)
    return ev.select("event_id", times.epoch_ms(mixed).alias("ms"))


ORACLE["epoch_units_by_row"] = "SELECT event_id, (epoch_us(ts) // 1000000) * 1000 AS ms FROM events"


@query
def epoch_units_by_column(spark, sf):
    """A whole column of seconds is recognised by its median digit count."""
    ev = table(spark, sf, "events").select("event_id", F.unix_seconds("ts").alias("ms"))
    return times.with_epoch_ms(ev, "ms")


ORACLE["epoch_units_by_column"] = ORACLE["epoch_units_by_row"]


@query
def time_literals(spark, sf):
    """Order dates spelled in six ways, and one way that is no time at all."""
    od = table(spark, sf, "orders")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = (
        F.when(k == 0, F.unix_millis(d).cast("string"))
        .when(k == 1, F.unix_seconds(d).cast("string"))
        .when(k == 2, F.date_format(d, "yyyyMMdd"))
        .when(k == 3, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 4, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(k == 5, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("soon"))
    )
    out = od.select("o_orderkey", text.alias("text"))
    return out.select(
        "o_orderkey",
        times.time_literal_ms(F.col("text")).alias("ms"),
        F.unix_millis(times.robust_timestamp(F.when(k != 2, F.col("text")))).alias("robust_ms"),
    )


# 10-digit epochs before 2001-09-09 have nine digits and are no time literal; the robust parser takes them
ORACLE["time_literals"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL
WHEN o_orderkey % 7 = 0 AND epoch_ms(o_orderdate) < 1000000000000 THEN NULL
WHEN o_orderkey % 7 = 1 AND epoch_ms(o_orderdate) < 1000000000000 THEN NULL ELSE epoch_ms(o_orderdate) END AS ms,
CASE WHEN o_orderkey % 7 IN (2, 6) THEN NULL ELSE epoch_ms(o_orderdate) END AS robust_ms FROM orders"""


@query
def floored_steps(spark, sf):
    ev = table(spark, sf, "events")
    ms = F.unix_millis("ts")
    steps = {f"floor_{p}": times.floor_step(ms, s).alias(f"floor_{p}") for p, s in (("1h", 3_600_000), ("4h", 14_400_000), ("1d", 86_400_000))}
    return ev.select("event_id", *steps.values())


ORACLE["floored_steps"] = "SELECT event_id, " + ", ".join(
    f"(epoch_us(ts) // {s}000) * {s} AS floor_{p}" for p, s in (("1h", 3_600_000), ("4h", 14_400_000), ("1d", 86_400_000))
) + " FROM events"


@query
def period_lengths(spark, sf):
    p = table(spark, sf, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("ms", "s", "m", "h", "d", "w")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    text = F.when(F.col("p_size") == 1, "60min").when(F.col("p_size") == 2, " Day ").otherwise(F.concat(F.col("p_size").cast("string"), unit))
    return p.select("p_partkey", times.period_ms(text).alias("ms"))


ORACLE["period_lengths"] = """SELECT p_partkey, CASE WHEN p_size = 1 THEN 3600000 WHEN p_size = 2 THEN 86400000
ELSE CAST(p_size AS BIGINT) * CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 WHEN 3 THEN 3600000 WHEN 4 THEN 86400000 END END AS ms FROM part"""


@query
def canonical_symbols(spark, sf):
    """Part types in the spellings of a pair, all becoming NAME_USDT."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    t = F.col("p_type")
    raw = (
        F.when(k == 0, F.concat(F.lower(t), F.lit("usdt")))
        .when(k == 1, F.concat(t, F.lit("/USDT:USDT")))
        .when(k == 2, F.concat(F.lit(" "), t, F.lit("-usdt ")))
        .otherwise(F.concat(t, F.lit("_USDT")))
    )
    out = p.select("p_partkey", raw.alias("raw"))
    return out.select(
        "p_partkey",
        symbols.canonical_symbol(F.col("raw")).alias("symbol"),
        symbols.coin(F.col("raw")).alias("coin"),
        symbols.pair(F.col("raw")).alias("pair"),
    )


ORACLE["canonical_symbols"] = "SELECT p_partkey, upper(p_type) || '_USDT' AS symbol, upper(p_type) AS coin, upper(p_type) || 'USDT' AS pair FROM part"


@query
def null_guards(spark, sf):
    """Unreadable, infinite and NaN text to NULL or zero; clipping leaves unknown alone."""
    od = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.lit("n/a")).when(k == 1, F.lit("NaN")).when(k == 2, F.lit("Infinity")).otherwise(F.col("o_totalprice").cast("string"))
    )
    n = nulls.to_number(F.col("text"))
    out = od.select("o_orderkey", text.alias("text")).select(
        "o_orderkey", n.alias("number"), nulls.safe(n).alias("filled"), nulls.clip(n, 1000.0, 200000.0).alias("clipped")
    )
    return settled(out, ["o_orderkey"])


ORACLE["null_guards"] = f"""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 2 THEN o_totalprice END AS number FROM orders),
b AS (SELECT *, coalesce(number, 0) AS filled, CASE WHEN number IS NOT NULL THEN least(greatest(number, 1000), 200000) END AS clipped FROM a)
SELECT o_orderkey, {settle_all('number', 'filled', 'clipped')} FROM b"""


@query
def margin_payloads(spark, sf):
    """Per order a payload of two rate lists, as JSON, flattened to rows."""
    li = table(spark, sf, "lineitem")
    rec = F.struct(F.concat(F.lit("ex"), F.col("l_suppkey")).alias("exchange"), F.col("l_discount").cast("string").alias("funding_rate"))
    returned = F.col("l_returnflag") == "R"
    payload = li.groupBy(F.col("l_orderkey").cast("string").alias("symbol")).agg(
        F.collect_list(F.when(returned, rec)).alias("stablecoin_margin_list"),
        F.collect_list(F.when(~returned, rec)).alias("token_margin_list"),
    )
    return payloads.flatten_margins(payload.select(F.to_json(F.struct("*")).alias("json")), "json")


ORACLE["margin_payloads"] = """SELECT CAST(l_orderkey AS VARCHAR) AS symbol, 'ex' || l_suppkey AS exchange,
CASE WHEN l_returnflag = 'R' THEN 'stablecoin' ELSE 'token' END AS margin_type, l_discount AS funding_rate_accum FROM lineitem"""


@query
def parallel_array_payloads(spark, sf):
    """Per order parallel arrays of times, prices (one short) and two-entry maps."""
    li = table(spark, sf, "lineitem")
    entry = F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.unix_seconds("l_shipdate").alias("t"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("x"))
    lists = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    payload = lists.select(
        "l_orderkey",
        F.to_json(
            F.struct(
                F.transform("e", lambda r: r.t).alias("time_list"),
                F.slice(F.transform("e", lambda r: r.p), F.lit(1), F.size("e") - 1).alias("price_list"),
                F.transform("e", lambda r: F.create_map(F.lit("a"), r.q, F.lit("b"), r.x)).alias("data_list"),
            )
        ).alias("json"),
    )
    out = payloads.zip_parallel(payload, "json", ["l_orderkey"], unit_ms=1000)
    return settled(out, ["l_orderkey", "timestamp"])


ORACLE["parallel_array_payloads"] = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn,
count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
a AS (SELECT l_orderkey, epoch_ms(l_shipdate) AS timestamp, CASE WHEN rn < n THEN l_extendedprice END AS price, l_quantity + l_tax AS total FROM r)
SELECT l_orderkey, timestamp, {settle_all('price', 'total')} FROM a"""


@query
def positional_bands(spark, sf):
    """Array positions 1 to 10 as named bands, position 11 as the time."""
    em = table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.slice("embedding", 1, 11).cast("array<double>"), F.array(F.col("vec_id").cast("double"))).alias("values")
    )
    return settled(payloads.name_bands(em, "values", ["vec_id"]), ["vec_id", "timestamp"])


ORACLE["positional_bands"] = "WITH e AS (SELECT vec_id, vec_id AS timestamp, " + ", ".join(
    f"CAST(embedding[{i + 2}] AS DOUBLE) AS {b}" for i, b in enumerate(payloads.BANDS)
) + f" FROM embeddings) SELECT vec_id, timestamp, {settle_all(*payloads.BANDS)} FROM e"


@query
def daily_last_by_date_text(spark, sf):
    od = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("date_string"), "o_orderkey", "o_totalprice"
    )
    out = payloads.daily_last(od, "date_string", ["o_orderkey"])
    return settled(out.select("timestamp", "o_orderkey", "o_totalprice"), ["timestamp", "o_orderkey"])


ORACLE["daily_last_by_date_text"] = f"""WITH d AS (SELECT epoch_ms(o_orderdate) AS timestamp, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey DESC) = 1) SELECT timestamp, o_orderkey, {settle_sql('o_totalprice')} FROM d"""


@query
def normalised_payload(spark, sf):
    """Event properties as a payload: mapped name, ms to s, stamped keys, one row per second."""
    ev = table(spark, sf, "events").select(
        F.unix_millis("ts").alias("time"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("value").alias("v")
    )
    out = payloads.normalise_payload(ev, {"k": "intensity", "v": "value"}, F.lit("ALL_USDT"), "1s")
    return settled(out, KEY)


ORACLE["normalised_payload"] = f"""WITH e AS (SELECT epoch_us(ts) // 1000000 AS timestamp, 'ALL_USDT' AS symbol, '1s' AS period,
CAST(props->>'$.k' AS DOUBLE) AS intensity, value FROM events QUALIFY row_number() OVER (PARTITION BY epoch_us(ts) // 1000000
ORDER BY CAST(props->>'$.k' AS DOUBLE), value) = 1) SELECT symbol, period, timestamp, {settle_all('intensity', 'value')} FROM e"""


@query
def resumed_bars(spark, sf):
    """Arriving bars, each twice, against a stored table that ends mid-2000: only later ones, once."""
    b = bars(spark, sf, "1d")
    stored = b.filter(F.col("timestamp") < 962_409_600_000)
    return settled(files.new_bars(b.unionByName(b), stored), KEY, ["close"])


ORACLE["resumed_bars"] = DAILY + f"SELECT symbol, period, timestamp, {settle_sql('close')} FROM bars WHERE timestamp >= 962409600000"


@query
def period_partition_roundtrip(spark, sf):
    """The long table written to the shared folder by period, scanned again and restricted to one period."""
    path = staging.staging_path(spark, "long-table")
    files.write_long_table(bars(spark, sf), path, narrow=False)
    return settled(bar_source.restrict(bar_source.read_bars(spark, path), ["4h"]), KEY, ["open", "close", "volume"])


ORACLE["period_partition_roundtrip"] = f"WITH {bars_sql('4h')} SELECT symbol, period, timestamp, {settle_all('open', 'close', 'volume')} FROM bars"


@query
def complete_feature_rows(spark, sf):
    """Daily bars with series, without the rows that miss a feature; a label may be missing."""
    rows = attached(spark, sf).drop("datetime").withColumn("target_x", F.lit(None).cast("double"))
    return settled(labels.drop_incomplete_features(rows), KEY, ["order_value", "avg_price"])


ORACLE["complete_feature_rows"] = f"""WITH {ATTACHED_SQL} SELECT symbol, period, timestamp, {settle_all('order_value', 'avg_price')} FROM att
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL
AND order_value IS NOT NULL AND order_count IS NOT NULL AND avg_price IS NOT NULL"""


@query
def restricted_symbols(spark, sf):
    """Bars of two symbols after discovery, the last two by name."""
    b = bars(spark, sf)
    chosen = [r["symbol"] for r in bar_source.symbols_in(b).orderBy(F.desc("symbol")).limit(2).collect()]
    return bar_source.restrict(b, symbols=chosen).groupBy("symbol", "period").agg(F.count("*").alias("n"))


ORACLE["restricted_symbols"] = f"""WITH {bars_sql()} SELECT symbol, period, count(*) AS n FROM bars
WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol ORDER BY symbol DESC LIMIT 2) GROUP BY symbol, period"""


@query
def name_list_roundtrip(spark, sf):
    """The column names of the slim table, written as a list and read again."""
    wide = bars(spark, sf, "1d").withColumns({"target_up": F.lit(1), "rsi": F.lit(1.0), "helper": F.lit(0)})
    path = staging.staging_path(spark, "names")
    files.write_names(spark, files.slim(wide, ["rsi"]).columns, path)
    return spark.createDataFrame(list(enumerate(files.read_names(spark, path))), "place int, name string")


ORACLE["name_list_roundtrip"] = """SELECT CAST(place AS INTEGER) AS place, name FROM (VALUES (0, 'timestamp'), (1, 'datetime'), (2, 'symbol'), (3, 'period'),
(4, 'open'), (5, 'high'), (6, 'low'), (7, 'close'), (8, 'volume'), (9, 'rsi'), (10, 'target_up')) AS t(place, name)"""


@query
def sample_cap(spark, sf):
    """A capped sample has the cap's size, no row twice and none that the bars lack."""
    b = bars(spark, sf)
    sample = splits.sample_cap(b, 500, KEY).select(*KEY).groupBy(*KEY).count()
    known = sample.join(b.select(*KEY), KEY, "left_semi")
    return known.agg(F.sum("count").alias("n"), F.max("count").alias("most"))


ORACLE["sample_cap"] = f"WITH {bars_sql()} SELECT least(500, count(*)) AS n, CAST(1 AS BIGINT) AS most FROM bars"


@query
def file_report(spark, sf):
    b = bars(spark, sf).withColumn("target_up", F.when(F.col("volume") > 3, (F.col("close") > F.col("open")).cast("int")))
    return settled(files.file_report(b, ["target_up"]), ["symbol", "period", "rows", "columns", "duplicate_ts", "trainable"])


ORACLE["file_report"] = f"""WITH {bars_sql()}, p AS (SELECT *, lag(timestamp) OVER ({W}) AS pt,
CASE period WHEN '1h' THEN 3600000 WHEN '4h' THEN 14400000 ELSE 86400000 END AS st FROM bars),
g AS (SELECT symbol, period, count(*) AS rows, 10 AS columns, 0 AS duplicate_ts, coalesce(avg((timestamp - pt <> st)::INT), 0) AS step_mismatch,
avg((volume <= 3)::INT) AS max_target_null FROM p GROUP BY 1, 2)
SELECT symbol, period, rows, columns, duplicate_ts, CAST(max_target_null < 0.5 AS INT) AS trainable, {settle_all('step_mismatch', 'max_target_null')} FROM g"""

for _how, _args, _cond in (
    ("any", {}, "k = 3"),
    ("all", {}, "k > 0"),
    ("thresh_k", {"min_k": 2}, "k >= 2"),
    ("thresh_ratio", {"min_ratio": 0.6}, "k / 3.0 >= 0.6"),
):

    def _prune(spark, sf, how=_how, args=_args):
        return settled(rows.prune_rows(attached(spark, sf), SLOW, how, periods=["1d"], drop=["datetime"], **args), KEY, ["close"])

    QUERIES[f"prune_rows_{_how}"] = _prune
    ORACLE[f"prune_rows_{_how}"] = f"""WITH {ATTACHED_SQL}, n AS (SELECT *, (order_value IS NOT NULL)::INT + (order_count IS NOT NULL)::INT + (avg_price IS NOT NULL)::INT AS k FROM att)
SELECT symbol, period, timestamp, {settle_sql('close')} FROM n WHERE {_cond}"""


@query
def feature_projection(spark, sf):
    """Candidate features of a table that also holds labels, a future column and an empty one."""
    df = attached(spark, sf).withColumns(
        {"target_x": F.lit(1), "future_close": F.col("close"), "empty": F.lit(None).cast("double")}
    )
    return settled(rows.feature_projection(df), KEY)


ORACLE["feature_projection"] = f"WITH {ATTACHED_SQL} SELECT symbol, period, timestamp, {settle_all('open', 'high', 'low', 'close', 'volume', 'order_value', 'avg_price')}, order_count FROM att"


@query
def feature_resolution(spark, sf):
    """Which expert features the fused table has, under which name, and how much of each is known."""
    df = attached(spark, sf).withColumnsRenamed({"order_value": "funding_rate_z", "avg_price": "basis"})
    experts = {e: {"base": BASE_FEATURES[e]} for e in ("Z-Combiner", "OnChain-ETF-TFT")}
    return rows.resolution_report(df, experts, SYNONYMS)


ORACLE["feature_resolution"] = f"""WITH {ATTACHED_SQL}, w(expert, channel, source, resolved) AS (VALUES
{", ".join(f"('Z-Combiner', 'base', '{n}', {('NULL' if n == 'vwap' else repr(n))})" for n in BASE_FEATURES['Z-Combiner'])},
{", ".join("('OnChain-ETF-TFT', 'base', '%s', %s)" % (n, {'funding_rate': "'funding_rate_z'", 'basis_z': "'basis'"}.get(n, 'NULL')) for n in BASE_FEATURES['OnChain-ETF-TFT'])}),
k AS (SELECT 'open' AS resolved, count(open) AS known FROM att UNION ALL SELECT 'high', count(high) FROM att UNION ALL SELECT 'low', count(low) FROM att
UNION ALL SELECT 'close', count(close) FROM att UNION ALL SELECT 'volume', count(volume) FROM att UNION ALL SELECT 'funding_rate_z', count(order_value) FROM att
UNION ALL SELECT 'basis', count(avg_price) FROM att)
SELECT w.*, known FROM w LEFT JOIN k USING (resolved)"""


@query
def gap_filling(spark, sf):
    """Forward, backward, then zero."""
    return settled(rows.fill_gaps(attached(spark, sf), ["order_value", "avg_price"], backward=True), KEY, ["order_value", "avg_price"])


def _ffbf(c):
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING),
first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"""


ORACLE["gap_filling"] = f"""WITH {ATTACHED_SQL}, f AS (SELECT symbol, period, timestamp, {_ffbf('order_value')}, {_ffbf('avg_price')} FROM att)
SELECT symbol, period, timestamp, {settle_all('order_value', 'avg_price')} FROM f"""


@query
def gap_filling_counts(spark, sf):
    df = attached(spark, sf)
    cols = ["order_value", "avg_price"]
    return rows.fill_counts(df, rows.fill_gaps(df, cols), cols)


ORACLE["gap_filling_counts"] = f"""WITH {ATTACHED_SQL} SELECT 'order_value' AS "column", count(*) - count(order_value) AS before, 0 AS after FROM att
UNION ALL SELECT 'avg_price', count(*) - count(avg_price), 0 FROM att"""
