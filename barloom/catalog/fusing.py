"""Series joins, as-of joins, rich columns, null policies and column-set joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.indicators import KEY, W
from barloom.catalog.tables import (
    SERIES_SQL, bars, bars_sql, global_series, settle_sql, settled, symbol_series, table,
)
from barloom.operators import joins

QUERIES: dict = {}
ORACLE: dict = {}
SLOW = ["order_value", "order_count", "avg_price"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def attached(spark, sf):
    """Daily bars with the series as published (unknown where a day has none)."""
    return joins.attach_series(bars(spark, sf, "1d"), symbol_series(spark, sf), global_series(spark, sf))


ATTACHED_SQL = f"""{bars_sql('1d')},{SERIES_SQL},
att AS (SELECT bars.*, sym.order_value, sym.order_count, mkt.avg_price FROM bars LEFT JOIN sym USING (timestamp, symbol)
    LEFT JOIN mkt USING (timestamp))"""


def settle_all(*cols):
    return ", ".join(settle_sql(c) for c in cols)


@query
def series_attach(spark, sf):
    return settled(attached(spark, sf), KEY, SLOW)


ORACLE["series_attach"] = f"WITH {ATTACHED_SQL} SELECT symbol, period, timestamp, {settle_all('order_value', 'avg_price')}, order_count FROM att"


@query
def series_assembly(spark, sf):
    """Full outer merge of three global series in one aggregation."""
    od = table(spark, sf, "orders").withColumn("timestamp", F.unix_millis("o_orderdate"))
    urgent = od.filter("o_orderpriority = '1-URGENT'").groupBy("timestamp").agg(F.sum("o_totalprice").alias("urgent_value"))
    done = od.filter("o_orderstatus = 'F'").groupBy("timestamp").agg(F.count(F.lit(1)).alias("finished"))
    return settled(joins.assemble_series([global_series(spark, sf), urgent, done], ["timestamp"]), ["timestamp"])


ORACLE["series_assembly"] = f"""WITH {SERIES_SQL},
u AS (SELECT epoch_ms(o_orderdate) AS timestamp, sum(o_totalprice) AS urgent_value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
d AS (SELECT epoch_ms(o_orderdate) AS timestamp, count(*) AS finished FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT timestamp, {settle_all('avg_price', 'urgent_value')}, finished FROM mkt FULL JOIN u USING (timestamp) FULL JOIN d USING (timestamp)"""


@query
def leak_safe_fuse(spark, sf):
    """Slow series effective from the next bar, carried forward."""
    return settled(joins.fuse(bars(spark, sf, "1d"), symbol_series(spark, sf), global_series(spark, sf)), KEY, SLOW)


def _held(c, lag=True):
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND " + ("1 PRECEDING" if lag else "CURRENT ROW")
    return f"last_value({c} IGNORE NULLS) OVER ({W} {frame}) AS {c}"


ORACLE["leak_safe_fuse"] = f"""WITH {ATTACHED_SQL}, h AS (SELECT symbol, period, timestamp, {', '.join(map(_held, SLOW))} FROM att)
SELECT symbol, period, timestamp, {settle_all('order_value', 'avg_price')}, order_count FROM h"""


@query
def fundamentals_only_fuse(spark, sf):
    out = joins.fuse(bars(spark, sf, "1d"), symbol_series(spark, sf), global_series(spark, sf), fundamentals_only=True)
    return settled(out, KEY, ["order_value", "order_count"])


ORACLE["fundamentals_only_fuse"] = f"""WITH {ATTACHED_SQL}, h AS (SELECT symbol, period, timestamp, {', '.join(map(_held, SLOW[:2]))} FROM att)
SELECT symbol, period, timestamp, {settle_sql('order_value')}, order_count FROM h"""


@query
def broadcast_and_fill(spark, sf):
    """Order value by priority, pivoted (last per day) and carried along the daily bars."""
    od = table(spark, sf, "orders")
    slow = od.select(
        F.unix_millis("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("seq"),
    )
    names = ["1-URGENT", "5-LOW"]
    out = joins.broadcast_and_fill(slow, bars(spark, sf, "1d"), "name", "value", names)
    return settled(out.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low_priority"}), KEY, ["urgent", "low_priority"])


ORACLE["broadcast_and_fill"] = f"""WITH {bars_sql('1d')},
p AS (SELECT epoch_ms(o_orderdate) AS timestamp, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
    arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW') AS low_priority FROM orders GROUP BY 1),
j AS (SELECT bars.*, urgent, low_priority FROM bars LEFT JOIN p USING (timestamp)),
h AS (SELECT symbol, period, timestamp, {_held('urgent', False)}, {_held('low_priority', False)} FROM j)
SELECT symbol, period, timestamp, {settle_all('urgent', 'low_priority')} FROM h"""


@query
def asof_purchase_view(spark, sf):
    """Each purchase with the user's latest view at most four hours earlier."""
    ev = table(spark, sf, "events").withColumn("ms", F.unix_millis("ts"))
    left = ev.filter("event_type = 'purchase'").select("user_id", "ms", F.col("event_id").alias("purchase_id"))
    right = ev.filter("event_type = 'view'").select("user_id", "ms", "event_id", F.col("value").alias("view_value"))
    out = joins.asof_join(left, right, ["user_id"], "ms", ["view_value"], 4 * 3_600_000, right_order=["event_id"])
    return out.select("user_id", "ms", "purchase_id", "view_value")


ORACLE["asof_purchase_view"] = """WITH l AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id AS purchase_id FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, arg_max(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT l.user_id, l.ms, purchase_id, CASE WHEN l.ms - r.ms <= 14400000 THEN view_value END AS view_value
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ms >= r.ms"""


@query
def next_close_asof(spark, sf):
    """Hourly bars with the next 4h close as of the latest 4h bar, four hours at most."""
    out = joins.next_close_asof(bars(spark, sf, "1h"), bars(spark, sf, "4h"))
    return settled(out, KEY, ["close", "future_close_4h"])


ORACLE["next_close_asof"] = f"""WITH {bars_sql('1h', '4h')},
f AS (SELECT symbol, timestamp, lead(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS future_close_4h FROM bars WHERE period = '4h'),
h AS (SELECT * FROM bars WHERE period = '1h'),
j AS (SELECT h.*, f.timestamp AS ft, future_close_4h FROM h ASOF JOIN f ON h.symbol = f.symbol AND h.timestamp >= f.timestamp)
SELECT symbol, period, timestamp, {settle_all('close', 'future_close_4h')} FROM j
WHERE timestamp - ft <= 14400000 AND future_close_4h IS NOT NULL"""


@query
def winsorised_z_global(spark, sf):
    return settled(joins.winsorised_z(attached(spark, sf), ["order_value", "avg_price"]), KEY, ["order_value", "avg_price"])


def _winsor_sql(part: str) -> str:
    over = f"OVER ({part})"
    q = lambda c: (
        f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, quantile_cont({c}, 0.005) {over}), quantile_cont({c}, 0.995) {over}) END AS w_{c}"
    )
    z = lambda c: f"(w_{c} - avg(w_{c}) {over}) / greatest(stddev_pop(w_{c}) {over}, 1e-6) AS z_{c}"
    return f"""WITH {ATTACHED_SQL}, c AS (SELECT *, {q('order_value')}, {q('avg_price')} FROM att),
z AS (SELECT *, {z('order_value')}, {z('avg_price')} FROM c)
SELECT symbol, period, timestamp, {settle_sql('z_order_value', 'order_value')}, {settle_sql('z_avg_price', 'avg_price')} FROM z"""


ORACLE["winsorised_z_global"] = _winsor_sql("")


@query
def winsorised_z_by_symbol(spark, sf):
    out = joins.winsorised_z(attached(spark, sf), ["order_value", "avg_price"], keys=["symbol"])
    return settled(out, KEY, ["order_value", "avg_price"])


ORACLE["winsorised_z_by_symbol"] = _winsor_sql("PARTITION BY symbol")

_RICH_MAP = {"order_value": "funding_rate_oi_close", "order_count": "taker_imbalance", "avg_price": "basis_raw"}


@query
def rich_columns_and_flags(spark, sf):
    """Rich columns derived from whatever series are present, and their availability flags."""
    df = attached(spark, sf).withColumnsRenamed(_RICH_MAP)
    df = df.withColumn("etf_flow", F.col("volume")).withColumn("stablecoin_marketcap_total", F.col("close"))
    out = joins.with_rich_flags(joins.with_rich_columns(df))
    cols = ["funding_rate", "taker_buy_sell_imbalance", "basis_z", "etf_flow", "stablecoin_mcap", "rich_available", "rich_quality"]
    return settled(out, KEY, cols)


def _wz(c):
    clipped = f"least(greatest({c}, quantile_cont({c}, 0.005) OVER ()), quantile_cont({c}, 0.995) OVER ())"
    return f"CASE WHEN {c} IS NOT NULL THEN {clipped} END"


ORACLE["rich_columns_and_flags"] = f"""WITH {ATTACHED_SQL}, d AS (SELECT *, CAST(order_count AS DOUBLE) AS oc FROM att),
c AS (SELECT *, {_wz('oc')} AS w1, {_wz('avg_price')} AS w2 FROM d),
z AS (SELECT *, order_value AS funding_rate, (w1 - avg(w1) OVER ()) / greatest(stddev_pop(w1) OVER (), 1e-6) AS taker_buy_sell_imbalance,
    (w2 - avg(w2) OVER ()) / greatest(stddev_pop(w2) OVER (), 1e-6) AS basis_z, volume AS etf_flow, close AS stablecoin_mcap, 0 AS rich_available,
    (CAST(order_value IS NOT NULL AS INT) + CAST(oc IS NOT NULL AS INT) + CAST(avg_price IS NOT NULL AS INT) + 2) / 11.0 AS rich_quality FROM c)
SELECT symbol, period, timestamp, {settle_all('funding_rate', 'taker_buy_sell_imbalance', 'basis_z', 'etf_flow', 'stablecoin_mcap', 'rich_quality')}, rich_available FROM z"""


@query
def sparse_row_drop(spark, sf):
    """Columns missing in more than a tenth of the rows become the focus."""
    return settled(joins.drop_sparse_rows(attached(spark, sf), SLOW, 0.1), KEY, SLOW)


ORACLE["sparse_row_drop"] = f"""WITH {ATTACHED_SQL},
s AS (SELECT count(order_value) / count(*) < 0.9 AS a, count(order_count) / count(*) < 0.9 AS b, count(avg_price) / count(*) < 0.9 AS c FROM att)
SELECT symbol, period, timestamp, {settle_all('order_value', 'avg_price')}, order_count FROM att, s
WHERE NOT (a AND order_value IS NULL) AND NOT (b AND order_count IS NULL) AND NOT (c AND avg_price IS NULL)"""


@query
def no_null_rows(spark, sf):
    return settled(joins.without_nulls(attached(spark, sf), SLOW, "intersect"), KEY, SLOW)


ORACLE["no_null_rows"] = f"""WITH {ATTACHED_SQL} SELECT symbol, period, timestamp, {settle_all('order_value', 'avg_price')}, order_count FROM att
WHERE order_value IS NOT NULL AND order_count IS NOT NULL AND avg_price IS NOT NULL"""


@query
def longest_complete_run(spark, sf):
    return settled(joins.without_nulls(attached(spark, sf), SLOW, "longest_run"), KEY, SLOW)


ORACLE["longest_complete_run"] = f"""WITH {ATTACHED_SQL}, f AS (SELECT *, order_value IS NOT NULL AND order_count IS NOT NULL AND avg_price IS NOT NULL AS ok FROM att),
g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS br FROM f),
r AS (SELECT symbol, period, br, count(*) AS n, min(timestamp) AS s FROM g WHERE ok GROUP BY 1, 2, 3),
b AS (SELECT symbol, period, arg_max(br, n * 1e13 - s) AS br FROM r GROUP BY 1, 2)
SELECT symbol, period, timestamp, {settle_all('order_value', 'avg_price')}, order_count FROM g JOIN b USING (symbol, period, br) WHERE ok"""


@query
def dataset_intersection(spark, sf):
    """Bars and fused bars: keys in both, features in both, labels from the first, absent ones from the second."""
    b = bars(spark, sf, "1d").drop("datetime")
    base = b.withColumn("target_up", (F.col("close") > F.col("open")).cast("int"))
    rich = joins.without_nulls(attached(spark, sf), ["avg_price"]).drop("open", "datetime")
    rich = rich.withColumn("target_big", (F.col("volume") > 50).cast("int"))
    return settled(joins.intersect_datasets(base, rich), KEY)


ORACLE["dataset_intersection"] = f"""WITH {ATTACHED_SQL}
SELECT symbol, period, timestamp, {settle_all('high', 'low', 'close', 'volume')}, CAST(close > open AS INT) AS target_up,
CAST(volume > 50 AS INT) AS target_big FROM att WHERE avg_price IS NOT NULL"""


@query
def modality_row_counts(spark, sf):
    views = joins.modality_views(attached(spark, sf), SLOW)
    out = None
    for name, v in views.items():
        one = v.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).withColumn("view", F.lit(name))
        one = one.withColumn("columns", F.lit(len([c for c in v.columns if c in SLOW])))
        out = one if out is None else out.unionByName(one)
    return out


ORACLE["modality_row_counts"] = f"""WITH {ATTACHED_SQL}, c AS (SELECT * FROM att WHERE order_value IS NOT NULL AND order_count IS NOT NULL AND avg_price IS NOT NULL)
SELECT symbol, count(*) AS rows, 'base' AS view, 0 AS columns FROM att GROUP BY 1
UNION ALL SELECT symbol, count(*), 'rich_complete', 3 FROM c GROUP BY 1
UNION ALL SELECT symbol, count(*), 'rich_only', 3 FROM c GROUP BY 1"""


@query
def pair_spread(spark, sf):
    out = joins.pair_spread(bars(spark, sf, "1d"), [("BUILDING", "MACHINERY"), ("FURNITURE", "HOUSEHOLD")])
    return settled(out, KEY, ["spread"])


ORACLE["pair_spread"] = f"""WITH {bars_sql('1d')}, s AS (
SELECT a.symbol || '/' || b.symbol AS symbol, a.period, a.timestamp, ln(a.close) - ln(b.close) AS spread FROM bars a JOIN bars b USING (period, timestamp)
WHERE (a.symbol = 'BUILDING' AND b.symbol = 'MACHINERY') OR (a.symbol = 'FURNITURE' AND b.symbol = 'HOUSEHOLD'))
SELECT symbol, period, timestamp, {settle_sql('spread')} FROM s"""


@query
def implied_prices(spark, sf):
    b = bars(spark, sf, "1d")
    preds = b.select(*KEY, (F.ln(F.col("high") / F.col("close"))).alias("score"))
    return settled(joins.implied_price(preds, b), KEY, ["simple_return", "implied_price"])


ORACLE["implied_prices"] = f"""WITH {bars_sql('1d')}, p AS (SELECT *, high / close - 1 AS simple_return, high AS implied_price FROM bars)
SELECT symbol, period, timestamp, {settle_all('simple_return', 'implied_price')} FROM p"""


@query
def symbol_affine_scores(spark, sf):
    """Per-symbol scale (clipped) and bias, then a sigmoid for the class label."""
    cu = table(spark, sf, "customer")
    params = cu.groupBy(F.col("c_mktsegment").alias("symbol")).agg(
        (F.avg("c_acctbal") / 400).alias("scale"), (F.max("c_acctbal") / 1e4 - 1).alias("bias")
    )
    b = bars(spark, sf, "1d")
    score = (F.col("close") - F.col("open")) / F.col("close")
    rows = b.select(*KEY, score.alias("score"), F.lit("target_binarytrend").alias("target")).unionByName(
        b.select(*KEY, score.alias("score"), F.lit("target_logreturn").alias("target"))
    )
    return settled(joins.calibrate_scores(rows, params, ["target_binarytrend"]), [*KEY, "target"], ["score", "calibrated"])


ORACLE["symbol_affine_scores"] = f"""WITH {bars_sql('1d')},
pa AS (SELECT c_mktsegment AS symbol, least(greatest(avg(c_acctbal) / 400, 0.1), 10) AS sc, max(c_acctbal) / 1e4 - 1 AS bi FROM customer GROUP BY 1),
r AS (SELECT symbol, period, timestamp, (close - open) / close AS score, t.target FROM bars, (VALUES ('target_binarytrend'), ('target_logreturn')) t(target)),
c AS (SELECT r.*, CASE WHEN target = 'target_binarytrend' THEN 1 / (1 + exp(-(score * sc + bi))) ELSE score * sc + bi END AS calibrated FROM r JOIN pa USING (symbol))
SELECT symbol, period, timestamp, target, {settle_all('score', 'calibrated')} FROM c"""


@query
def net_flow(spark, sf):
    """Daily finished minus open order value, a missing side counting as zero."""
    from barloom.operators.market import net_flow as flow

    od = table(spark, sf, "orders").withColumn("timestamp", F.unix_millis("o_orderdate"))
    by = lambda s, n: od.filter(F.col("o_orderstatus") == s).groupBy("timestamp").agg(F.sum("o_totalprice").alias(n))
    both = joins.assemble_series([by("F", "inflow"), by("O", "outflow")], ["timestamp"])
    return settled(both.withColumn("net_flow", flow(F.col("inflow"), F.col("outflow"))), ["timestamp"], ["net_flow"])


ORACLE["net_flow"] = f"""WITH f AS (SELECT epoch_ms(o_orderdate) AS timestamp,
coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) - coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) AS net_flow
FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) SELECT timestamp, {settle_sql('net_flow')} FROM f"""
