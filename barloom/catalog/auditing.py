"""Coverage, health, continuity, leakage, splits and ordering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fusing import ATTACHED_SQL, SLOW, attached, settle_all
from barloom.catalog.indicators import KEY, W
from barloom.catalog.tables import bars, bars_sql, global_series, SERIES_SQL, settle_sql, settled, symbol_series, table
from barloom.operators import audits, indicators as ind, splits
from barloom.schema import KEYS

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


ALL_BARS = f"WITH {bars_sql()} "
DAILY = f"WITH {bars_sql('1d')} "


@query
def group_summary(spark, sf):
    return audits.group_summary(bars(spark, sf))


ORACLE["group_summary"] = ALL_BARS + "SELECT symbol, period, count(*) AS rows, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM bars GROUP BY 1, 2"


@query
def dataset_summaries(spark, sf):
    """Group summaries of the plain and the complete fused dataset, stacked."""
    from barloom.operators.joins import without_nulls

    full = attached(spark, sf)
    return audits.dataset_summaries({"base": full, "complete": without_nulls(full, SLOW)})


ORACLE["dataset_summaries"] = f"""WITH {ATTACHED_SQL}, a AS (SELECT 'base' AS dataset, * FROM att UNION ALL
SELECT 'complete', * FROM att WHERE order_value IS NOT NULL AND order_count IS NOT NULL AND avg_price IS NOT NULL)
SELECT dataset, symbol, period, count(*) AS rows, min(timestamp) AS start_ts, max(timestamp) AS end_ts FROM a GROUP BY 1, 2, 3"""


@query
def coverage_levels(spark, sf):
    return settled(audits.coverage(attached(spark, sf), SLOW), ["level", "symbol", "period", "column", "total_rows", "non_null"])


ORACLE["coverage_levels"] = f"""WITH {ATTACHED_SQL}, l AS (
SELECT symbol, period, timestamp, c.* FROM att, LATERAL (VALUES ('order_value', order_value IS NOT NULL), ('order_count', order_count IS NOT NULL), ('avg_price', avg_price IS NOT NULL)) c("column", k)),
g AS (SELECT CASE grouping(symbol) + grouping(period) WHEN 2 THEN 'overall' WHEN 1 THEN 'period' ELSE 'symbol_period' END AS level, symbol, period, "column",
count(*) AS total_rows, CAST(sum(k::INT) AS BIGINT) AS non_null, avg(k::INT) AS r FROM l GROUP BY GROUPING SETS (("column"), ("column", period), ("column", symbol, period)))
SELECT level, symbol, period, "column", total_rows, non_null, {settle_sql('r', 'non_null_ratio')} FROM g"""


@query
def first_known_time(spark, sf):
    return audits.first_known_time(attached(spark, sf), SLOW)


ORACLE["first_known_time"] = f"""WITH {ATTACHED_SQL} """ + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", min(timestamp) FILTER (WHERE {c} IS NOT NULL) AS first_ts FROM att" for c in SLOW
)


@query
def top_null_columns(spark, sf):
    return settled(audits.top_null_columns(attached(spark, sf), [*SLOW, "open", "close"], 4), ["column"])


ORACLE["top_null_columns"] = f"WITH {ATTACHED_SQL}, u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 1 - count({c}) / count(*) AS r FROM att" for c in [*SLOW, "open", "close"]
) + f""") SELECT "column", {settle_sql('r', 'null_ratio')} FROM (SELECT * FROM u ORDER BY r DESC, "column" LIMIT 4)"""


@query
def feature_moments(spark, sf):
    return settled(audits.feature_moments(attached(spark, sf), [*SLOW, "close", "volume"]), ["feature"])


ORACLE["feature_moments"] = f"WITH {ATTACHED_SQL}, u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) / count(*) AS coverage, var_samp({c}) AS variance FROM att" for c in [*SLOW, "close", "volume"]
) + f") SELECT feature, {settle_all('coverage', 'variance')} FROM u"

_HEALTH = [*SLOW, "close", "volume", "high"]


@query
def column_health(spark, sf):
    return settled(audits.column_health(attached(spark, sf), _HEALTH), ["feature", "nunique", "constant"])


def _health(c):
    return f"""SELECT '{c}' AS feature, 1 - count({c}) / count(*) AS null_ratio, count(DISTINCT {c}) AS nunique,
CAST(count(DISTINCT {c}) <= 1 AS INT) AS constant, count(*) FILTER (WHERE abs({c} - mu_{c}) / sd_{c} > 6) / count(*) AS extreme_ratio FROM att, s"""


ORACLE["column_health"] = f"WITH {ATTACHED_SQL}, s AS (SELECT " + ", ".join(
    f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}" for c in _HEALTH
) + " FROM att), u AS (" + " UNION ALL ".join(map(_health, _HEALTH)) + f") SELECT feature, nunique, constant, {settle_all('null_ratio', 'extreme_ratio')} FROM u"


@query
def value_distribution(spark, sf):
    return settled(audits.distribution(attached(spark, sf), _HEALTH), ["feature"])


_QS = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
ORACLE["value_distribution"] = f"WITH {ATTACHED_SQL}, u AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", """
    + ", ".join(f"quantile_cont({c}, {q}) AS {n}" for n, q in _QS.items())
    + " FROM att"
    for c in _HEALTH
) + f""") SELECT feature, {settle_all('mean', 'std')}, {settle_sql('"min"')}, {settle_sql('"max"')}, {settle_all(*_QS)} FROM u"""


@query
def early_null_rate(spark, sf):
    return settled(audits.early_null_rate(attached(spark, sf), SLOW), list(KEYS))


ORACLE["early_null_rate"] = f"""WITH {ATTACHED_SQL}, n AS (SELECT *, row_number() OVER ({W}) AS rn FROM att),
a AS (SELECT symbol, period, avg((order_value IS NULL)::INT + (order_count IS NULL)::INT + (avg_price IS NULL)::INT) / 3 AS r FROM n WHERE rn <= 64 GROUP BY 1, 2)
SELECT symbol, period, {settle_sql('r', 'early_null_rate')} FROM a"""


@query
def null_shape(spark, sf):
    cols = ["column", "leading", "inner_nulls", "trailing", "has_contiguous_tail", "is_strict_early_gap", "first_known_ts", "last_known_ts"]
    return settled(audits.null_shape(attached(spark, sf), SLOW), [*KEYS, *cols])


def _shape(c):
    return f"""SELECT symbol, period, '{c}' AS "column", count(*) AS n, count({c}) AS k, min(rn) FILTER (WHERE {c} IS NOT NULL) AS f,
max(rn) FILTER (WHERE {c} IS NOT NULL) AS l, min(timestamp) FILTER (WHERE {c} IS NOT NULL) AS first_known_ts, max(timestamp) FILTER (WHERE {c} IS NOT NULL) AS last_known_ts
FROM nn GROUP BY 1, 2"""


ORACLE["null_shape"] = f"""WITH {ATTACHED_SQL}, nn AS (SELECT *, row_number() OVER ({W}) - 1 AS rn FROM att), s AS ({' UNION ALL '.join(map(_shape, SLOW))}),
d AS (SELECT *, 1 - k / n AS r, coalesce(f, n) AS leading_, coalesce(l - f + 1 - k, 0) AS inner_nulls, coalesce(n - 1 - l, n) AS trailing_ FROM s)
SELECT symbol, period, "column", leading_ AS leading, inner_nulls, trailing_ AS trailing, CAST(k > 0 AND trailing_ = 0 AS INT) AS has_contiguous_tail,
CAST(leading_ > 0 AND leading_ < n AND inner_nulls = 0 AND trailing_ = 0 AS INT) AS is_strict_early_gap, first_known_ts, last_known_ts, {settle_sql('r', 'nan_ratio')} FROM d"""


@query
def time_column_detection(spark, sf):
    """Score of every event column; times are kept as text to be recognised."""
    ev = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("open_time"), F.unix_millis("ts").alias("stamp_ms"), "value", "user_id"
    )
    out = audits.time_column_scores(
        ev.withColumn("row", F.col("event_id")), ["open_time", "stamp_ms", "value"], ["row"], F.floor(F.col("event_id") / 4096)
    )
    return settled(out, ["column"])


ORACLE["time_column_detection"] = f"""WITH e AS (SELECT event_id, epoch_ms(date_trunc('second', ts)) AS a, epoch_us(ts) // 1000 AS b,
CAST(trunc(value) AS BIGINT) * 1000 AS c FROM events),
l AS (SELECT event_id, x.* FROM e, LATERAL (VALUES ('open_time', a, 0.1), ('stamp_ms', b, 0.0), ('value', c, 0.0)) x("column", ms, nm)),
p AS (SELECT *, lag(ms) OVER (PARTITION BY "column" ORDER BY event_id) AS pv FROM l),
g AS (SELECT "column", count(ms) / count(*) AS ok, CASE WHEN count(*) FILTER (WHERE ms < pv) = 0 OR count(*) FILTER (WHERE ms > pv) = 0 THEN 0.15 ELSE 0 END AS mono,
0.15 * count(DISTINCT ms) / count(ms) AS uq, any_value(nm) AS nm, CASE WHEN min(ms) >= 1230768000000 AND max(ms) <= 4102444800000 THEN 0.1 ELSE 0 END AS pl FROM p GROUP BY 1),
f AS (SELECT "column", ok AS parse_ratio, CAST(ok + mono + uq + nm + pl AS DOUBLE) AS score FROM g)
SELECT "column", {settle_all('parse_ratio', 'score')} FROM f"""


@query
def symbol_hygiene(spark, sf):
    """Raw symbol spellings made from part types: separators, glued pairs, nulls and literal nan."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey") % 5
    sym = (
        F.when(k == 0, F.concat("p_type", F.lit("/USDT")))
        .when(k == 1, F.concat("p_type", F.lit("usdt")))
        .when(k == 2, F.lit("nan"))
        .when(k == 3, F.concat("p_type", F.lit("_USDT")))
    )
    return audits.symbol_hygiene(p.select(sym.alias("symbol")))


ORACLE["symbol_hygiene"] = """WITH s AS (SELECT CASE p_partkey % 5 WHEN 0 THEN p_type || '/USDT' WHEN 1 THEN p_type || 'usdt' WHEN 2 THEN 'nan' WHEN 3 THEN p_type || '_USDT' END AS symbol FROM part)
SELECT count(*) AS rows, count(*) FILTER (WHERE symbol IS NULL) AS null_rows, count(*) FILTER (WHERE lower(trim(symbol)) = 'nan') AS literal_nan,
count(*) FILTER (WHERE regexp_matches(trim(symbol), '/|-')) AS slash_or_dash,
count(*) FILTER (WHERE regexp_full_match(trim(symbol), '[a-z]+(usdt|usd|busd|usdc)', 'i')) AS glued_pairs FROM s"""


@query
def quality_suggestion(spark, sf):
    b = bars(spark, sf)
    known = F.col("close") > F.col("open")
    df = b.withColumns({"onchain_a": F.when(known, 1.0), "onchain_b": F.when(F.col("volume") > 8, 1.0)})
    return settled(audits.quality_suggestion(df, ["onchain_a", "onchain_b"]), ["period"])


ORACLE["quality_suggestion"] = ALL_BARS + f""", s AS (SELECT period, (avg((close > open)::INT) + avg((volume > 8)::INT)) / 2 AS score FROM bars GROUP BY 1),
q AS (SELECT *, 0.6 + 0.4 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS quality FROM s)
SELECT period, {settle_all('score', 'quality')} FROM q"""


@query
def series_time_ranges(spark, sf):
    stack = symbol_series(spark, sf).select("timestamp", F.concat(F.lit("sym_"), "symbol").alias("dataset")).unionByName(
        global_series(spark, sf).select("timestamp", F.lit("glob").alias("dataset"))
    )
    return audits.series_time_ranges(stack, "dataset")


ORACLE["series_time_ranges"] = f"""WITH {SERIES_SQL}, s AS (SELECT 'sym_' || symbol AS dataset, timestamp FROM sym UNION ALL SELECT 'glob', timestamp FROM mkt)
SELECT dataset, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS rows FROM s GROUP BY 1"""

_STEP = "CASE period WHEN '1h' THEN 3600000 WHEN '4h' THEN 14400000 ELSE 86400000 END"


@query
def continuity_audit(spark, sf):
    return audits.continuity(bars(spark, sf))


ORACLE["continuity_audit"] = ALL_BARS + f""", p AS (SELECT *, lag(timestamp) OVER ({W}) AS pt, {_STEP} AS st FROM bars),
d AS (SELECT symbol, period, timestamp - pt AS d, count(*) AS n FROM p WHERE pt IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT symbol, period, arg_max(d, n * 1e12 - d) AS step_ms_inferred FROM d GROUP BY 1, 2),
g AS (SELECT symbol, period, count(*) AS rows, count(DISTINCT timestamp) AS unique_ts, min(timestamp) AS start_ts, max(timestamp) AS end_ts,
any_value(st) AS step_ms, count(*) FILTER (WHERE timestamp - pt > st) AS gaps FROM p GROUP BY 1, 2)
SELECT g.*, step_ms_inferred, (end_ts - start_ts) // step_ms + 1 AS expected_rows, greatest(0, (end_ts - start_ts) // step_ms + 1 - unique_ts) AS missing_points,
CAST(gaps = 0 AND rows = unique_ts AS INT) AS is_continuous, CAST(rows > unique_ts AS INT) AS has_duplicates FROM g JOIN m USING (symbol, period)"""


@query
def missing_instants(spark, sf):
    """Every absent bar time, without the report's limit."""
    return audits.missing_points(bars(spark, sf), None)


_GAPS = f""", p AS (SELECT *, lag(timestamp) OVER ({W}) AS pt, {_STEP} AS st FROM bars),
x AS (SELECT symbol, period, unnest(generate_series(pt + st, timestamp - st, st)) AS missing_ts FROM p WHERE timestamp - pt > st)"""
ORACLE["missing_instants"] = ALL_BARS + _GAPS + " SELECT symbol, period, missing_ts FROM x"


@query
def missing_instants_report(spark, sf):
    """The first 25 absent bar times of each group."""
    return audits.missing_points(bars(spark, sf), 25)


ORACLE["missing_instants_report"] = ALL_BARS + _GAPS + """ SELECT symbol, period, missing_ts FROM x
QUALIFY row_number() OVER (PARTITION BY symbol, period ORDER BY missing_ts) <= 25"""


@query
def time_idx_breaks(spark, sf):
    """Groups whose bar number jumps once incomplete rows are cut out."""
    from barloom.operators.joins import without_nulls

    df = splits.with_time_idx(attached(spark, sf))
    return audits.time_idx_breaks(without_nulls(df, ["avg_price"]))


ORACLE["time_idx_breaks"] = f"""WITH {ATTACHED_SQL}, i AS (SELECT *, row_number() OVER ({W}) - 1 AS time_idx FROM att),
l AS (SELECT *, time_idx - lag(time_idx) OVER ({W}) AS d FROM i WHERE avg_price IS NOT NULL)
SELECT symbol, period, count(*) FILTER (WHERE d <> 1) AS breaks FROM l GROUP BY 1, 2 HAVING count(*) FILTER (WHERE d <> 1) > 0"""


@query
def leakage_audit(spark, sf):
    df = splits.with_time_idx(bars(spark, sf, "1d"))
    df = df.withColumns(
        {
            "score__a__target_up": F.when(F.col("volume") > 20, F.col("close")),
            "schema_ver": F.lit("s1"),
            "data_ver": F.lit("d1"),
            "expert_ver": F.lit("e1"),
            "train_window_id": F.col("period"),
        }
    )
    return audits.leakage(df.unionByName(df.filter("time_idx % 100 = 0")))


ORACLE["leakage_audit"] = DAILY + f""", i AS (SELECT *, row_number() OVER ({W}) - 1 AS time_idx FROM bars),
a AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE time_idx % 100 = 0),
s AS (SELECT *, time_idx - lag(time_idx) OVER (PARTITION BY symbol, period ORDER BY time_idx) AS d FROM a)
SELECT CAST(count(*) - count(DISTINCT (symbol, period, time_idx)) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE d <= 0) AS non_positive_steps, max(d) AS max_gap,
count(*) FILTER (WHERE volume <= 20) AS missing_scores, 1 AS version_tuples, 1 AS window_ids, 0 AS passed FROM s"""


@query
def truncation_check(spark, sf):
    """Indicator rows that change when later bars are removed: none may."""
    def work(df):
        return settled(ind.compute(df, ["bollinger", "relative_strength", "macd"]), KEY, ["boll_upper", "rsi", "macd_hist"])

    return audits.truncation_breaks(work, bars(spark, sf, "1d"), 883_612_800_000, ["boll_upper", "rsi", "macd_hist"])


ORACLE["truncation_check"] = "SELECT '' AS symbol, '' AS period, 0::BIGINT AS timestamp, 0.0::DOUBLE AS boll_upper, 0.0::DOUBLE AS rsi, 0.0::DOUBLE AS macd_hist WHERE false"

# --- splits -------------------------------------------------------------------------------------


@query
def ratio_split(spark, sf):
    return splits.ratio_split(bars(spark, sf)).select(*KEY, F.col("is_val").cast("int").alias("is_val"))


ORACLE["ratio_split"] = ALL_BARS + f"""SELECT symbol, period, timestamp,
CAST(row_number() OVER ({W}) - 1 >= floor(count(*) OVER (PARTITION BY symbol, period) * 0.8::DOUBLE) AS INT) AS is_val FROM bars"""


@query
def days_split(spark, sf):
    b = bars(spark, sf)
    own = splits.days_split(b, 30).select(*KEY, F.col("is_val").cast("int").alias("val_group"))
    one = splits.days_split(b, 30, per_group=False).select(*KEY, F.col("is_val").cast("int").alias("val_global"))
    return own.join(one, KEY)


ORACLE["days_split"] = ALL_BARS + """SELECT symbol, period, timestamp, CAST(timestamp > max(timestamp) OVER (PARTITION BY symbol, period) - 2592000000 AS INT) AS val_group,
CAST(timestamp > max(timestamp) OVER () - 2592000000 AS INT) AS val_global FROM bars"""


@query
def rolling_folds(spark, sf):
    out = splits.rolling_folds(bars(spark, sf, "1d"), 5, 0.2)
    return out.select(*KEY, F.col("fold").cast("int").alias("fold"), F.col("is_val").cast("int").alias("is_val"))


ORACLE["rolling_folds"] = DAILY + """, t AS (SELECT period, timestamp, row_number() OVER (PARTITION BY period ORDER BY timestamp) - 1 AS i,
count(*) OVER (PARTITION BY period) AS n FROM (SELECT DISTINCT period, timestamp FROM bars)),
f AS (SELECT period, k, max(timestamp) FILTER (WHERE i = k * greatest(1, CAST(floor(n * 0.8::DOUBLE / 6) AS BIGINT))) AS cut,
max(timestamp) FILTER (WHERE i = least(n - 1, k * greatest(1, CAST(floor(n * 0.8::DOUBLE / 6) AS BIGINT)) + CAST(floor(n * 0.2::DOUBLE) AS BIGINT))) AS e FROM t, range(1, 6) r(k) GROUP BY 1, 2)
SELECT symbol, bars.period, timestamp, CAST(k AS INT) AS fold, CAST(timestamp > cut AS INT) AS is_val FROM bars JOIN f ON bars.period = f.period AND timestamp <= e"""


@query
def three_way_split(spark, sf):
    df = splits.with_time_idx(bars(spark, sf, "1d"))
    return splits.three_way_split(df).select(*KEY, "time_idx", "part")


ORACLE["three_way_split"] = DAILY + f""", i AS (SELECT *, row_number() OVER ({W}) - 1 AS time_idx FROM bars), u AS (SELECT count(DISTINCT time_idx) AS n FROM i)
SELECT symbol, period, timestamp, time_idx, CASE WHEN time_idx <= floor(n * 0.6::DOUBLE) - 1 THEN 'train' WHEN time_idx <= floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM i, u"""


@query
def embargo_purge_mask(spark, sf):
    return splits.edge_mask(bars(spark, sf), 10, 5).select(*KEY, F.col("valid").cast("int").alias("valid"))


ORACLE["embargo_purge_mask"] = ALL_BARS + f"""SELECT symbol, period, timestamp, CAST(row_number() OVER ({W}) > 10
AND row_number() OVER ({W}) <= count(*) OVER (PARTITION BY symbol, period) - 5 AS INT) AS valid FROM bars"""


@query
def era_labels(spark, sf):
    return splits.era_label(splits.ratio_split(bars(spark, sf)))


ORACLE["era_labels"] = ALL_BARS + "SELECT symbol, period, CAST(year(make_timestamp(max(timestamp) * 1000)) AS VARCHAR) AS era FROM bars GROUP BY 1, 2"


@query
def supervised_windows(spark, sf):
    """Encoder windows of eight bars, checked by their sums."""
    b = bars(spark, sf, "1d").withColumn("target_up", (F.col("close") > F.col("open")).cast("int"))
    out = splits.supervised_windows(b, ["close", "volume"], "target_up", 8)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x[0] + x[1])
    return settled(out.select(*KEY, "label", F.size("window").alias("length"), total.alias("total")), [*KEY, "label", "length"])


ORACLE["supervised_windows"] = DAILY + f""", w AS (SELECT *, row_number() OVER ({W}) AS rn, lead(CAST(close > open AS INT)) OVER ({W}) AS label,
sum(close + volume) OVER ({W} ROWS 7 PRECEDING) AS s FROM bars)
SELECT symbol, period, timestamp, label, 8 AS length, {settle_sql('s', 'total')} FROM w WHERE rn >= 8 AND label IS NOT NULL"""


@query
def merged_time_idx(spark, sf):
    df = splits.with_time_idx(bars(spark, sf), ["view", "click", "error"], ["1h", "4h", "1d"])
    return df.select(*KEY, "time_idx")


ORACLE["merged_time_idx"] = ALL_BARS + f"SELECT symbol, period, timestamp, row_number() OVER ({W}) - 1 AS time_idx FROM bars"


@query
def top_bars_per_group(spark, sf):
    return settled(splits.top_k_per_group(bars(spark, sf), KEYS, "volume", 5, ["timestamp"]), KEY, ["volume"])


ORACLE["top_bars_per_group"] = ALL_BARS + f"""SELECT symbol, period, timestamp, {settle_sql('volume')} FROM (SELECT * FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol, period ORDER BY volume DESC, timestamp) <= 5)"""


@query
def last_row_per_key(spark, sf):
    """The last order of each customer."""
    od = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.unix_millis("o_orderdate").alias("ms"))
    return settled(splits.keep_last(od, ["o_custkey"], ["ms", "o_orderkey"]), ["o_custkey", "o_orderkey", "ms"])


ORACLE["last_row_per_key"] = f"""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, epoch_ms(o_orderdate) AS ms FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT o_custkey, o_orderkey, ms, {settle_sql('o_totalprice')} FROM o"""


@query
def train_validation_counts(spark, sf):
    df = splits.ratio_split(bars(spark, sf))
    return audits.group_counts(df, F.col("is_val"))


ORACLE["train_validation_counts"] = ALL_BARS + """SELECT symbol, period, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS train_rows,
CAST(count(*) - floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS val_rows FROM bars GROUP BY 1, 2"""
