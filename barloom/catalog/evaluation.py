"""Prediction tables, stacking, calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.catalog.fusing import settle_all
from barloom.catalog.indicators import KEY, W, full
from barloom.catalog.tables import bars, bars_sql, settle_sql, settled, table
from barloom.operators import metrics, splits, stacking
from barloom.operators.chunks import halo_chunks
from barloom.sources.staging import staged

QUERIES: dict = {}
ORACLE: dict = {}
GROUP = ["symbol", "period", "target"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def class_rows(spark, sf) -> DataFrame:
    """Labelled documents as a binary evaluation set: quality against a logistic of the length."""
    la, do = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    prob = 1 / (1 + F.exp(-(F.col("n_chars") - 500) / 400))
    return la.join(do, "doc_id").select(
        "doc_id", F.col("lang").alias("symbol"), F.col("source").alias("period"), F.lit("quality").alias("target"),
        prob.alias("prob"), F.col("quality").alias("label"),
    )


CLASS_SQL = """ev AS (SELECT doc_id, lang AS symbol, source AS period, 'quality' AS target, 1 / (1 + exp(-(n_chars - 500) / 400)) AS prob, quality AS label
FROM labels JOIN documents USING (doc_id))"""


@query
def average_precision(spark, sf):
    ev = class_rows(spark, sf)
    by = metrics.average_precision(ev, ["symbol"], "prob", "label")
    return settled(by, ["symbol"])


def ap_sql(keys, src="ev", score="prob", label="label", name="ap"):
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    return f"""{name}0 AS (SELECT {k}{',' if keys else ''} {score} AS sc, count(*) AS n, CAST(sum({label}) AS BIGINT) AS p FROM {src} GROUP BY {k}{',' if keys else ''} {score}),
{name}1 AS (SELECT *, sum(n) OVER ({part} ORDER BY sc DESC) AS cn, sum(p) OVER ({part} ORDER BY sc DESC) AS cp FROM {name}0),
{name} AS (SELECT {k}{',' if keys else ''} CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN sum(p * cp / cn) / sum(p) END AS pr_auc FROM {name}1 {'GROUP BY ' + k if keys else ''})"""


ORACLE["average_precision"] = f"WITH {CLASS_SQL}, {ap_sql(['symbol'])} SELECT symbol, {settle_sql('pr_auc')} FROM ap"


@query
def roc_auc(spark, sf):
    return settled(metrics.roc_auc(class_rows(spark, sf), ["symbol"], "prob", "label"), ["symbol"])


ORACLE["roc_auc"] = f"""WITH {CLASS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY prob) + (count(*) OVER (PARTITION BY symbol, prob) - 1) / 2.0 AS rk FROM ev),
a AS (SELECT symbol, sum(label) AS p, count(*) - sum(label) AS n, sum(rk) FILTER (WHERE label = 1) AS s FROM r GROUP BY 1),
b AS (SELECT symbol, CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2.0) / (p * n) END AS roc_auc FROM a) SELECT symbol, {settle_sql('roc_auc')} FROM b"""


def bins_sql(n: int, keys=("symbol",)):
    edges = "[" + ", ".join(repr(i * (1.0 / n)) + "::DOUBLE" for i in range(n)) + "]"
    k = ", ".join(keys)
    return f"""bn AS (SELECT *, len(list_filter({edges}, lambda e: e < prob)) AS bin, CAST((prob > 0.5) = (label = 1) AS INT) AS ok FROM ev),
cb AS (SELECT {k}, bin, count(*) AS n, avg(prob) AS confidence, avg(ok) AS accuracy, avg(label) AS positive_rate FROM bn WHERE bin > 0 GROUP BY {k}, bin)"""


@query
def reliability_curve(spark, sf):
    return settled(metrics.calibration_bins(class_rows(spark, sf), ["symbol"], "prob", "label", 10), ["symbol", "bin", "n"])


ORACLE["reliability_curve"] = f"WITH {CLASS_SQL}, {bins_sql(10)} SELECT symbol, CAST(bin AS INT) AS bin, n, {settle_all('confidence', 'accuracy', 'positive_rate')} FROM cb"


@query
def calibration_error(spark, sf):
    ev = class_rows(spark, sf)
    a = metrics.expected_calibration_error(ev, ["symbol"], "prob", "label", 15)
    b = metrics.expected_calibration_error(ev, ["symbol"], "prob", "label", 15, against="positive_rate")
    return settled(a.join(b.withColumnRenamed("ece", "ece_standard"), "symbol"), ["symbol"])


ORACLE["calibration_error"] = f"""WITH {CLASS_SQL}, {bins_sql(15)}, t AS (SELECT symbol, count(*) AS a FROM ev GROUP BY 1),
e AS (SELECT symbol, sum(abs(confidence - accuracy) * n) / any_value(a) AS ece, sum(abs(confidence - positive_rate) * n) / any_value(a) AS ece_standard FROM cb JOIN t USING (symbol) GROUP BY 1)
SELECT symbol, {settle_all('ece', 'ece_standard')} FROM e"""


@query
def confusion_metrics(spark, sf):
    ev = class_rows(spark, sf)
    both = metrics.classification(ev, ["symbol", "period"], "prob", "label").join(
        metrics.brier(ev, ["symbol", "period"], "prob", "label"), ["symbol", "period"]
    )
    return settled(both, ["symbol", "period", "tp", "fp", "fn", "tn"])


ORACLE["confusion_metrics"] = f"""WITH {CLASS_SQL}, c AS (SELECT symbol, period, count(*) FILTER (WHERE prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE prob >= 0.5 AND label = 0) AS fp,
count(*) FILTER (WHERE prob < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE prob < 0.5 AND label = 0) AS tn, avg((prob - label) ** 2) AS brier FROM ev GROUP BY 1, 2),
d AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)
SELECT symbol, period, tp, fp, fn, tn, {settle_all('accuracy', 'precision', 'recall', 'f1', 'brier')} FROM d"""


def value_rows(spark, sf, daily: DataFrame | None = None) -> DataFrame:
    """Bars as a forecast set: the previous return predicts the next, sigma is the rolling deviation. daily: the daily bars, if at hand."""
    from barloom.functions import frames as fr

    daily = bars(spark, sf, "1d") if daily is None else daily
    ck = halo_chunks(daily.select(*KEY, "close"), back=22, ahead=1)
    w = ck.w
    df = ck.df.withColumn("_pc", F.lag("close").over(w)).withColumn("_nc", F.lead("close").over(w))
    df = df.withColumn("pred", F.ln(F.col("close") / F.col("_pc"))).withColumn("y", F.ln(F.col("_nc") / F.col("close")))
    df = df.withColumn("sigma", fr.std(F.col("pred"), w, 20))
    return ck.owned(df).withColumn("target", F.lit("ret")).filter("pred is not null and y is not null and sigma is not null")


VALUE_SQL = f"""{bars_sql('1d')}, v0 AS (SELECT *, ln(close / lag(close) OVER ({W})) AS pred, ln(lead(close) OVER ({W}) / close) AS y FROM bars),
v1 AS (SELECT *, 'ret' AS target, {full('stddev_samp(pred)', 'pred', 20)} AS sigma FROM v0),
v AS (SELECT * FROM v1 WHERE pred IS NOT NULL AND y IS NOT NULL AND sigma IS NOT NULL)"""
BOUNDS = {10: -1.2815515655446004, 50: 0.0, 90: 1.2815515655446004}


def interval_sql():
    out = []
    for q, z in BOUNDS.items():
        d, t = f"(y - (pred + {z} * sigma))", q / 100
        out += [f"avg(({d} <= 0)::INT) AS coverage_{q}", f"avg(greatest({t} * {d}, ({t} - 1) * {d})) AS pinball_{q}"]
    return ", ".join(out)


_VM = ["rmse", "mae", "r2", *[f"{m}_{q}" for q in BOUNDS for m in ("coverage", "pinball")]]


@query
def forecast_metrics(spark, sf):
    ev = value_rows(spark, sf)
    out = metrics.regression(ev, GROUP, "pred", "y").join(metrics.interval_metrics(ev, GROUP, "pred", "sigma", "y"), GROUP)
    return settled(out, GROUP)


ORACLE["forecast_metrics"] = f"""WITH {VALUE_SQL}, m AS (SELECT symbol, period, target, sqrt(avg((pred - y) ** 2)) AS rmse, avg(abs(pred - y)) AS mae,
1 - sum((pred - y) ** 2) / (var_pop(y) * count(y)) AS r2, {interval_sql()} FROM v GROUP BY 1, 2, 3) SELECT symbol, period, target, {settle_all(*_VM)} FROM m"""


@query
def evaluation_report(spark, sf):
    return settled(metrics.evaluation_report(class_rows(spark, sf), value_rows(spark, sf)), [*GROUP, "metric"])


_RM = ["rmse", *_VM[3:]]
ORACLE["evaluation_report"] = f"""WITH {CLASS_SQL}, {VALUE_SQL}, {ap_sql(GROUP)}, {bins_sql(15, GROUP)}, t AS (SELECT symbol, period, target, count(*) AS a, avg((prob - label) ** 2) AS brier FROM ev GROUP BY 1, 2, 3),
e AS (SELECT t.symbol, t.period, t.target, coalesce(sum(abs(confidence - accuracy) * n), 0) / any_value(a) AS ece FROM t LEFT JOIN cb ON t.symbol = cb.symbol AND t.period = cb.period AND t.target = cb.target GROUP BY 1, 2, 3),
m AS (SELECT symbol, period, target, sqrt(avg((pred - y) ** 2)) AS rmse, {interval_sql()} FROM v GROUP BY 1, 2, 3),
r AS (SELECT symbol, period, target, 'pr_auc' AS metric, pr_auc AS x FROM ap UNION ALL SELECT symbol, period, target, 'ece', ece FROM e UNION ALL SELECT symbol, period, target, 'brier', brier FROM t
{' '.join(f"UNION ALL SELECT symbol, period, target, '{c}', {c} FROM m" for c in _RM)})
SELECT symbol, period, target, metric, {settle_sql('x', 'value')} FROM r"""


@query
def class_balance_weights(spark, sf):
    out = metrics.class_weights(class_rows(spark, sf), "label")
    out = metrics.named_weights(out, "symbol", {"en": 2.0, "de": 0.5}, "symbol_weight")
    return settled(out.select("doc_id", "label", "weight", "symbol_weight"), ["doc_id", "label"])


ORACLE["class_balance_weights"] = f"""WITH {CLASS_SQL}, c AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM ev),
w AS (SELECT least(greatest(n / (p + 1e-6), 0.1), 10) AS wp, least(greatest(p / (n + 1e-6), 0.1), 10) AS wn, p, n FROM c),
x AS (SELECT doc_id, label, CASE WHEN label = 1 THEN wp ELSE wn END * (p + n) / (p * wp + n * wn) AS weight, CASE symbol WHEN 'en' THEN 2.0 WHEN 'de' THEN 0.5 ELSE 1.0 END AS symbol_weight FROM ev, w)
SELECT doc_id, label, {settle_all('weight', 'symbol_weight')} FROM x"""

# --- predictions and stacking -------------------------------------------------------------------


def labelled_bars(spark, sf, daily: DataFrame | None = None) -> DataFrame:
    """Daily bars with time_idx, a class label and the two lagged quantities the pseudo-experts see. daily: the daily bars, if at hand."""
    b = splits.with_time_idx(bars(spark, sf, "1d") if daily is None else daily).drop("datetime")
    ck = halo_chunks(b, back=2)
    pc, pc2 = F.lag("close").over(ck.w), F.lag("close", 2).over(ck.w)
    ph, pl = F.lag("high").over(ck.w), F.lag("low").over(ck.w)
    df = ck.df.withColumns({"x_mom": pc / pc2 - 1, "x_rng": (ph - pl) / pc, "target_up": (F.col("close") > F.col("open")).cast("int")})
    return staged(ck.owned(df), "labelled")


def predictions(df) -> DataFrame:
    """Long predictions of two pseudo-experts on `labelled_bars`, with constant versions."""
    out = None
    for expert, x in (("mom", "x_mom"), ("rng", "x_rng")):
        one = df.filter(F.col(x).isNotNull()).select(
            "symbol", "period", "time_idx", F.lit("target_up").alias("target"), (1 / (1 + F.exp(-F.col(x)))).alias("score"),
            (F.col(x) * F.col(x)).alias("uncertainty"), F.lit(expert).alias("expert"),
            *[F.lit(v).alias(c) for c, v in (("schema_ver", "s1"), ("data_ver", "d1"), ("expert_ver", "e1"), ("train_window_id", "w1"))],
        )
        out = one if out is None else out.unionByName(one)
    return out


PRED_SQL = f"""{bars_sql('1d')}, lb AS (SELECT *, row_number() OVER ({W}) - 1 AS time_idx, CAST(close > open AS INT) AS target_up,
lag(close) OVER ({W}) / lag(close, 2) OVER ({W}) - 1 AS x_mom, (lag(high) OVER ({W}) - lag(low) OVER ({W})) / lag(close) OVER ({W}) AS x_rng FROM bars),
pv AS (SELECT symbol, period, timestamp, time_idx, target_up, 1 / (1 + exp(-x_mom)) AS score__mom__target_up, 1 / (1 + exp(-x_rng)) AS score__rng__target_up,
x_mom * x_mom AS uncertainty__mom__target_up, x_rng * x_rng AS uncertainty__rng__target_up FROM lb WHERE x_mom IS NOT NULL OR x_rng IS NOT NULL)"""
_WIDE = ["score__mom__target_up", "score__rng__target_up", "uncertainty__mom__target_up", "uncertainty__rng__target_up"]
_ROW = ["symbol", "period", "time_idx"]


@query
def prediction_pivot(spark, sf):
    p = predictions(labelled_bars(spark, sf))
    return settled(stacking.pivot_predictions(p, stacking.experts_and_targets(p)), _ROW)


ORACLE["prediction_pivot"] = f"WITH {PRED_SQL} SELECT symbol, period, time_idx, {settle_all(*_WIDE)} FROM pv"


@query
def version_consistency(spark, sf):
    return stacking.version_counts(predictions(labelled_bars(spark, sf)))


ORACLE["version_consistency"] = f"""WITH {PRED_SQL} SELECT 's1' AS schema_ver, 'd1' AS data_ver, 'e1' AS expert_ver, 'w1' AS train_window_id,
(SELECT count(x_mom) + count(x_rng) FROM lb) AS rows"""

_STACK = [*_WIDE, "realized_vol", "momentum_fast", "momentum_slow", "structural_gap", "volume_change"]


@query
def stacking_table(spark, sf):
    df = labelled_bars(spark, sf)
    out = stacking.stacking_table(predictions(df), df, ["target_up"])
    return settled(out, [*_ROW, "target_up"], _STACK)


ORACLE["stacking_table"] = f"""WITH {PRED_SQL}, rt AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM bars),
rg AS (SELECT symbol, period, timestamp, {full('stddev_samp(ret)', 'ret', 24)} AS realized_vol, close / lag(close, 24) OVER ({W}) - 1 AS momentum_fast,
close / lag(close, 72) OVER ({W}) - 1 AS momentum_slow, volume / lag(volume) OVER ({W}) - 1 AS volume_change,
(close - ({full('max(high)', 'high', 72)} + {full('min(low)', 'low', 72)}) / 2) / close AS structural_gap FROM rt)
SELECT symbol, period, time_idx, target_up, {settle_all(*_STACK)} FROM pv JOIN rg USING (symbol, period, timestamp)"""


def _parts(spark, sf, daily: DataFrame | None = None):
    df = labelled_bars(spark, sf, daily)
    p = predictions(df)
    wide = stacking.pivot_predictions(p, stacking.experts_and_targets(p))
    rows = staged(wide.join(df.select(*_ROW, "target_up"), _ROW), "stack")
    return splits.three_way_split(rows), stacking.stack_features(rows.columns)


PARTS_SQL = f"""{PRED_SQL}, u AS (SELECT DISTINCT time_idx FROM pv), un AS (SELECT count(*) AS n FROM u),
ui AS (SELECT time_idx, row_number() OVER (ORDER BY time_idx) - 1 AS i, n FROM u, un),
cut AS (SELECT max(time_idx) FILTER (WHERE i = floor(n * 0.6::DOUBLE) - 1) AS a, max(time_idx) FILTER (WHERE i = floor(n * 0.8::DOUBLE)) AS b FROM ui),
pt AS (SELECT pv.*, CASE WHEN time_idx <= a THEN 'train' WHEN time_idx <= b THEN 'val' ELSE 'test' END AS part FROM pv, cut)"""


@query
def equal_weight_baseline(spark, sf):
    rows, feats = _parts(spark, sf)
    return settled(stacking.equal_weight(rows, feats), [*_ROW, "part"], ["equal_weight"])


ORACLE["equal_weight_baseline"] = f"""WITH {PARTS_SQL}, e AS (SELECT *, least(greatest((coalesce(score__mom__target_up, 0) + coalesce(score__rng__target_up, 0))
/ ((score__mom__target_up IS NOT NULL)::INT + (score__rng__target_up IS NOT NULL)::INT), 1e-6), 1 - 1e-6) AS equal_weight FROM pt)
SELECT symbol, period, time_idx, part, {settle_sql('equal_weight')} FROM e"""


@query
def single_expert_scores(spark, sf):
    rows, feats = _parts(spark, sf)
    return settled(stacking.single_scores(rows.filter("part = 'val'"), feats, "target_up"), ["column"])


ORACLE["single_expert_scores"] = f"""WITH {PARTS_SQL}, vl AS (SELECT * FROM pt WHERE part = 'val'),
c1 AS (SELECT score__mom__target_up AS prob, target_up AS label FROM vl WHERE score__mom__target_up IS NOT NULL), c2 AS (SELECT score__rng__target_up AS prob, target_up AS label FROM vl WHERE score__rng__target_up IS NOT NULL),
{ap_sql([], 'c1', name='a')}, {ap_sql([], 'c2', name='z')}, both_ AS (SELECT 'score__mom__target_up' AS "column", pr_auc FROM a UNION ALL SELECT 'score__rng__target_up', pr_auc FROM z)
SELECT "column", {settle_sql('pr_auc', 'metric')} FROM both_"""


@query
def gated_blend(spark, sf):
    """Base and rich predictions blended by availability and a volume gate."""
    df = labelled_bars(spark, sf)
    rich = F.when(F.col("time_idx") % 3 > 0, F.col("x_rng"))
    out = df.select(*_ROW, metrics.gated_blend(F.col("x_mom"), rich, (F.col("time_idx") % 3 > 0).cast("int"), F.col("volume") / 50 - 1).alias("blend"))
    return settled(out, _ROW)


ORACLE["gated_blend"] = f"""WITH {PRED_SQL}, a AS (SELECT *, CASE WHEN time_idx % 3 > 0 THEN x_rng END AS rich, CASE WHEN time_idx % 3 > 0 THEN 1 ELSE 0 END / (1 + exp(-(volume / 50 - 1))) AS al FROM lb),
g AS (SELECT *, CASE WHEN rich IS NULL THEN x_mom ELSE (1 - al) * x_mom + al * rich END AS blend FROM a) SELECT symbol, period, time_idx, {settle_sql('blend')} FROM g"""


@query
def baseline_stack_report(spark, sf):
    """Test quality of the equal-weight and the best-single baseline."""
    rows, feats = _parts(spark, sf)
    test = stacking.equal_weight(rows.filter("part = 'test'"), feats)
    test = stacking.best_single(rows.filter("part = 'val'"), test, feats, "target_up")
    tall = test.select("target_up", "equal_weight", "best_single").unpivot(["target_up"], ["equal_weight", "best_single"], "model", "prob")
    out = metrics.average_precision(tall, ["model"], "prob", "target_up").join(
        metrics.expected_calibration_error(tall, ["model"], "prob", "target_up"), "model"
    )
    return settled(out, ["model"])


ORACLE["baseline_stack_report"] = f"""WITH {PARTS_SQL}, vl AS (SELECT * FROM pt WHERE part = 'val'),
c1 AS (SELECT score__mom__target_up AS prob, target_up AS label FROM vl), c2 AS (SELECT score__rng__target_up AS prob, target_up AS label FROM vl),
{ap_sql([], 'c1', name='a')}, {ap_sql([], 'c2', name='z')},
raw AS (SELECT 'equal_weight' AS model, (score__mom__target_up + score__rng__target_up) / 2 AS pb, target_up AS label FROM pt WHERE part = 'test'
UNION ALL SELECT 'best_single', CASE WHEN (SELECT pr_auc FROM a) >= (SELECT pr_auc FROM z) THEN score__mom__target_up ELSE score__rng__target_up END, target_up FROM pt WHERE part = 'test'),
ev AS (SELECT model, least(greatest(pb, 1e-6), 1 - 1e-6) AS prob, label FROM raw),
{ap_sql(['model'])}, {bins_sql(10, ('model',))}, t AS (SELECT model, count(*) AS a FROM ev GROUP BY 1),
e AS (SELECT model, sum(abs(confidence - accuracy) * n) / any_value(a) AS ece FROM cb JOIN t USING (model) GROUP BY 1)
SELECT model, {settle_all('pr_auc', 'ece')} FROM ap JOIN e USING (model)"""


@query
def target_standardisation(spark, sf):
    """Returns scaled by their group's training statistics, and scaled back."""
    from barloom.operators import scaling

    df = splits.ratio_split(bars(spark, sf, "1d").select(*KEY, "volume", (F.col("close") - F.col("open")).alias("target_move")))
    scaler = scaling.target_scaler(df.filter(~F.col("is_val")), ["target_move"])
    z = scaling.standardise(df, scaler, ["target_move"])
    back = scaling.destandardise(z, scaler, ["target_move"]).select(*KEY, F.col("target_move").alias("restored"))
    return settled(z.select(*KEY, F.col("target_move").alias("scaled")).join(back, KEY), KEY)


ORACLE["target_standardisation"] = f"""WITH {bars_sql('1d')}, n AS (SELECT *, close - open AS mv, row_number() OVER ({W}) - 1 < floor(count(*) OVER (PARTITION BY symbol, period) * 0.8::DOUBLE) AS tr FROM bars),
s AS (SELECT symbol, avg(mv) AS m, greatest(stddev_samp(mv), 1e-8) AS sd FROM n WHERE tr GROUP BY 1),
z AS (SELECT symbol, period, timestamp, (mv - m) / sd AS scaled, mv AS restored FROM n JOIN s USING (symbol)) SELECT symbol, period, timestamp, {settle_all('scaled', 'restored')} FROM z"""
