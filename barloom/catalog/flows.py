"""Whole flows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog import evaluation
from barloom.catalog.fusing import ATTACHED_SQL
from barloom.catalog.indicators import W
from barloom.catalog.selection import matrix
from barloom.catalog.tables import bars, global_series, settled, symbol_series
from barloom.plans import fuse_experts, long_table, screening, stack
from barloom.sources import files
from barloom.sources.staging import staged

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def long_feature_table(spark, sf):
    """Daily bars to the complete labelled feature table."""
    table = long_table.long_table(bars(spark, sf, "1d"), "BUILDING", ["1d"])
    return settled(files.slim(table, ["rsi", "close_zn30", "mfi_zn30"]).drop("datetime"), ["symbol", "period", "timestamp", "time_idx"])


@query
def expert_views(spark, sf):
    """Rows per expert dataset under different series and null policies."""
    experts = {
        "price": {"symbol_columns": ["order_value"], "fundamentals_only": True},
        "macro": {"symbol_columns": [], "null_scope": "onchain"},
        "all": {"null_scope": "all_new"},
    }
    b = bars(spark, sf, "1d")
    out = None
    sym, glo = staged(symbol_series(spark, sf), "sym"), staged(global_series(spark, sf), "glo")
    for name, df in fuse_experts.expert_views(b, sym, glo, experts):
        cols = len(df.columns) - len(b.columns)
        one = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).withColumns({"expert": F.lit(name), "added": F.lit(cols)})
        out = one if out is None else out.unionByName(one)
    return out


_H = lambda c: f"last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}"
ORACLE["expert_views"] = f"""WITH {ATTACHED_SQL}, h AS (SELECT symbol, period, timestamp, {_H('order_value')}, {_H('order_count')}, {_H('avg_price')} FROM att)
SELECT symbol, count(*) AS rows, 'price' AS expert, 1 AS added FROM h GROUP BY 1
UNION ALL SELECT symbol, count(*) FILTER (WHERE avg_price IS NOT NULL), 'macro', 1 FROM h GROUP BY 1
UNION ALL SELECT symbol, count(*) FILTER (WHERE avg_price IS NOT NULL AND order_value IS NOT NULL AND order_count IS NOT NULL), 'all', 3 FROM h GROUP BY 1"""


@query
def feature_screening(spark, sf):
    """Vector features screened against one class label over one period."""
    df = matrix(spark, sf).withColumns({"symbol": F.lit("ALL"), "period": F.lit("1d"), "timestamp": F.col("vec_id") * 86_400_000})
    cols = [*[f"f{i}" for i in range(16)], "f_planted", "f_const", "f_copy_20"]
    s = screening.ScreeningSettings(topk=4, trees=10, repeats=1, rounds=1)
    out = screening.screen(df.select("symbol", "period", "timestamp", "vec_id", "target_binarytrend", *cols), cols, ["target_binarytrend"], ["vec_id"], ["f0"], s)
    return out["final"]


@query
def stack_report(spark, sf):
    df = evaluation.labelled_bars(spark, sf)
    return stack.run_stack(evaluation.predictions(df), df, "target_up")["report"]
