"""Registered queries beside their SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from check import canon

# one or two of each kind; tools/check.py runs them all
NAMES = [
    "feature_label_slice", "true_range", "macd_ppo", "labels_forward_windows", "leak_safe_fuse", "asof_purchase_view",
    "winsorised_z_by_symbol", "null_shape", "continuity_audit", "rolling_folds", "parallel_array_payloads",
    "information_coefficient", "unified_core", "average_precision", "stacking_table", "streamed_bars_once", "streamed_ema",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 140 and len(oracle) > 130


def test_entry(spark):
    assert entry.entry(spark).count() > 0
