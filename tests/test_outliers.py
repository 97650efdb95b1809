"""Outlier factors and narrowed quantiles against plain Python, with blocks and spans of a few rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import outliers, ranks

COLUMNS = "symbol string, period string, timestamp long, x double"


def plain_factors(values, k):
    """Factors from all distances; of equal ones the smaller value is nearer."""
    near = []
    for i, v in enumerate(values):
        others = sorted((abs(v - w), w, j) for j, w in enumerate(values) if j != i)[:k]
        near.append([(d, j) for d, _, j in others])
    far = [n[-1][0] for n in near]
    density = [1 / (sum(max(d, far[j]) for d, j in n) / k + 1e-10) for n in near]
    return [sum(density[j] for _, j in n) / k / density[i] for i, n in enumerate(near)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK_BITS", 3)
    monkeypatch.setattr(ranks, "FEW", 20)
    monkeypatch.setattr(ranks, "BINS", 8)


def series(rnd, kind, n):
    if kind == "ties":
        return [float(rnd.randrange(12)) for _ in range(n)]
    if kind == "even":
        return [float(i) for i in range(n)]
    if kind == "crowd":
        return [3.5] * (n // 2) + [rnd.randrange(400) / 64 for _ in range(n - n // 2)]
    if kind == "tiny":
        return [rnd.random() * 1e-12 for _ in range(n)]
    return [rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(-6, 9) * rnd.random() for _ in range(n)]


def test_factors_equal_plain_python(spark, small_blocks):
    rnd, rows, wanted = random.Random(9), [], {}
    for symbol, (kind, n) in {"a": ("ties", 90), "b": ("even", 70), "c": ("crowd", 80), "d": ("tiny", 60), "e": ("wide", 100), None: ("ties", 30), "short": ("even", 6)}.items():
        values = series(rnd, kind, n)
        rows += [(symbol, "1d", i, v) for i, v in enumerate(values)] + [(symbol, "1d", n, None)]
        scores = plain_factors(values, max(6, n // 10)) if n > 6 else [None] * n
        cut = np.percentile([-s for s in scores], 1) if n > 6 else None
        wanted |= {(symbol, i): (None, None) if s is None else (-s, int(-s < cut)) for i, s in enumerate(scores)}
        wanted[symbol, n] = (None, None)
    got = outliers.local_outliers(spark.createDataFrame(rows, COLUMNS), ["x"]).collect()
    assert len(got) == len(rows)
    for r in got:
        score, flag = wanted[r.symbol, r.timestamp]
        if score is None:
            assert r.lof_score_x is None and r.is_outlier_x is None
        else:
            assert r.lof_score_x == pytest.approx(score, rel=1e-9), (r, score)
            assert r.is_outlier_x == flag or abs(r.lof_score_x - score) < 1e-9


def test_empty_and_unknown(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert outliers.local_outliers(empty, ["x"]).count() == 0
    rows = spark.createDataFrame([("a", "1d", i, None) for i in range(9)], COLUMNS)
    assert {(r.lof_score_x, r.is_outlier_x) for r in outliers.local_outliers(rows, ["x"]).collect()} == {(None, None)}


@pytest.mark.parametrize("kind", ["ties", "even", "crowd", "tiny", "wide"])
def test_narrowed_quantiles(spark, small_blocks, kind):
    rnd, probs = random.Random(3), [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    sets = {g: series(rnd, kind, n) for g, n in (("a", 400), ("b", 57), (None, 33), ("one", 1))}
    extremes = [1.7e308, -1.7e308, 5e-324, 0.0, -0.0] if kind == "wide" else []
    sets["a"] = sets["a"] + extremes
    df = spark.createDataFrame([(g, v) for g, vs in sets.items() for v in [*vs, None]], "g string, v double")
    got = {r.g: list(r)[1:] for r in ranks.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert got.keys() == sets.keys()
    for g, vs in sets.items():
        order = sorted(vs)
        for p, q in zip(probs, got[g], strict=True):
            at = (len(order) - 1) * p
            lo = order[int(at)]
            assert q == pytest.approx(lo + (order[min(int(at) + 1, len(order) - 1)] - lo) * (at - int(at)), rel=1e-12, abs=1e-300)
    assert ranks.exact_quantiles(df.drop("g"), [], "v", [0.5]).count() == 1
    assert ranks.exact_quantiles(df.where(F.col("v").isNull()), ["g"], "v", [0.5]).count() == 0
