import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import vptree


def brute(rows, k):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sound = list({(i, v.tobytes()): (i, v) for i, v in sound}.values())
    out = set()
    for q, v in sound:
        if q % 20 == 0:
            scores = sorted((-float(vptree.exact_products(v, w[None])[0]), i) for i, w in sound if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def data():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[rng.integers(6)] + 0.3 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)] + [(3000 + i, [0.5 * x for x in rows[7][1]]) for i in range(20)]
    rows += [(4000, None), (4020, [0.0] * 12), (4040, [float("nan")] * 12), (4060, [None] * 12), (4080, [1.0, 2.0]), (4081, [2.0, 1.0]), (4100, []), (None, [1.0] * 12), (4120, [float("inf")] * 12), rows[3], rows[20]]
    return rows


@pytest.mark.parametrize("shard,block", [(100_000, 100_000), (150, 16)])
def test_factor_one_is_exact(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vptree, "LEAF", 16)
    rows = data()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x")).withColumn("v", F.lit(1))
    found = {tuple(r) for r in vptree.nearest(frame, F.col("vec_id") % 20 == 0, shard=shard, block=block).collect()}
    assert found == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20)


def test_pruning_is_real_and_relaxes():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6000, 3))
    radius = float(np.linalg.norm(vectors, axis=1).max())
    tree, seen = vptree.Tree(np.arange(6000), vectors, radius, leaf=32), {}
    queries = vectors[:50]
    wanted = [set(np.lexsort((np.arange(6000), -(vectors @ q)))[:11].tolist()) - {i} for i, q in enumerate(queries)]
    for factor in (1.0, 0.5, 0.0):
        count = [0]
        plain = tree._leaf

        def counted(members, rows, *rest, plain=plain, count=count):
            count[0] += len(members) * len(rows)
            plain(members, rows, *rest)

        tree._leaf = counted
        row, found, _ = tree.search(np.arange(50), queries, np.full(50, -np.inf), 10, factor)
        tree._leaf = plain
        recall = np.mean([len(set(found[row == i].tolist()) & wanted[i]) / 10 for i in range(50)])
        seen[factor] = count[0], recall
    assert seen[1.0][1] == 1.0 and seen[1.0][0] < 0.9 * 50 * 6000
    assert seen[0.0][0] < seen[0.5][0] < seen[1.0][0] and seen[0.5][1] > 0.5


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vptree.nearest(frame, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 0, 0.0)]
    assert vptree.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
