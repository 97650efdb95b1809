import inspect
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing
from barloom.llm.shared import table

COLUMNS = "doc_id long, source string, text string"


def plain_targets(sizes):
    """Targets by source (None last), from words by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, whole = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        level = (whole - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, found):
    """What any mix has to satisfy."""
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += size(text)
    targets = plain_targets(sizes)
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((i, s, size(t)) for i, s, t in rows)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-12)
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for source, target in targets.items():  # no single copy more or less comes nearer
        gap = round(target) - taken[source]
        assert not any(r.source == source and 0 < r.size < 2 * abs(gap) - 1 and (r.copies < 2 if gap > 0 else r.copies > 0) for r in found), (source, gap)


def found(spark, rows):
    frame = spark.createDataFrame(rows, COLUMNS)
    for name in ("size", "place", "known", "n", "target", "_copies", "mark"):
        frame = frame.withColumn(name, F.lit("x"))
    return mixing.mixed(frame).collect()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BITS", 3)
    monkeypatch.setattr(mixing, "BUCKET", 4)


def test_sources_of_all_kinds(spark, small_blocks):
    """Copies by the hundred, one giant, empty sources, null and look-alike names, nulls and repeated rows."""
    rnd, rows = random.Random(2), []
    words = lambda n: " ".join(["w"] * n)
    for i in range(600):
        rows.append((i, rnd.choice(["a", "a", "a", "b", "c", "é", "Z", "🙂", "￮", None]), words(rnd.choice([0, 1, 7, 30, rnd.randrange(1, 400)]))))
    rows += [(1000 + i, "hot", words(40)) for i in range(300)] + [(2000, "giant", words(5000)), (2001, "giant", words(3))]
    rows += [(3000, "none", None), (3001, "none", " \n"), (None, "a", words(9)), (5, "b", "x y"), (5, "b", "x y"), (5, "b", "z")]
    result = found(spark, rows)
    check(rows, result)
    again = found(spark, rows[::-1])
    assert Counter(map(tuple, result)) == Counter(map(tuple, again))


def test_rates_are_tilted_by_size(spark):
    """Between sizes the rates follow exp(theta * size), capped: one theta explains a source's classes."""
    rnd = random.Random(4)
    rows = [(i, "s", " ".join(["w"] * (20 + 10 * rnd.randrange(8)))) for i in range(4000)] + [(9000 + i, "t", "a b c d e f g h") for i in range(40_000)]
    result = found(spark, rows)
    check(rows, result)
    copies, many = Counter(), Counter()
    for r in result:
        if r.source == "s":
            copies[r.size] += r.copies
            many[r.size] += 1
    rates = {n: copies[n] / many[n] for n in many}
    tilted = {n: math.log(x) / n for n, x in rates.items() if 0 < x < 1.98}
    assert rates and (len(tilted) < 2 or max(tilted.values()) - min(tilted.values()) < 0.01 + 0.1 * abs(max(tilted.values())))


def test_empty_tables(spark):
    assert found(spark, []) == []
    rows = [(1, "a", None), (2, None, " ")]
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in found(spark, rows)} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    check(rows, mixing.mixed(docs).collect())
    query = mixing.op13_entropy_mixing(spark, sf)
    assert query.columns == ["doc_id", "size", "source_size", "target", "taken"] and query.count() == len(rows)


def test_only_dataframe_functions():
    source = inspect.getsource(mixing)
    assert not re.search(r"udf|InPandas|InArrow|\.rdd\b|import pandas|import numpy|toPandas", source)
