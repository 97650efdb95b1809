import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.shared import id_and_text


def plain_print(text):
    words = [w for w in text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_groups_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "One"), (10_004, "one two"), (10_005, "ÀÉ ONE\x0btwo\x1fthree four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    found = {r.doc_id: r for r in simhash.near_duplicates(id_and_text(docs)).collect()}
    prints = {i: plain_print(t or "") for i, t in rows}
    assert {i: r.fp & (1 << 64) - 1 for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == plain_components(prints)


def test_links_across_chunks_and_chains(spark, monkeypatch):
    """A bucket of many members is cut into cells, and chains of links still join."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints, value = {}, base
    for i in range(150):
        prints[i] = value
        for _ in range(rng.choice([1, 3, 3, 5])):
            value ^= 1 << rng.randrange(10)
    prints |= {200 + i: rng.getrandbits(64) for i in range(100)}
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in set(prints.values())], "fp long")
    groups = simhash.components(simhash.links(frame))
    of = {r.node & (1 << 64) - 1: r.component for r in groups.collect()}
    plain = plain_components(prints)
    for i in prints:
        for j in prints:
            a, b = prints[i], prints[j]
            assert (plain[i] == plain[j]) == (a == b or of.get(a, a) == of.get(b, b)), (i, j)


def test_counters_for_every_radius():
    rng = np.random.default_rng(0)
    left = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for radius in range(9):
        right = left.copy()
        for i in range(300):
            for b in rng.choice(64, rng.integers(0, 12), replace=False):
                right[i] ^= np.uint64(1) << np.uint64(b)
        (near,) = simhash.near_pairs(left, right, radius)
        assert near.tolist() == [i for i in range(300) if int(left[i] ^ right[i]).bit_count() <= radius]
        pairs = {(i + 0, j) for a, b in simhash.near_all(left[:70], right, radius) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        assert pairs == {(i, j) for i in range(70) for j in range(300) if int(left[i] ^ right[j]).bit_count() <= radius}


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(id_and_text(none)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(id_and_text(rows)).collect()) == [(-1, 4), (4, 4), (4, 4), (9, 9)]
