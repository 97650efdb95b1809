"""Near duplicates by shingle sets: pairs of known similarity, and the pipeline's stage against plain Python."""

import random
from itertools import combinations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from barloom.llm import shingles, simhash
from barloom.llm.shared import table

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_kept(rows):
    """The ids that the stage keeps of rows with unique ids."""
    sets, head = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in combinations(sorted(sets), 2):
        if similarity(sets[a], sets[b]) >= 0.8 and head[a] != head[b]:
            low, high = sorted((head[a], head[b]))
            head = {i: low if h == high else h for i, h in head.items()}
    return {i for i, h in head.items() if i == h}


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    return sorted((r.doc_id, r.text) for r in corpus_pipeline.keep_distinct(spark, docs, SF).collect())


@pytest.mark.parametrize("sizes", [(60, 400)])
def test_pairs_of_known_similarity(spark, sizes):
    rnd, rows, bands = random.Random(3), [], []
    for n in range(160):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(*sizes))]
        other = list(words)
        for _ in range(max(1, round(len(words) * rnd.choice((0.005, 0.015, 0.022, 0.03, 0.05))))):
            other[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
        bands.append(similarity(plain_set(rows[-2][1]), plain_set(rows[-1][1])))
    assert sum(0.8 <= s < 0.85 for s in bands) > 3 and sum(s < 0.8 for s in bands) > 3
    assert {i for i, _ in kept(spark, rows)} == {2 * n for n in range(160)} | {2 * n + 1 for n, s in enumerate(bands) if s < 0.8}


def test_stage_equals_plain_python(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, SF).select(F.col("doc_id")).collect()} == plain_kept(rows)


def test_chain_of_a_large_group(spark):
    """A group that hangs together through one text, while its other members are below the bound with each other."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for n in range(1, 40):
        other = list(base)
        for k in range(4):
            other[50 * k + rnd.randrange(5, 45)] = f"x{n}-{k}"
        rows.append((n, " ".join(other)))
    assert similarity(plain_set(rows[1][1]), plain_set(rows[2][1])) < 0.8
    assert {i for i, _ in kept(spark, rows)} == plain_kept(rows) == {0}


def test_a_row_goes_only_because_of_its_own_group(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    assert kept(spark, [(3, a), (5, a + " more"), (5, b)]) == [(3, a), (5, b)]


def test_simhash_links_alone_join_near_copies(spark, monkeypatch):
    """With no min-hash bucket left, SimHash still joins equal and near fingerprints, and the whole sets keep apart what is not alike."""
    rnd, asked = random.Random(7), []
    links, sketched = simhash.links, shingles._sketches

    def lonely(texts):
        return sketched(texts).withColumn("keys", F.array(F.xxhash64("name")))

    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(1) or links(*a, **k))
    monkeypatch.setattr(shingles, "_sketches", lonely)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(2000)]
    far = [f"w{rnd.randrange(10**6)}" for _ in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(["x", *base[1:]])), (4, " ".join(far)), (5, " ".join(far).upper())]
    assert {i for i, _ in kept(spark, rows)} == {1, 4}
    assert asked


def test_links_of_equal_fingerprints_are_checked_on_whole_sets(spark):
    """Texts of one fingerprint, two alike and one not: only the alike ones are linked."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(b"a", base), (b"b", base + " more"), (b"c", "quite another text of a few words")]
    texts = spark.createDataFrame(rows, "name binary, text string")
    nodes = shingles._sketches(texts).withColumns({"fp": F.lit(5).cast("long"), "node": F.when(F.col("name") == b"a", 0).when(F.col("name") == b"b", 1).otherwise(2).cast("long")})
    found = shingles.fingerprint_links(texts, shingles.staged(nodes, "nodes"))
    assert [tuple(r) for r in found.collect()] == [(1, 0)]
