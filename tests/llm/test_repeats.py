import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import repeats
from barloom.llm.shared import id_and_text


def plain(rows):
    """Every string of 100 bytes of every text, in order, against a set."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            part = raw[i : i + 100]
            if part in seen:
                gone[i : i + 100] = True
            seen.add(part)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(b for b, g in zip(raw, gone.tolist(), strict=True) if not g)
        out.append((-1 if doc is None else doc, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("copy", F.lit("y"))
    got = repeats.remove_repeats(id_and_text(docs), **settings).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)


def cases():
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(400))
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randrange(0, 400)))
        for _ in range(rng.randrange(0, 4)):
            a = rng.randrange(0, 380)
            cut = passage[a : a + rng.randrange(60, 260)]
            at = rng.randrange(0, len(text) + 1)
            text = text[:at] + cut + text[at:]
        rows.append((i, text))
    rows += [(200 + i, rows[5][1]) for i in range(4)] + [(300, "a" * 1000), (301, "ab" * 300), (302, "a" * 110), (303, "x" + "a" * 99), (304, "abc " * 60), (305, None), (306, ""), (None, passage), (None, passage), (7, passage[:150]), (7, passage[:150]), (400, passage[:100]), (401, passage[:99])]
    rows += [(500 + i, passage[: 150 + i] + rows[i][1][::-1] + passage[i : 170 + i]) for i in range(30)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 8])
def test_removed_bytes_equal_brute_force(spark, hot):
    assert found(spark, cases(), hot=hot) == plain(cases())


def test_segments_and_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, cases(), segment=128, hot=50) == plain(cases())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
