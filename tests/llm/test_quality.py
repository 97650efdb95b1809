import zlib

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import quality
from barloom.llm.shared import id_and_text, table

SF = "/root/testdata/sf0.01"


def test_fit_and_scores_equal_plain_computation(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = {r.doc_id: r for r in quality.op4_quality_discriminant(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    out = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    learned = [[x[i] for i, q in marks.items() if q == c and i in texts and i not in out] for c in (0, 1)]
    overall = np.array(learned[0] + learned[1])
    centre, scale = overall.mean(axis=0), np.where(overall.std(axis=0) > 1e-9, overall.std(axis=0), 1)
    z = [(np.array(rows) - centre) / scale for rows in learned]
    own = [np.cov(rows.T, bias=True) for rows in z]
    pooled = sum(len(a) * b for a, b in zip(z, own, strict=True)) / len(overall)
    logs = []
    for rows, cov in zip(z, own, strict=True):
        cov = 0.8 * cov + 0.2 * pooled
        cov = 0.98 * cov + 0.02 * np.eye(len(cov)) * np.trace(cov) / len(cov)
        inverse, (_, log_det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        logs.append({i: np.log((len(rows) + 1) / (len(overall) + 2)) - log_det / 2 - ((v - centre) / scale - rows.mean(axis=0)) @ inverse @ ((v - centre) / scale - rows.mean(axis=0)) / 2 for i, v in x.items()})
    assert found.keys() == texts.keys()
    for i, r in found.items():
        assert r.held_out == (i in out) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        difference = np.clip(logs[0][i] - logs[1][i], -700, 700)
        assert abs(np.log(max(r.score, 1e-300) / max(1 - r.score, 1e-300)) + difference) < 1e-3 * max(1, abs(difference)) or abs(r.score - 1 / (1 + np.exp(difference))) < 1e-9
    held = [(r.predicted, marks[i]) for i, r in found.items() if i in out and i in marks]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_nulls_empty_and_missing_labels(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (2, "again"), (3, "x" * 300_000), (4, "\n\n"), (5, "été ！")]
    docs = id_and_text(spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("score", F.lit("s")))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score_documents(docs, none).collect()] == [0.5] * 7
    one = spark.createDataFrame([(1, 1), (1, 1), (3, None), (None, 0), (4, 7)], "doc_id long, quality int")
    scores = quality.score_documents(docs, one).collect()
    assert len(scores) == 7 and all(0 <= r.score <= 1 for r in scores)
    assert quality.score_documents(id_and_text(none.selectExpr("doc_id", "'' AS text")), one).count() == 0
