import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import bpe, pii, quality
from barloom.llm.shared import id_and_text, table
from tests.llm.test_shingles import plain_kept
from tests.llm.test_winnow import plain

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = table(spark, SF, "labels")
    stats = {i: quality.statistics(t or "") for i, t in docs.items()}
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in stats.items()], "doc_id long, x array<double>")
    model = quality.fit(rows, labels)
    kept = {i: docs[i] for i, x in stats.items() if model.score(np.array([x]))[0] >= 0.3}
    alone = plain_kept([(i, t or "") for i, t in kept.items()])
    kept = {i: t for i, t in kept.items() if i in alone}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    dirty = {r[0] for r in plain(list(kept.items()), items) if r[-1]}
    kept = {i: pii.mask_text(t) for i, t in kept.items() if i not in dirty}
    library, wanted = Tokenizer.from_file(bpe.vocabulary_path()), set()
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        wanted.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert 0 < len(wanted) < len(docs)
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == wanted


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stages_take_nulls_repeats_and_extra_columns(spark, stage):
    long = "several plain words that a reader might like, and then some more of them. " * 20
    rows = [(1, long, "en", None, 1), (1, long, "en", "s", 1), (None, long, None, "s", 1), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, "x@y.com " + long[::-1], "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_place", F.lit("x")).withColumn("place", F.lit("x")).withColumn("score", F.lit(1))
    assert stage(spark, docs.limit(0), SF).count() == 0
    if stage is not corpus_pipeline.keep_distinct:
        assert stage(spark, docs, SF).count() <= len(rows)
    else:
        found = stage(spark, docs, SF)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in found.collect()) == [(False, 1), (False, 2), (False, 4), (True, 0)]
    if stage is not corpus_pipeline.encode:
        assert docs.columns == stage(spark, docs, SF).columns


def test_clean_documents_stay(spark):
    """Labelled good documents that are neither copies nor contaminated nor hold personal data pass unchanged up to the encoder."""
    docs = table(spark, SF, "documents")
    good = table(spark, SF, "labels").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.keep_quality(spark, docs, SF).select("doc_id")
    assert good.join(docs, "doc_id", "left_semi").count() == good.join(kept, "doc_id", "left_semi").count()
    assert id_and_text(docs).count() == docs.count()
