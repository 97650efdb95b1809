import random
import re
from collections import Counter, defaultdict

import pytest

from barloom.llm import divergence

COLUMNS = "doc_id long, lang string, source string, text string"


def plain(rows, least_docs=10, ranks=10):
    """The contract in plain Python, over rows (lang, source, text)."""
    found, docs, out = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        found[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        groups = {s: [c[t] for t in kept] for (l, s), c in found.items() if l == lang}
        p = {s: [1 + 10**9 * (n + 2) // (sum(c) + 2 * len(kept)) for n in c] for s, c in groups.items()}
        whole = [sum(c[i] for c in groups.values()) for i in range(len(kept))]
        q = [1 + 10**9 * (n + 2) // (sum(whole) + 2 * len(kept)) for n in whole]
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(map(f, p[s], p[t])), t.encode(), t) for t in groups if t != s]
            terms = [(-f(a, b), t.encode(), t) for a, b, t, n in zip(p[s], q, kept, groups[s], strict=True) if n and a > b]
            out |= {(lang, s, "pair", t, -v, i) for i, (v, _, t) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:ranks], 1)}
    return out


def found(spark, rows, **how):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)
    for name in ("n", "term", "value", "block", "_salt", "total"):
        frame = frame.withColumn(name, frame["doc_id"])
    result = [tuple(r) for r in divergence.source_divergence(frame, **how).collect()]
    assert len(result) == len(set(result))
    return set(result)


@pytest.mark.parametrize("block, tile", [(4096, 64), (8, 2)])
def test_equals_plain_python(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", 30)
    rnd = random.Random(7)
    words = [*(f"w{chr(97 + i)}" for i in range(26)), "Été", "日本", "ß", "🙂x", "ab"]
    rows = []
    for _ in range(220):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["s0", "s0", "s0", *"abcdeé🙂", None])
        many = rnd.choice([0, 1, 5, 40])
        rows.append((lang, source, " ".join(rnd.choice(words[: rnd.choice([3, 12, 31])]) for _ in range(many)) or rnd.choice([None, "", "12 3!"])))
    rows += [("xx", "only", "rare words"), ("xx", "other", None), ("yy", "alone", None), *[("en", "s0", "copied copied text")] * 12]
    assert found(spark, rows, least_docs=4, ranks=5) == plain(rows, 4, 5)


def test_ties_of_one_value_expand_in_utf8_order(spark):
    """A source with hundreds of terms of one cell: the first ten by bytes, not by code unit."""
    names = [chr(0x4E00 + i) * 2 for i in range(300)] + ["\U0001f600" * 2, "￮" * 2]
    rows = [("en", "a", " ".join(names))] * 10 + [("en", "b", "other")] * 10
    assert found(spark, rows) == plain(rows)


def test_long_text_and_empty_table(spark):
    rows = [("en", "a", "Long tale " * 200_000)] + [("en", "b", "long short")] * 10
    assert found(spark, rows) == plain(rows)
    frame = spark.createDataFrame([], COLUMNS)
    assert divergence.source_divergence(frame).count() == 0


def test_shares_are_exact(spark):
    """Counts far beyond those of the tables, where a product with 10^9 would leave a long."""
    import numpy as np
    from pyspark.sql import functions as F

    cases = [(n, v, total) for total in (0, 1, 17, 10**9 + 7, 4 * 10**15) for v in (1, 3, 10**9) for n in (0, total // 3, total)]
    wanted = [1 + 10**9 * (n + 2) // (total + 2 * v) for n, v, total in cases]
    assert [int(divergence.shares(np.array([n]), v, total)[0]) for n, v, total in cases] == wanted
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, n long, v long, total long")
    rows = frame.select("i", divergence.share(F.col("n"), F.col("v"), F.col("total")).alias("p")).collect()
    assert [p for _, p in sorted(map(tuple, rows))] == wanted
