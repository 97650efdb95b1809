import hashlib
import random
import re

import pytest

from barloom.llm import winnow
from barloom.llm.shared import id_and_text, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items):
    """Every window of every item, looked for everywhere."""
    windows = {}
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add(str(item) if item is not None else "")
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in rows:
        words, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        out.append((-1 if doc is None else doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def cases():
    rng = random.Random(7)
    vocabulary = ["ab", "Cd", "é", "x1", "zz"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 15, 30])))) for i in range(40)]
    items += [(100, "one-two THREE"), (101, None), (102, ""), (103, "solo"), (104, "solo"), (104, "solo again"), (None, "nothing but this one"), (105, "same " * 25)]
    docs = []
    for i in range(80):
        a, b = rng.choice(items)[1] or "", rng.choice(items)[1] or ""
        cut = rng.randrange(0, 60)
        docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(20)) + ", " + a[cut : cut + rng.randrange(20, 90)].upper() + "!\n" + b + " ".join(rng.choice(vocabulary) for _ in range(30))))
    docs += [(500, None), (501, ""), (502, "One two\tthree and solo again"), (503, "same " * 400), (504, "this is Nothing; but this, one"), (None, items[0][1]), (1, "repeated row"), (505, "x" * 200_000 + " solo")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_hits_equal_brute_force(spark, block):
    docs, items = cases()
    found = winnow.summary(winnow.find_contamination(id_and_text(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id string, text string"), block=block))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == plain(docs, items)


def test_whole_tables_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    found = [tuple(r) for r in winnow.op7_winnowing_decontamination(spark, sf).collect()]
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert sorted(found) == plain(docs, items) and sum(r[-1] for r in found) > 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id string, text string")
    assert winnow.find_contamination(none, items).count() == 0
    (row,) = winnow.summary(winnow.find_contamination(id_and_text(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")), items)).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
