import hashlib
import random

import pytest
from tokenizers import Tokenizer

from barloom.llm import bpe
from barloom.llm.shared import id_and_text

ODD = [
    None, "", " ", "  ", "\n", " \n", "\n ", "a", "a  b", " a\n\n b  \n", "it's we'll I'd  THEY'RE", "foo \n bar\t\tx", "x\x1cy \x1f z", " a  b", "naïve café 12³ ½ 三 语 🙂🙂", "  <|endoftext|>  b<|endoftext|>",
    "<|endoftext|", "a" * 5000, "ab" * 3000 + " " * 300 + "!", "\u0000\u0001 � é", "don't'd 'S", "\r\n\r\n  x", "<|endoftext|><|endoftext|> x", " a\u0085b",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_round_trip_equals_the_library(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(1)
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)]
    rows += [(20_000 + i, "".join(rng.choice("ab  \n\t.,'sd1²é 　🙂") for _ in range(200))) for i in range(100)] + [(None, "x"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(id_and_text(docs), size=500).collect())
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        wanted.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(wanted)


def test_encode_and_decode_are_inverse(spark):
    docs = id_and_text(spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_transducer_is_minimal_and_complete():
    rng = random.Random(5)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 7))): [rng.randrange(99) for _ in range(rng.randrange(1, 4))] for _ in range(300)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert [lexicon.number(w) for w in sorted(words)] == list(range(len(words)))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert all(lexicon.get(w) is None for w in (b"abcabcabc", b"d", b"\xff") if w not in words)
    followers = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(lexicon.finals) == len(followers)
    assert bpe.Lexicon(bpe.compile_lexicon({})).get(b"a") is None


def test_empty_table(spark):
    assert bpe.round_trip(id_and_text(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_marks_behind_a_known_word_are_not_merged_with_it_again(library):
    """A word that is followed by marks takes the word's ids from memory; the ids are the library's."""
    c = bpe.Codec(bpe.Vocabulary(bpe.vocabulary_path()))
    merged, real = [], c.vocabulary.merged
    c.vocabulary.merged = lambda p: merged.append(p) or real(p)
    text = "extraordinary extraordinary, (extraordinary) extraordinary). extraordinary... é! a. ... x's. it's, 12, naïveté; a1. \n."
    assert c.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert merged.count(b" extraordinary") == 1
