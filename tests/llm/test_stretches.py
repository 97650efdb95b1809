import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barloom.llm import bpe, stretches

WHITE = " \t\n\r\x0b\x85\xa0\u1680\u2000\u200a\u2028\u202f\u205f\u3000"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def odd_texts() -> list[str | None]:
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  .'é“â \x1c三🙂\x00" + WHITE) for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    return [*texts, None, "", " ", "\n ", " 　", "\xa0x", "a\u0085", "​", "‧x"]


def test_cuts_are_those_of_the_pattern():
    """All texts of a batch are cut at once, and each distinct stretch is handed out once."""
    texts = odd_texts()
    for given in (pa.array(texts), pa.array(["head  ", *texts, "tail"]).slice(1, len(texts)), pa.array(texts, pa.large_string()), pa.array([None, ""]), pa.array([], pa.string())):
        words, numbers, starts = stretches.cut(given)
        words = words.to_pylist()
        assert len(set(words)) == len(words)
        found = [[words[n] for n in numbers[a:b]] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        assert found == [bpe.STRETCH.findall(t or "") for t in given.to_pylist()]


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(stretches, "SLICE", 50)
    texts = [*odd_texts()[:200], "x" * 500, "y", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(stretches.slices([batch, batch.slice(0, 0), batch.slice(7, 1)]))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == [*range(len(texts)), 7]
    assert len(parts) > 20


def test_encoded_batches_equal_the_library_and_learn_each_pretoken_once(library):
    c = bpe.Codec(bpe.Vocabulary(bpe.vocabulary_path()))
    merged, real = [], c.vocabulary.merged_all
    c.vocabulary.merged_all = lambda p: merged.extend(p) or real(p)
    rng = random.Random(4)
    words = [" " * rng.randrange(2) + "".join(rng.choice("thenraoiégß") for _ in range(rng.randrange(1, 14))) + rng.choice(["", "", ".", ",!", "'s", "12"]) for _ in range(3000)]
    plain = [*odd_texts(), *(" ".join(rng.choices(words, k=60)) for _ in range(300)), "<|endoftext|", "a" * 3000]
    for texts in (plain, plain, ["  <|endoftext|>  b<|endoftext|>", "<|endoftext|>", "  new<|endoftext|> ", " \n", *plain]):
        ids, starts = c.encode_all(pa.array(texts))
        for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids
        short = [p for p in merged if len(p) <= bpe.LONGEST]
        assert len(short) == len(set(short)) > 2000


def test_pretokens_that_merge_side_by_side_have_the_ids_of_one_alone(monkeypatch):
    vocabulary, rng = bpe.Vocabulary(bpe.vocabulary_path()), random.Random(6)
    pretokens = ["".join(rng.choice("theinraos é!") for _ in range(rng.randrange(1, 30))).encode() for _ in range(4000)] + [b"the" * 60, b"aaaa" * 10]
    monkeypatch.setattr(bpe, "ALIKE", 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.merged_all(pretokens)] == [vocabulary.merged(p) for p in pretokens]
    assert vocabulary.merged_all([]) == []


def test_words_step_through_the_transducer_together():
    rng = random.Random(7)
    words = {bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(1, 7))): [rng.randrange(99)] for _ in range(200)}
    asked = [*words, b"", b"abababab", b"zz", b"\xff\xff\xff\xff", b"a"]
    for known in (words, {}):
        lexicon = bpe.Lexicon(bpe.compile_lexicon(known))
        assert lexicon.numbers(asked).tolist() == [lexicon.number(w) for w in asked]
        assert lexicon.numbers([]).tolist() == []
