import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barloom.llm import bpe, wavelet
from barloom.llm.shared import id_and_text


@pytest.mark.parametrize("n,top", [(0, 1), (1, 2), (513, 9), (3000, 300), (4096, 70000)])
def test_matrix_equals_a_list(n, top):
    rng = np.random.default_rng(n)
    values = np.minimum(rng.integers(0, top, n), rng.integers(0, top, n)).astype(np.uint32)
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.written(values, {"x": [1, None]}))
    assert m.notes == {"x": [1, None]} and m.values().tolist() == values.tolist()
    for i in rng.integers(0, n, 50) if n else []:
        i = int(i)
        assert m.access(i) == values[i]
        s = int(values[i])
        assert m.rank(s, i) == (values[:i] == s).sum()
        assert m.select(s, m.rank(s, i)) == i
        assert m.occurrences(s, 5, i) == [j for j in np.flatnonzero(values == s).tolist() if 5 <= j < i]
    assert m.count(top + 5) == 0 and m.count(1 << 20) == 0
    with pytest.raises(IndexError):
        m.select(top + 5, 0)


def test_files_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "TEXT", 100_000)
    monkeypatch.setattr(wavelet, "SHARD", 9_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-5, None), (-4, "!! a  <|endoftext|> b"), (7, "repeated id"), (None, "no id"), (900_000, "x" * 3000 + "  \n y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = wavelet.write_shards(id_and_text(docs))
    assert files.count() > files.select("part").distinct().count() > 2
    found = [tuple(r) for r in wavelet.read_shards(files).collect()]
    library, wanted, start = Tokenizer.from_file(bpe.vocabulary_path()), [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        wanted.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == wanted


def test_empty_table(spark):
    assert wavelet.read_shards(wavelet.write_shards(id_and_text(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def test_texts_encoded_together_have_the_library_s_ids_and_ask_it_once_a_stretch():
    e = wavelet.LibraryEncoder(bpe.vocabulary_path())
    asked, real = [], e._asked
    e._asked = lambda parts: asked.extend(parts) or real(parts)
    words = [f" {a}{b}{c}" for a in ("re", "Über", "x1", "'") for b in ("tion", "ß", "", "12") for c in ("", ",", "...", "'s", "\n", "  ", "　")]
    plain = ["".join(words[i % 7 :: 1 + i % 5]) for i in range(60)] + [None, "", " ", "\n x", "é \n  y ", "<|endoftext|"]
    special = ["a  <|endoftext|> b\n", "<|endoftext|>", " <|endoftext|><|endoftext|>"]
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for texts in (plain, special + plain, []):
        ids, starts = e.encode_all(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) > 50
