"""Token ids in wavelet matrix files, one per shard, written and read by Spark.

A shard holds consecutive documents in ascending doc_id order. Its file is a succinct matrix: one bit plane per bit of the ids, high
bit first, each plane sorted stably by the bit above, with counts of ones every BLOCK bits for rank; planes are compressed one by
one and opened when first used. The same file gives tokens by place, counts of an id in a range, and the places where it occurs.
The documents are put in order before they are encoded, so that only texts are shuffled, and a task writes a file whenever it has
gathered SHARD tokens, so its memory does not follow its input. Files are rows of a Parquet table: Spark's commit
protocol drops the output of lost tasks, on any storage.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.bpe import CACHE, LONGEST, MARKS, vocabulary_path
from barloom.llm.shared import id_and_text, schema, staged, table
from barloom.llm.stretches import cut, gathered, slices

SHARD = 1 << 21  # tokens after which a file is closed; only a single longer document makes a longer one
TEXT = 12 << 20  # bytes of text dealt to a partition
BLOCK = 512  # bits for each stored count of ones
SLICED = 1 << 23  # bytes of text encoded together
LINES = 1000  # stretches in a text that is handed to the library
END = 0


class WaveletMatrix:
    """A sequence of non-negative integers in bit planes.

    File: magic, number of values, number of planes, for each plane its zeros and its compressed length, and the length of the
    notes (JSON); then the notes and the planes. A plane is its packed bits, then the counts of ones before each block.
    """

    HEAD = "<4sQII"

    def __init__(self, image: bytes) -> None:
        magic, self.n, self.depth, noted = struct.unpack_from(self.HEAD, image)
        if magic != b"WVLT":
            raise ValueError("not a wavelet matrix file")
        at = struct.calcsize(self.HEAD)
        table_ = np.frombuffer(image, "<u8", 2 * self.depth, at).reshape(-1, 2)
        self.zeros, at = table_[:, 0].tolist(), at + 16 * self.depth
        self.notes, at = json.loads(image[at : at + noted]), at + noted
        ends = at + np.cumsum([0, *table_[:, 1].tolist()])
        self._packed = [image[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        self._planes: list[tuple[np.ndarray, np.ndarray] | None] = [None] * self.depth

    @classmethod
    def written(cls, values: np.ndarray, notes: dict, depth: int | None = None) -> bytes:
        """The file image of a sequence."""
        values = np.asarray(values)
        depth = depth or max(1, int(values.max(initial=0)).bit_length())
        values = values.astype(np.uint16 if depth <= 16 else np.uint32)
        packer, entries, planes = zstandard.ZstdCompressor(level=1), [], []
        for level in range(depth - 1, -1, -1):
            ones = (values & values.dtype.type(1 << level)) != 0
            bits = np.packbits(ones, bitorder="little")
            whole = np.zeros(-(-len(values) // BLOCK) * (BLOCK // 8), np.uint8)
            whole[: len(bits)] = bits
            counts = np.cumsum(np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64), dtype=np.uint64)
            counts = np.concatenate([np.zeros(1, np.uint64), counts])
            planes.append(packer.compress(whole.tobytes() + counts.astype("<u8").tobytes()))
            low = np.compress(~ones, values)
            entries.append((len(low), len(planes[-1])))
            values = np.concatenate([low, np.compress(ones, values)])
        noted = json.dumps(notes, separators=(",", ":")).encode()
        return struct.pack(cls.HEAD, b"WVLT", len(values), depth, len(noted)) + np.asarray(entries, "<u8").tobytes() + noted + b"".join(planes)

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a plane, as bytes, and the counts of ones before each block."""
        if self._planes[level] is None:
            raw = zstandard.ZstdDecompressor().decompress(self._packed[level])
            split = -(-self.n // BLOCK) * (BLOCK // 8)
            self._planes[level] = np.frombuffer(raw, np.uint8, split), np.frombuffer(raw, "<u8", offset=split)
        return self._planes[level]

    def bit(self, level: int, i: int) -> int:
        return int(self.plane(level)[0][i >> 3]) >> (i & 7) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        bits, counts = self.plane(level)
        block, rest = divmod(i, BLOCK)
        start = block * (BLOCK // 8)
        part = bits[start : start + (rest + 7) // 8]
        inside = int(np.bitwise_count(part).sum()) - (int(part[-1] >> (rest & 7)).bit_count() if rest & 7 else 0) if rest else 0
        return int(counts[block]) + inside

    def where(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of the given value in a plane."""
        bits, counts = self.plane(level)
        before = counts.astype(np.int64) if bit else np.arange(len(counts), dtype=np.int64) * BLOCK - counts.astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(bits[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.depth):
            bit = self.bit(level, i)
            before = self.ones(level, i)
            i = self.zeros[level] + before if bit else i - before
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        """Where a symbol's occurrences within [start, end) lie below the last plane."""
        if symbol < 0 or symbol >> self.depth:
            return 0, 0
        for level in range(self.depth):
            a, b = self.ones(level, start), self.ones(level, end)
            if symbol >> (self.depth - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, symbol: int, i: int) -> int:
        """How often a symbol occurs among the first i values."""
        start, end = self._range(symbol, 0, i)
        return end - start

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(symbol, start, self.n if end is None else end)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of a symbol."""
        start, end = self._range(symbol, 0, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.depth - 1, -1, -1):
            bit = symbol >> (self.depth - 1 - level) & 1
            i = self.where(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int, start: int = 0, end: int | None = None) -> list[int]:
        """All places of a symbol within [start, end)."""
        end = self.n if end is None else end
        first = self.rank(symbol, start)
        return [self.select(symbol, first + k) for k in range(self.count(symbol, start, end))]

    def values(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for level in range(self.depth - 1, -1, -1):
            ones = np.unpackbits(self.plane(level)[0], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~ones)] = out[: self.zeros[level]]
            above[np.flatnonzero(ones)] = out[self.zeros[level] :] | out.dtype.type(1 << (self.depth - 1 - level))
            out = above
        return out


class LibraryEncoder:
    """Encodes with the tokenizers library; stretches of text that no pre-token crosses are encoded once and remembered.

    What is remembered of a stretch is its ids as little-endian bytes; the last CACHE to twice as many are kept, save long ones. The
    texts of a slice are cut together, each distinct stretch is looked up once, and the ids are gathered for all its places. The
    library is asked for all new stretches of a slice at once, a line for each: a line break between two is always a token of its
    own. A text with a special token is a single stretch, and asked for alone.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line = self._alone("\n")
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was remembered before the last change
        self.depth = max(1, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts, one behind the other, and where each text's ids start (the last start is the end)."""
        words, numbers, starts = cut(texts, self.specials)
        known = self.stretches(words.to_numpy(zero_copy_only=False).tolist())
        raw, at = gathered(pa.array(known, pa.large_binary()), numbers)
        return np.frombuffer(raw, "<u4", int(at[-1]) // 4), at[starts] // 4

    def stretches(self, words: list[str]) -> list[bytes]:
        """The ids of stretches, or of texts with special tokens."""
        found = list(map(self.seen.get, words))
        if missing := {w: b"" for w, ids in zip(words, found, strict=True) if ids is None}:
            self._learn(missing)
            found = [missing[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found

    def _learn(self, new: dict[str, bytes]) -> None:
        """Find the ids of new stretches, and remember those of short ones. Letters are a pre-token, and marks behind them another."""
        seen, older = self.seen, self.older
        new.update((w, older[w]) for w in new.keys() & older.keys())
        rest = [w for w, ids in new.items() if not ids]
        held = [s for s in self.specials if s in "\n".join(rest)]
        single = [w for w in rest if w.isspace() or held and any(s in w for s in held)]
        new.update(zip(single, map(self._alone, single), strict=True))
        plain, cuts, cores, marks = [], [], [], []  # flat lists: nothing for the garbage collector to walk
        for word in rest:
            core = word.rstrip(MARKS)
            if new[word]:
                continue
            if len(core) < len(word) and core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):
                cuts.append(word)
                cores.append(core)
                marks.append(word[len(core) :])
            else:
                plain.append(word)
        parts = dict.fromkeys(p for some in (cores, marks) for p in some if p not in new and p not in seen and p not in older)
        ids = self._asked([*plain, *parts])
        new.update(zip(plain, ids, strict=False))
        parts = dict(zip(parts, ids[len(plain) :], strict=True))
        first, second = ([parts.get(p) or new.get(p) or seen.get(p) or older[p] for p in some] for some in (cores, marks))
        new.update(zip(cuts, map(add, first, second), strict=True))
        if len(seen) >= CACHE:
            self.seen, self.older = {}, seen
        for found in (new, parts):
            self.seen.update(found)
            for word in [w for w in found if len(w) > LONGEST]:
                del self.seen[word]

    def _alone(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _asked(self, parts: list[str]) -> list[bytes]:
        """The ids of stretches that are not white space."""
        lines = ["\n".join([*parts[i : i + LINES], ""]) for i in range(0, len(parts), LINES)]
        found = self.library.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(x.ids, "<u4") for x in found)])
        ends = np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0]) * 4
        raw, starts = ids.tobytes(), [0, *(ends + 4).tolist()]
        return [raw[a:b] for a, b in zip(starts[:-1], ends.tolist(), strict=True)]


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Rows (doc_id, text) to a written table of files (part, seq, n_docs, n_tokens, image), in ascending doc_id order.

    part and seq order the files. Null doc_ids come first; repeated ones follow each other by text. Each document's ids end with end.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ordered = docs.repartitionByRange(max(1, -(-size // TEXT)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or vocabulary_path())
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        total = seq = part = 0

        def file() -> pa.RecordBatch:
            image = WaveletMatrix.written(np.concatenate(ids), {"docs": names, "lengths": [len(x) for x in ids]}, encode.depth)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(names)]), pa.array([total]), pa.array([image], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "n_docs", "n_tokens", "image"])

        for batch in slices(batches, SLICED):
            part = batch.column("part")[0].as_py()
            found, starts = encode.encode_all(batch.column("text"))
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), np.split(found, starts[1:-1]), strict=True):
                ids.append(np.append(tokens, np.uint32(end)))
                names.append(doc)
                total += len(ids[-1])
                if total >= SHARD:
                    yield file()
                    ids, names, total, seq = [], [], 0, seq + 1
        if ids:
            yield file()

    return staged(ordered.mapInArrow(run, schema(part="int", seq="int", n_docs="bigint", n_tokens="bigint", image="binary")), "wavelet")


def read_shards(files: DataFrame) -> DataFrame:
    """Written files to a row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Where a file starts comes from the token counts of the files before it: sums per part first, then within each part.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    within = files.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("local"))
    starts = staged(within.join(before, "part").select("part", "seq", (F.col("base") + F.col("local")).alias("first")), "starts")  # of known size: images are not shuffled

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, image in zip(frame["first"], frame["image"], strict=True):
                matrix = WaveletMatrix(image)
                values, lengths = matrix.values().astype("<u4"), matrix.notes["lengths"]
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(values[e - n : e].tobytes()) for n, e in zip(lengths, ends.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(matrix.notes["docs"], "Int64"), "start": ends - lengths + first, "n_tokens": lengths, "ids_crc32": crcs})

    rows = files.select("part", "seq", "image").join(starts, ["part", "seq"]).select("first", "image")
    return rows.mapInPandas(run, schema(doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint"))


def op10_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(id_and_text(table(spark, sf_dir, "documents"))))
