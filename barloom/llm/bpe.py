"""Byte-level BPE with a lexicon of frequent words compiled into a minimal acyclic transducer.

A text is cut at special tokens and then into stretches of one leading space and no other white space, which no
pre-token crosses. Stretches that are frequent in the corpus are compiled, on the driver and up to a stated number, into
an automaton that shares prefixes and suffixes; weights on its transitions add up to a word's number, and the number
leads to the ids. Tasks map the file into memory. All other stretches are cut into pre-tokens and merged exactly, by rank; those
of one length merge side by side. Each distinct stretch of a slice of texts is looked up once; ids, their digits and their bytes
are gathered for all its places together.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import id_and_text, schema, share_file, staged, table
from barloom.llm.stretches import cut, gathered, slices

LEXICON = 1 << 16  # words compiled at most; all others are merged, so the bound changes no result
HEAPED, NEVER = 100, 1 << 60  # bytes beyond which merges are kept in a heap; the rank of a pair that never merges
CACHE, LONGEST = 400_000, 64  # stretches a worker remembers, and code points of the longest one
COUNTED = 1 << 23  # bytes of text after which a task hands on its counts
ALIKE = 32  # pre-tokens of one length from which they merge side by side

#: The pre-token pattern of the vocabulary file's kind, and Unicode's white space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks that are neither letters, digits, white space nor an apostrophe
LETTERS = [bytes([b]) for b in range(256)]
STRETCH = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def vocabulary_path() -> str:
    """The default vocabulary file, looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        ids, letters = given["model"]["vocab"], byte_letters()
        values = {letter: b for b, letter in enumerate(letters)}
        self.first = [ids[letter] for letter in letters]
        self.specials = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.specials.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(values[c] for c in token)
        for content, i in self.specials.items():
            self.bytes[i] = content.encode()
        self.merges: dict[tuple[int, int], int] = {}  # pair to rank and new id, as one number
        for rank, pair in enumerate(given["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), rank << 24 | ids[a + b])
        pairs = sorted((a << 32 | b, found) for (a, b), found in self.merges.items())
        self.pairs, self.found = np.array([*pairs, (NEVER, NEVER)], np.int64).T.copy()  # the same in order; the last is no pair
        self.pretoken = regex.compile(PRETOKEN)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def merged(self, pretoken: bytes) -> list[int]:
        """The ids of one pre-token: the pair of least rank merges first, the leftmost among equals."""
        if len(pretoken) > HEAPED:
            return self._heap_merged(pretoken)
        ids, merges = [self.first[b] for b in pretoken], self.merges
        ranks = [merges.get(pair, NEVER) for pair in zip(ids, ids[1:], strict=False)]  # of each id with the next
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), NEVER)
        return ids

    def merged_all(self, pretokens: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens, each as little-endian bytes."""
        out, lengths = [b""] * len(pretokens), {}
        for i, pretoken in enumerate(pretokens):
            lengths.setdefault(len(pretoken), []).append(i)
        for length, places in lengths.items():
            if length > HEAPED or len(places) < ALIKE:
                for i in places:
                    ids = self.merged(pretokens[i])
                    out[i] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                raw = np.frombuffer(b"".join([pretokens[i] for i in places]), np.uint8).reshape(-1, length)
                self._merged_alike(np.array(self.first, np.int64)[raw], np.array(places), out)
        return out

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and new id of pairs, as one number."""
        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.found[at], NEVER)

    def _merged_alike(self, ids: np.ndarray, places: np.ndarray, out: list[bytes]) -> None:
        """Merge a row for each pre-token; rows that still merge lose one id a round, so they stay equally long."""
        ranks = self._ranked(ids[:, :-1], ids[:, 1:])
        while len(ids):
            n, length = ids.shape
            at = ranks.argmin(axis=1) if length > 1 else np.zeros(n, np.int64)
            best = ranks[np.arange(n), at] if length > 1 else np.full(n, NEVER)
            done = best == NEVER
            raw, step = ids[done].astype("<u4").tobytes(), 4 * length
            for k, i in enumerate(places[done].tolist()):
                out[i] = raw[k * step : (k + 1) * step]
            going = ~done
            ids, ranks, places, at, best = ids[going], ranks[going], places[going], at[going], best[going]
            columns, rows = np.arange(length - 1), np.arange(len(ids))
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), 1)
            ids[rows, at] = best & 0xFFFFFF
            r = rows[at > 0]
            ranks[r, at[r] - 1] = self._ranked(ids[r, at[r] - 1], ids[r, at[r]])
            r = rows[at < length - 2]
            ranks[r, at[r]] = self._ranked(ids[r, at[r]], ids[r, at[r] + 1])

    def _heap_merged(self, pretoken: bytes) -> list[int]:
        """The same for a long pre-token, in time that hardly grows faster than its length."""
        ids = [self.first[b] for b in pretoken]
        end, merges = len(ids), self.merges
        if end == 1:
            return ids
        left, right = list(range(-1, end - 1)), list(range(1, end + 1))
        heap = [(found, i, ids[i], ids[i + 1]) for i in range(end - 1) if (found := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j, new = right[i], found & 0xFFFFFF
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < end:
                left[k] = i
                if (found := merges.get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (found, i, new, ids[k]))
            if (h := left[i]) >= 0 and (found := merges.get((ids[h], new))) is not None:
                heapq.heappush(heap, (found, h, ids[h], new))
        return [i for i in ids if i >= 0]

    def parts(self, stretch: str) -> Sequence[str]:
        """The pre-tokens of a stretch. Letters are a single one, and marks behind them another."""
        if stretch[1:].isalpha() and (stretch[0] == " " or stretch[0].isalpha()) or len(stretch) == 1:
            return (stretch,)
        core = stretch.rstrip(MARKS)
        if len(core) < len(stretch) and (core[1:].isalpha() and (core[0] == " " or core[0].isalpha()) or len(core) == 1 and core.isalpha()):
            return core, stretch[len(core) :]
        return self.pretoken.findall(stretch)

    def exact(self, stretch: str) -> list[int]:
        return [i for part in self.parts(stretch) for i in self.merged(part.encode())]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The file image of a minimal acyclic transducer from words to id sequences.

    Words are added in order; a state is shared as soon as no later word can change it. A transition's weight is the number
    of words that come before those behind it, so the weights along a word add up to its place in the order.
    """
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # final, [(label, target)], targets before sources
    size: list[int] = []  # words accepted from a state

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append((node[0], node[1]))
            size.append(node[0] + sum(size[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word
    last = b""
    for word in ordered:
        common = len(os.path.commonprefix([last, word]))
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(node)))
    root = settle(path[0])

    offsets, labels, targets, weights = [0], bytearray(), [], []
    for final, arcs in states:
        before = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            weights.append(before)
            before += size[target]
        offsets.append(len(labels))
    starts = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered], dtype=np.int64)]) if ordered else np.zeros(1)
    flat = [i for w in ordered for i in words[w]]
    finals = bytes(final for final, _ in states)
    parts = [np.asarray(x, "<u4").tobytes() for x in (offsets, targets, weights, starts, flat)] + [bytes(labels), finals]
    return struct.pack("<4sI7Q", b"MATL", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled transducer, read in place."""

    def __init__(self, image: bytes | mmap.mmap) -> None:
        magic, self.root, *lengths = struct.unpack_from("<4sI7Q", image)
        if magic != b"MATL":
            raise ValueError("not a lexicon file")
        view, at, parts = memoryview(image), struct.calcsize("<4sI7Q"), []
        for n in lengths:
            parts.append(view[at : at + n])
            at += n
        self.offsets, self.targets, self.weights, self.starts, self.ids = (p.cast("I") for p in parts[:5])
        self.labels, self.finals = bytes(parts[5]), parts[6]
        offsets, self.target, self.weight = (np.frombuffer(p, "<u4").astype(np.int64) for p in parts[:3])
        source = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.arcs = np.append(source << 8 | np.frombuffer(parts[5], np.uint8), NEVER)  # ascending, as labels of a state are
        self.final = np.frombuffer(parts[6], bool)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def number(self, word: bytes) -> int:
        """The place of a word in the order of all words, or -1."""
        state, total, find, offsets, targets, weights = self.root, 0, self.labels.find, self.offsets, self.targets, self.weights
        for byte in word:
            arc = find(LETTERS[byte], offsets[state], offsets[state + 1])
            if arc < 0:
                return -1
            total += weights[arc]
            state = targets[arc]
        return total if self.finals[state] else -1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The same for many words, which step through the states together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts, raw = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), np.uint8)
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        going, step, out = np.arange(len(words)), 0, np.full(len(words), -1, np.int64)
        while len(going):
            ended = going[sizes[going] == step]
            final = ended[self.final[state[ended]]]
            out[final] = total[final]
            going = going[sizes[going] > step]
            key = state[going] << 8 | raw[starts[going] + step]
            arc = np.searchsorted(self.arcs, key)
            known = self.arcs[arc] == key
            going, arc, step = going[known], arc[known], step + 1
            total[going] += self.weight[arc]
            state[going] = self.target[arc]
        return out

    def image(self, n: int) -> bytes:
        """The ids of the n-th word, as they are in the file."""
        return self.ids[self.starts[n] : self.starts[n + 1]].tobytes()

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None."""
        n = self.number(word)
        return None if n < 0 else self.ids[self.starts[n] : self.starts[n + 1]].tolist()


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.specials = list(vocabulary.specials)
        self.seen: dict[str, bytes] = {}  # ids of a stretch, as little-endian bytes
        self.older: dict[str, bytes] = {}  # what was remembered before the last change
        self.names = pa.array([f"{i}," for i in range(len(vocabulary.bytes))], pa.large_binary())
        self.bytes = pa.array(vocabulary.bytes, pa.large_binary())

    def stretches(self, words: list[str]) -> list[bytes]:
        """The ids of stretches, or of texts with special tokens."""
        found = list(map(self.seen.get, words))
        if missing := {w: b"" for w, ids in zip(words, found, strict=True) if ids is None}:
            self._learn(missing)
            found = [missing[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found

    def _learn(self, new: dict[str, bytes]) -> None:
        """Find the ids of new stretches, and remember those of short ones and of their pre-tokens."""
        seen, older, parts_of = self.seen, self.older, self.vocabulary.parts
        new.update((w, older[w]) for w in new.keys() & older.keys())
        rest = [w for w, ids in new.items() if not ids]
        if held := [s for s in self.specials if s in "\n".join(rest)]:
            new.update((w, np.array(self.encode(w), "<u4").tobytes()) for w in rest if any(s in w for s in held))
            rest = [w for w in rest if not new[w]]
        if self.lexicon:
            numbers = self.lexicon.numbers([w.encode() for w in rest])
            new.update((rest[i], self.lexicon.image(numbers[i])) for i in np.flatnonzero(numbers >= 0).tolist())
            rest = [rest[i] for i in np.flatnonzero(numbers < 0).tolist()]
        cuts, parts = [], {}  # parts: ids of pre-tokens that are not remembered
        for word in rest:
            cut_up = parts_of(word)
            if len(cut_up) == 1:
                parts[word] = b""
            else:
                cuts.append((word, cut_up))
        parts.update((p, b"") for _, cut_up in cuts for p in cut_up if p not in seen and p not in older)
        parts = dict(zip(parts, self.vocabulary.merged_all([p.encode() for p in parts]), strict=True))
        new.update((w, parts[w]) for w in rest if w in parts)
        new.update((w, b"".join([parts.get(p) or seen.get(p) or older[p] for p in cut_up])) for w, cut_up in cuts)
        if len(seen) >= CACHE:
            self.seen, self.older = {}, seen
        for found in (new, parts):
            self.seen.update(found)
            for word in [w for w in found if len(w) > LONGEST]:
                del self.seen[word]

    def encode(self, text: str) -> list[int]:
        special, ids = self.vocabulary.special, []
        for part in special.split(text) if special and any(s in text for s in self.specials) else (text,):
            if part in self.vocabulary.specials:
                ids.append(self.vocabulary.specials[part])
            else:
                ids += np.frombuffer(b"".join(self.stretches(STRETCH.findall(part))), "<u4").tolist()
        return ids

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts, one behind the other, and where each text's ids start (the last start is the end)."""
        words, numbers, starts = cut(texts, self.specials)
        raw, at = gathered(pa.array(self.stretches(words.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()), numbers)
        return np.frombuffer(raw, "<u4", int(at[-1]) // 4), at[starts] // 4

    def decode(self, ids: Iterable[int]) -> str:
        known = self.vocabulary.bytes
        return b"".join([known[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[tuple[str, str | None], Codec] = {}


def codec(vocabulary: str | None = None, lexicon: str | None = None) -> Codec:
    """This worker's codec. lexicon: the name of a file that the session has handed to its executors."""
    path = vocabulary or vocabulary_path()
    if (path, lexicon) not in _codecs:
        _codecs.clear()
        _codecs[path, lexicon] = Codec(Vocabulary(path), Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None)
    return _codecs[path, lexicon]


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n): how often each stretch of at most LONGEST code points occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, COUNTED):
            words, numbers, _ = cut(batch.column("text"))
            counts = pa.array(np.bincount(numbers, minlength=len(words)).astype(np.int64))
            rows = pa.RecordBatch.from_arrays([words.cast(pa.string()), counts], ["word", "n"])
            yield rows.filter(pc.less_equal(pc.utf8_length(words), LONGEST))

    return docs.select("text").mapInArrow(count, schema(word="string", n="bigint")).groupBy("word").agg(F.sum("n").alias("n"))


def corpus_lexicon(docs: DataFrame, vocabulary: str | None = None, size: int = LEXICON) -> str:
    """Compile the most frequent stretches of all documents, at most size of them; returns the name under which executors find the file.

    All words are counted. Counts fall into steps of 2^(1/16); the words of as many steps, from the top, as together hold at most
    size words pass through the driver, and no others. An empty table gives an empty lexicon.
    """
    spark = docs.sparkSession
    step = F.floor(F.log2("n") * 16).cast("int")
    counts = staged(word_counts(docs).select("word", step.alias("step")), "words")
    least, words = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):  # at most 16 * 63 steps
        words += r["count"]
        if words > size:
            break
        least = r.step
    frequent = counts.where(F.col("step") >= least).select("word").collect() if least is not None else []
    words = Vocabulary(vocabulary or vocabulary_path())
    image = compile_lexicon({r.word.encode(): words.exact(r.word) for r in frequent})
    return share_file(spark, image, "lexicon")


def encode(docs: DataFrame, lexicon: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, lexicon)
        for batch in slices(batches):
            ids, starts = c.encode_all(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.mapInArrow(run, schema(doc_id="bigint", ids="array<int>"))


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, ids) to (doc_id, text). A null list is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [c.decode(() if i is None else i) for i in frame["ids"]]})

    return rows.mapInPandas(run, schema(doc_id="bigint", text="string"))


def round_trip(docs: DataFrame, vocabulary: str | None = None, size: int = LEXICON) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256), encoded and decoded again in one pass.

    A null text is empty and has no ids. Repeated rows each have their row; a null doc_id stays null.
    """
    lexicon = corpus_lexicon(docs, vocabulary, size)

    def digests(raw: pa.Buffer, edges: np.ndarray, clean: Callable[[bytes], bytes]) -> list[str]:
        view, ends = memoryview(raw), edges.tolist()
        return [hashlib.sha256(clean(bytes(view[a:b]))).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, lexicon)
        for batch in slices(batches):
            ids, starts = c.encode_all(batch.column("text"))
            names, at = gathered(c.names, ids)
            numbered = digests(names, at[starts], lambda part: part[:-1])  # without the last comma
            texts, at = gathered(c.bytes, ids)
            decoded = digests(texts, at[starts], lambda part: part.decode("utf-8", "replace").encode())
            columns = [batch.column("doc_id"), pa.array(np.diff(starts)), pa.array(numbered, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, schema(doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(id_and_text(table(spark, sf_dir, "documents")))
