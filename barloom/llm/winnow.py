"""Benchmark decontamination by winnowing.

Of every WINDOW - GRAM + 1 consecutive word k-grams the one of least hash is kept, in documents and in benchmark items alike. A
span of WINDOW words that both share holds the same k-grams, so both keep the same one: every such span is found. A hit fixes how
the two texts lie on each other; there they are compared word by word, and runs of at least WINDOW equal words are marked.
An item shorter than WINDOW words is one window of its own; its gram is looked up among all grams of that length.

The benchmark is a stated set that all documents meet. It is shipped to tasks in blocks of at most BLOCK bytes of text, which
documents pass one after another in the same tasks: no shuffle, and no group that a common passage could make large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import id_and_text, schema, table
from barloom.llm.words import gram_hashes, selected, word_bytes, word_hashes

WINDOW, GRAM = 10, 5  # words of a window, and of a k-gram
BLOCK = 24 << 20  # bytes of benchmark text that a task holds at once


class Index:
    """Fingerprints of a block of benchmark items."""

    def __init__(self, names: list[str], texts: list[str], window: int = WINDOW, gram: int = GRAM) -> None:
        self.names, self.window, self.gram = names, window, min(gram, window)
        hashes = [word_hashes(word_bytes(t)) for t in texts]
        self.bounds = np.concatenate([[0], np.cumsum([len(h) for h in hashes], dtype=np.int64)])
        self.words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        prints, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        short: dict[int, list[tuple[int, int]]] = {}
        for item, words in enumerate(hashes):
            if len(words) >= window:
                grams = gram_hashes(words, self.gram)
                kept = selected(grams, window - self.gram + 1)
                prints.append(grams[kept])
                places.append(kept + self.bounds[item])
            elif len(words):
                short.setdefault(len(words), []).append((int(gram_hashes(words, len(words))[0]), item))
        prints, places = np.concatenate(prints), np.concatenate(places)
        order = np.argsort(prints, kind="stable")
        self.prints, self.places = prints[order], places[order]
        self.owners = np.searchsorted(self.bounds, self.places, side="right") - 1
        self.short = {n: (np.array(sorted(h for h, _ in found), np.uint64), np.array([i for _, i in sorted(found)], np.int64)) for n, found in short.items()}

    def mark(self, words: np.ndarray, hit: np.ndarray, items: set[str]) -> None:
        """Mark the words inside any occurrence of a window, and name the items that occur."""
        if len(self.prints) and len(words) >= self.window:
            grams = gram_hashes(words, self.gram)
            kept = selected(grams, self.window - self.gram + 1)
            first, last = (np.searchsorted(self.prints, grams[kept], side=s) for s in ("left", "right"))
            found = np.flatnonzero(last > first)
            if len(found):
                counts = last[found] - first[found]
                matches = np.repeat(first[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                shifts = np.repeat(kept[found], counts) - self.places[matches]
                for item, shift in np.unique(np.stack([self.owners[matches], shifts]), axis=1).T.tolist():
                    self._extend(item, shift, words, hit, items)
        for n, (prints, owners) in self.short.items():
            grams = gram_hashes(words, n)
            first, last = (np.searchsorted(prints, grams, side=s) for s in ("left", "right"))
            for i in np.flatnonzero(last > first).tolist():
                for item in owners[first[i] : last[i]].tolist():
                    if (words[i : i + n] == self.words[self.bounds[item] : self.bounds[item + 1]]).all():
                        hit[i : i + n] = True
                        items.add(self.names[item])

    def _extend(self, item: int, shift: int, words: np.ndarray, hit: np.ndarray, items: set[str]) -> None:
        """Compare an item with a document as they lie on each other; shift: document place minus item place."""
        start, end = max(int(self.bounds[item]), -shift), min(int(self.bounds[item + 1]), len(words) - shift)
        same = np.concatenate([[False], self.words[start:end] == words[start + shift : end + shift], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b - a >= self.window:
                hit[start + shift + a : start + shift + b] = True
                items.add(self.names[item])


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, text) and items (item_id string, text) to (doc_id, n_words, hits, items).

    hits: ranges [start, end) of hit words, as one flat list; items: distinct ids of items with an occurring window, sorted as
    strings. Null texts have no words; a null item_id is written empty. Repeated rows each have their row.
    """
    shipped = indexes(items, window, gram, block)
    kept = schema(doc_id="bigint", text="string", n_words="bigint", hits="array<int>", items="array<string>")
    rows = docs.select("doc_id", "text", F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for n, index in enumerate(shipped):
        rows = rows.mapInPandas(_marker(index, last=n == len(shipped) - 1), kept)
    return rows.select("doc_id", "n_words", "hits", "items")


def indexes(items: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> list[Broadcast]:
    """The items' fingerprints in blocks of about so many bytes of text, each checked and then shipped by itself."""
    spark = items.sparkSession
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block))
    shipped = []
    for n in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        given = [(r.item_id or "", r.text or "") for r in part.select("item_id", "text").collect()]
        shipped.append(spark.sparkContext.broadcast(Index([i for i, _ in given], [t for _, t in given], window, gram)))
    return shipped


def contaminated(text: Column, items: DataFrame) -> Column:
    """Whether any window of any item occurs in a text; false for a null text."""
    found = F.lit(False)
    for shipped in indexes(items):
        found = found | _hit(shipped)(text)
    return found


def _hit(shipped: Broadcast):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        def any_hit(text: str | None) -> bool:
            words = word_hashes(word_bytes(text or ""))
            marks = np.zeros(len(words), bool)
            shipped.value.mark(words, marks, set())
            return bool(marks.any())

        return pd.Series([any_hit(t) for t in texts], dtype=bool)

    return hit


def _marker(shipped: Broadcast, last: bool):
    """Passes the texts on to the next block's marker, unless it is the last."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shipped.value
        for frame in frames:
            hits, items, sizes = [], [], []
            for text, before, named in zip(frame["text"], frame["hits"], frame["items"], strict=True):
                words = word_hashes(word_bytes(text))
                hit, found = np.zeros(len(words), bool), set(named)
                for a, b in zip(before[::2], before[1::2], strict=True):
                    hit[a:b] = True
                index.mark(words, hit, found)
                edges = np.concatenate([[False], hit, [False]])
                hits.append(np.flatnonzero(edges[1:] != edges[:-1]).astype(np.int32))
                items.append(sorted(found))
                sizes.append(len(words))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": None if last else frame["text"], "n_words": sizes, "hits": hits, "items": items})

    return run


def summary(found: DataFrame) -> DataFrame:
    """The report of find_contamination as counts and a digest."""
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), F.lit(0).cast("long"), lambda s, i: s + F.get("hits", i + 1) - F.get("hits", i))
    n_hit = F.when(F.size("hits") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_contamination(id_and_text(table(spark, sf_dir, "documents")), benchmark_items(spark, sf_dir)))
