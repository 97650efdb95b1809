"""SimHash fingerprints and their near-duplicate groups, compared on vertical bit planes.

Two fingerprints of 64 bits that differ in at most ``radius`` bits agree on all but ``radius`` of ``bands`` bands, so they share
the value of some choice of bands - radius bands: each choice is one bucket table. Inside a bucket the bits of all members are
stored as planes, and a carry-save counter of a few bitwise words keeps the distances of 64 pairs at once; a block of pairs is
abandoned once every counter has passed the radius. A bucket of more than CELL members is cut into chunks and every pair of
chunks becomes a task's cell of its own. From a cell only a spanning forest of its links leaves, so links grow with members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.shared import id_and_text, schema, staged, table

SHINGLE, SEED, RADIUS, BANDS = 3, 42, 3, 5
CELL = 2048  # members of a bucket compared with each other in one task
BLOCK = 1 << 15  # shingles whose bits are counted at once
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text as a signed long; 0 for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return int(np.uint64(hashed(b" ".join(words), SEED)).astype(np.int64))
    total, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    for start in range(0, total, BLOCK):
        part = words[start : start + BLOCK + shingle - 1]
        shingles = zip(*(part[i:] for i in range(shingle)), strict=False)
        values = np.fromiter((hashed(b" ".join(s), SEED) for s in shingles), np.uint64)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, fp)."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "fp": np.fromiter((fingerprint(t) for t in frame["text"]), np.int64, len(frame))})

    return docs.mapInPandas(of, schema(doc_id="bigint", fp="bigint"))


def planes(values: np.ndarray) -> np.ndarray:
    """The bits of n fingerprints as 64 rows of ceil(n / 64) words; bit j of word i of row b is bit b of value 64 i + j."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def beyond(differences: Iterator[np.ndarray], radius: int) -> np.ndarray:
    """Planes of difference bits, one by one, to a word per 64 lanes that marks those with more than radius differences."""
    width = max(1, radius.bit_length())
    first = (1 << width) - 1 - radius  # counters start here, so that they overflow just beyond the radius
    counter: list[np.ndarray] = []
    over = None
    for n, carry in enumerate(differences):
        if over is None:
            over = np.zeros_like(carry)
            counter = [np.full_like(carry, ONES if first >> i & 1 else 0) for i in range(width)]
        for i in range(width):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if n % 8 == 7 and (over == ONES).all():
            break
    return over


def lanes(over: np.ndarray, n: int) -> np.ndarray:
    """The lanes below n that are not marked, along the last axis."""
    near = np.unpackbits(over.view(np.uint8), axis=-1, bitorder="little")[..., :n] == 0
    return near


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) given lane by lane: which of left[k], right[k] are near."""
    vertical = planes(left ^ right)
    return np.nonzero(lanes(beyond(iter(vertical), radius), len(left)))


def near_all(queries: np.ndarray, members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of near (query, member), in blocks of queries."""
    vertical = planes(members)
    step = max(1, (1 << 18) // vertical.shape[1])
    for start in range(0, len(queries), step):
        some = queries[start : start + step]
        signs = [np.where(some >> np.uint64(b) & np.uint64(1), ONES, np.uint64(0))[:, None] for b in range(64)]
        i, j = np.nonzero(lanes(beyond((vertical[b] ^ signs[b] for b in range(64)), radius), len(members)))
        yield i + start, j


def forest(n: int, left: np.ndarray, right: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Parents of n members after uniting the given pairs; each member ends at the least of its set."""
    parent = np.arange(n) if parent is None else parent
    while True:
        a, b = parent[left], parent[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            return parent
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _cell_links(fps: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the cells [start, end) of sorted rows. side: 0 or 1 of a cell of two chunks, -1 where all meet all."""
    sizes, left, right = ends - starts, [], []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]):  # small cells at once: a lane for each pair
        i, j = np.triu_indices(size, 1)
        base = starts[sizes == size][:, None]
        a, b = (base + i).ravel(), (base + j).ravel()
        meet = (side[a] < 0) | (side[a] != side[b])
        a, b = a[meet], b[meet]
        for k in range(0, len(a), 1 << 20):
            (near,) = near_pairs(fps[a[k : k + (1 << 20)]], fps[b[k : k + (1 << 20)]], radius)
            left.append(a[near + k])
            right.append(b[near + k])
    for start, end in zip(starts[sizes > 16], ends[sizes > 16], strict=True):
        own, parts = fps[start:end], side[start:end]
        rows = np.arange(len(own))
        first, second = (rows, rows) if parts[0] < 0 else (rows[parts == 0], rows[parts == 1])
        parent = np.arange(len(own))
        if len(first) and len(second):
            for i, j in near_all(own[first], own[second], radius):
                parent = forest(len(own), first[i], second[j], parent)
        hung = np.flatnonzero(parent != rows)
        left.append(hung + start)
        right.append(parent[hung] + start)
    none = np.zeros(0, np.int64)
    return fps[np.concatenate([none, *left])], fps[np.concatenate([none, *right])]


def links(distinct: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fp that differ in at most radius bits, enough of them to join each group."""
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen) for chosen in combinations(range(bands), bands - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    buckets = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    rows = distinct.select("fp", buckets.alias("bucket")).select("fp", "bucket.choice", "bucket.key")
    counts = rows.groupBy("choice", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = staged(counts, "buckets")
    rows = rows.join(shared, ["choice", "key"])
    chunks = F.ceil(F.col("members") / CELL).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select(
        "choice", "key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "fp",
        F.when(F.col("chunk") == F.col("other"), F.lit(-1)).when(F.col("chunk") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    cell = ["choice", "key", "low", "high"]
    rows = rows.repartition(*cell).sortWithinPartitions(*cell)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            names = frame[cell].to_numpy()
            turns = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            last = int(turns[-1]) if len(turns) else 0
            held = frame.iloc[last:]
            if last:
                yield matched(frame.iloc[:last], np.concatenate([[0], turns]))
        if held is not None and len(held):
            yield matched(held, np.array([0, len(held)]))

    def matched(frame: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        a, b = _cell_links(frame["fp"].to_numpy().view(np.uint64), frame["side"].to_numpy(), bounds[:-1], bounds[1:], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.mapInPandas(find, schema(a="bigint", b="bigint"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, fp, component_id): the smallest doc_id that links reach, the document's own included.

    Texts without words share fingerprint 0 and link like any other. Equal fingerprints meet as one node, so copies are never
    paired. Repeated rows each get their row; a null doc_id takes part, but is never a component_id unless a component has no other.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = components(links(distinct.select("fp"), radius, bands))
    of = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(staged(named, "named"), "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(id_and_text(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
