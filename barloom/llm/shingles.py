"""Near duplicates by their sets of word shingles: similarity (Jaccard) of at least LEAST, every link checked on the whole sets.

First come the links of `barloom.llm.simhash` between the texts' fingerprints, each checked on the whole sets. What SimHash's radius
does not reach is met by min-hash buckets: candidates share the ROWS min-hashes of one of BANDS bands, so a pair of similarity 0.8 is missed
with a chance of (1 - 0.8^5)^20 = 4e-4, one of 0.85 with 8e-6. Of buckets whose members are still apart every text meets the centre alone,
which is linear and joins most groups. Then, in buckets whose members are still apart, cells of at most CELL by CELL members are compared on the whole sets inside
a task, each pair in the first band that it shares. Only a spanning forest of the links leaves a cell, so nothing lists
pairs. Texts travel once for each meeting with centres, and once for each cell in which they have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.components import components
from barloom.llm.shared import drop_staged, schema, staged
from barloom.llm.simhash import forest

SHINGLE, SEED = 5, 42
LEAST = (4, 5)  # similarity of 4/5 or more
BANDS, ROWS = 20, 5
MAYBE = 0.6  # share of equal sketch values; at similarity 0.8 a share of 0.8 is expected, with a deviation of 0.04
CELL = 512  # members of one side of a cell
MET_BITS = 8  # so many members (as a power of two) meet one copy of a centre
BLOCK = 512  # shingles whose min-hashes are taken at once, so that they stay in a core's cache
REMEMBERED = 1 << 15  # words whose hashes a worker remembers
COLUMNS = 4096  # shingles of a cell that are counted at once

_random = np.random.default_rng(SEED)
_FLIP, _STRETCH = (_random.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] for _ in range(2))
_STRETCH = _STRETCH | np.uint64(1)
_MIX = _random.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
_PLACES = _random.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)

_seen: dict[bytes, int] = {}


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; of all words at once if they are fewer than a shingle, none if there are no words."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(_seen) > REMEMBERED:
        _seen.clear()
    _seen.update((w, xxhash.xxh64_intdigest(w, SEED)) for w in set(words).difference(_seen))
    values = np.fromiter(map(_seen.__getitem__, words), np.uint64, len(words))
    total = max(len(values) - SHINGLE + 1, min(len(values), 1))
    sums = np.full(total, min(len(values), SHINGLE), np.uint64)
    for i in range(min(SHINGLE, len(values))):
        sums = _mixed(sums + values[i : i + total] * _PLACES[i])
    return np.unique(sums)


def least_values(shingles: np.ndarray) -> np.ndarray:
    """The min-hashes of a set."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for start in range(0, len(shingles), BLOCK):
        np.minimum(least, ((shingles[None, start : start + BLOCK] ^ _FLIP) * _STRETCH).min(axis=1), out=least)
    return least


def _sketches(texts: DataFrame) -> DataFrame:
    """Rows (name, text) to (name, fp, keys, sketch): the SimHash, a bucket key per band, and a byte per min-hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                prints.append(simhash.fingerprint(text, SHINGLE))
                least = _mixed(least_values(shingle_set(text)))
                with np.errstate(over="ignore"):
                    keys.append(_mixed((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)).view(np.int64))
                sketches.append((least & np.uint64(255)).astype(np.uint8).tobytes())
            columns = [batch.column(0), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "fp", "keys", "sketch"])

    return texts.select("name", "text").mapInArrow(of, schema(name="binary", fp="bigint", keys="array<bigint>", sketch="binary"))


def alike(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two sets are as similar as LEAST or more."""
    (part, whole), small, large = LEAST, min(len(left), len(right)), max(len(left), len(right))
    if small * whole < large * part:
        return False
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common * whole >= (len(left) + len(right) - common) * part


def links_of(sets: Sequence[np.ndarray], meet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), i < j, of a cell that are alike, among those that `meet` allows; common shingles of all pairs are counted by products of blocks."""
    n, (part, whole) = len(sets), LEAST
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    shared = many[column] > 1  # the others are common to none
    owner, column = owner[shared], (np.cumsum(many > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[low:high], column[low:high] - start] = 1
        common += block @ block.T
    near = common * whole >= (sizes[:, None] + sizes[None, :] - common) * part
    return np.nonzero(np.triu(near & meet, 1))


def _met(pairs: DataFrame, side: DataFrame, kind: str) -> DataFrame:
    """Rows (a, b, block, payload), a null for a centre's own row, which comes before its members' in each block.

    pairs: placed (a, b, block); side: (node, payload), one row a node. A centre of many members has a row for each block of them.
    """
    heads = pairs.select("b", "block").distinct().join(side, F.col("b") == F.col("node")).select(F.lit(None).cast("bigint").alias("a"), "b", "block", kind)
    members = pairs.join(side, F.col("a") == F.col("node")).select("a", "b", "block", kind)
    return heads.unionByName(members).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())


def _placed(pairs: DataFrame, name: str) -> DataFrame:
    """Distinct pairs (a, b) with a block, such that a centre b has at most 2^MET_BITS pairs in each."""
    rows = pairs.repartitionByRange("b", "a").sortWithinPartitions("b", "a").withColumn("place", F.monotonically_increasing_id())
    return staged(rows.select("a", "b", F.shiftright("place", MET_BITS).alias("block")), name)


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((1, BANDS * ROWS), np.uint8)
        for frame in frames:
            sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, BANDS * ROWS)
            head = frame["a"].isna().to_numpy()
            sketch = np.concatenate([held, sketch])
            place = np.maximum.accumulate(np.where(head, np.arange(1, len(head) + 1), 0))
            near = ~head & ((sketch[1:] == sketch[place]).mean(axis=1) >= MAYBE)
            held = sketch[place[-1:]] if len(head) else held
            yield pd.DataFrame({"a": frame["a"][near].astype("int64"), "b": frame["b"][near]})

    return _met(pairs, sketches.select("node", "sketch"), "sketch").mapInPandas(run, schema(a="bigint", b="bigint"))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre = np.zeros(0, np.uint64)
        for frame in frames:
            good = []
            for own, text in zip(frame["a"].isna(), frame["text"], strict=True):
                found = shingle_set(text)
                good.append(not own and alike(found, centre))
                if own:
                    centre = found
            yield pd.DataFrame({"a": frame["a"][good].astype("int64"), "b": frame["b"][good]})

    return _met(pairs, texts, "text").mapInPandas(run, schema(a="bigint", b="bigint"))


CELLS = ["key", "first", "second"]


def _cell_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each cell, of rows that are sorted by cell."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        names = frame[CELLS].to_numpy()
        bounds = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
        for start, end in zip(bounds, bounds[1:], strict=False):
            part = frame.iloc[start:end]
            if held and (held[0][CELLS].iloc[0].to_numpy() != names[start]).any():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _candidates(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of buckets whose members are apart: rows (key, first, second, node, component, side) that have a candidate in the cell.

    members: (key, band, node, component). A pair counts in the first band that it shares, and not if it is in one component.
    """
    buckets = members.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rows = members.join(staged(buckets.select("key", "members"), "apart"), "key").join(sketches.select("node", "keys", "sketch"), "node")
    chunks = F.ceil(F.col("members") / CELL).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    side = F.when(F.col("chunk") == F.col("other"), -1).when(F.col("chunk") < F.col("other"), 0).otherwise(1)
    rows = rows.select("key", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "band", "node", "component", side.alias("side"), "keys", "sketch")
    rows = rows.repartition(*CELLS).sortWithinPartitions(*CELLS)

    def flagged(frame: pd.DataFrame) -> np.ndarray:
        node, component, side = (frame[c].to_numpy() for c in ("node", "component", "side"))
        band, keys = int(frame["band"].iloc[0]), np.stack(frame["keys"].to_list())[:, : int(frame["band"].iloc[0])]
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
        found = np.zeros(len(frame), bool)
        for i in range(len(frame)):
            others = np.flatnonzero((component != component[i]) & ((side != side[i]) if side[i] >= 0 else (node > node[i])))
            if band and len(others):
                others = others[~(keys[others] == keys[i]).any(axis=1)]
            if len(others):
                near = others[(sketch[others] == sketch[i]).mean(axis=1) >= MAYBE]
                found[near] = True
                found[i] |= len(near) > 0
        return found

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _cell_groups(frames):
            yield frame.loc[flagged(frame), [*CELLS, "node", "component", "side"]]

    return rows.mapInPandas(run, schema(key="bigint", first="int", second="int", node="bigint", component="bigint", side="int"))


def _cell_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) inside cells, checked on the whole sets; enough of them to join what is alike."""
    whole = rows.join(texts, "node").repartition(*CELLS).sortWithinPartitions(*CELLS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _cell_groups(frames):
            node, component, side = (frame[c].to_numpy() for c in ("node", "component", "side"))
            meet = (component[:, None] != component) & ((side[:, None] != side) | (side[:, None] < 0))
            i, j = links_of([shingle_set(t) for t in frame["text"]], meet)
            parent = forest(len(node), i, j)
            hung = np.flatnonzero(parent != np.arange(len(node)))
            yield pd.DataFrame({"a": node[hung], "b": node[parent[hung]]})

    return whole.mapInPandas(run, schema(a="bigint", b="bigint"))


def _wanted(texts: DataFrame, sketches: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(node, text) of so many distinct nodes."""
    named = sketches.select("name", "node").join(nodes, "node", "left_semi")
    return staged(texts.join(named, "name").groupBy("node").agg(F.first("text").alias("text")), name)


def _whole_links(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, name: str) -> DataFrame:
    """The placed pairs whose whole sets are alike."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = _wanted(texts, sketches, nodes, f"{name}-texts")
    links = staged(_confirmed(pairs, wanted), f"{name}-links")
    drop_staged(wanted)
    return links


def fingerprint_links(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b) between nodes by SimHash, checked on the whole sets: equal fingerprints meet their first node, near ones' first nodes meet."""
    prints = sketches.select("fp", "node")
    first = staged(prints.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("members")), "prints")
    equal = prints.join(first.where("members > 1"), "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = simhash.links(first.select("fp"))
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"at_{c}")) for c in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.greatest("at_a", "at_b").alias("a"), F.least("at_a", "at_b").alias("b"))
    pairs = _placed(equal.unionByName(near).distinct(), "print-pairs")
    links = _whole_links(pairs, texts, sketches, "print")
    drop_staged(pairs, first)
    return links


def near_duplicates(texts: DataFrame) -> DataFrame:
    """Rows (name, text), name a binary that is equal for equal texts alone, to (name, component) for the texts that have a near duplicate.

    Null texts are not allowed; texts without words have the empty set and are alike. Repeated rows are one text. A component is a
    number that all its texts share. An empty table gives no rows.
    """
    once = _sketches(texts).dropDuplicates(["name"])
    sketches = staged(once.withColumn("node", F.monotonically_increasing_id()), "sketches")
    printed = fingerprint_links(texts, sketches)
    known = staged(components(printed), "print-components")
    rows = sketches.select("node", "keys").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.posexplode("keys").alias("band", "key"))
    apart = [F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("node", "component")).alias("centre")]
    buckets = rows.groupBy("key").agg(*apart).where("low <> high").select("key", "centre")
    members = staged(rows.join(buckets, "key").select("key", "band", "node", "component", "centre"), "members")
    met = members.where("component <> centre.component").select(F.col("node").alias("a"), F.col("centre.node").alias("b"))
    pairs = _placed(met.distinct(), "star-pairs")
    near = _placed(_promising(pairs, sketches), "near-pairs")
    drop_staged(pairs, known)
    starred = _whole_links(near, texts, sketches, "star")
    drop_staged(near)
    links = printed.unionByName(starred)
    known = staged(components(links), "star-components")
    placed = members.select("key", "band", "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cells = staged(_candidates(placed, sketches), "cells")
    drop_staged(members, known)
    wanted = _wanted(texts, sketches, cells.select("node").distinct(), "cell-texts")
    more = staged(_cell_links(cells, wanted), "cell-links")
    drop_staged(cells, wanted)
    found = staged(components(links.unionByName(more)), "components")
    named = staged(found.join(sketches.select("node", "name"), "node").select("name", "component"), "named")
    drop_staged(printed, starred, more, found, sketches)
    return named
