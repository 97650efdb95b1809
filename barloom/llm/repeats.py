"""Exact removal of repeated byte strings, by bucket-pointer refinement of the text around chosen q-grams.

A string of LENGTH bytes counts as repeated if it also starts earlier in the corpus. All suffixes of 100 TB can't be sorted in
one place, so buckets are formed where every repeated string must meet its earlier copy: of each LENGTH - GRAM + 1
consecutive q-grams the one of least hash is an anchor, and equal strings choose equal anchors. A bucket is the
occurrences of one anchor; each carries a digest of its context, the bytes that any string around the anchor can reach.

1. Occurrences with equal contexts collapse to the first one; the others are wholly repeated. This is done in each
   task's batch before the shuffle, and again in sorted order after it, so a frequent passage leaves a row per batch.
2. Buckets with one context are done. In the others the contexts are fetched, and their suffixes are refined: buckets by 4 bytes
   at each offset, then by the bucket identifiers at later offsets, doubling to 64 bytes and on to LENGTH. A bucket of one
   drops out at once, and ids of shorter strings are used again for longer ones.
3. A bucket of more than HOT contexts is never gathered: its strings are grouped by digest over all tasks.

Intervals of repeated bytes are united per document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.shared import id_and_text, schema, staged, table
from barloom.llm.words import mixed, selected

LENGTH, GRAM = 100, 48
REACH = LENGTH - GRAM  # bytes beside an anchor that a string around it can hold
SEGMENT = 1 << 21  # bytes of a text hashed at once
HOT = 20_000  # contexts of a bucket refined in one task
ROWS = 2048  # contexts refined together

COVER, CONTEXT, CROWDED = 0, 1, 2
KEY = {"id": "bigint", "copy": "int"}


def gram_ids(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of so many bytes from each place on, put together from those of 1, 2, 4 ... bytes."""
    values = mixed(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    width, out, done = 1, None, 0
    while True:
        if length & width:
            out = values if out is None else _followed(out, values[done:])
            done += width
        width *= 2
        if width > length:
            return mixed(out)
        values = _followed(values, values[width // 2 :])


def _followed(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Hashes of two strings in a row."""
    n = min(len(first), len(later))
    values = first[:n] * np.uint64(0xD6E8FEB86659FD93) + (later[:n] ^ (later[:n] >> np.uint64(29)))
    return values ^ (values >> np.uint64(32))


def anchors(raw: bytes, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text's anchors; none in a text shorter than LENGTH."""
    places, hashes = [], []
    for start in range(0, max(1, len(raw) - LENGTH + 1), segment):
        part = np.frombuffer(raw, np.uint8, min(segment + LENGTH - 1, len(raw) - start), start)
        if len(part) >= LENGTH:
            grams = gram_ids(part, GRAM)
            kept = selected(grams, REACH + 1)
            places.append(kept + start)
            hashes.append(grams[kept])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as sorted disjoint ones; touching ones are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[fresh], ends[np.concatenate([fresh[1:] - 1, [len(ends) - 1]])]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with a unique (id, copy): a null doc_id comes first, and rows of one doc_id follow each other by text."""
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    if docs.groupBy("id").count().where("count > 1").isEmpty():
        return docs.withColumn("copy", F.lit(0))
    return docs.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("text")))


def _occurrences(frames: Iterator[pd.DataFrame], segment: int) -> Iterator[pd.DataFrame]:
    """Anchors of a batch of documents: the first of each context as (h, c, id, copy, place, extent), and covers of the others."""
    for frame in frames:
        frame = frame.sort_values(["id", "copy"], kind="stable")
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        for row, text in enumerate(frame["text"]):
            raw = text.encode("utf-8", "replace")
            places, hashes = anchors(raw, segment)
            left, right = np.minimum(places, REACH), np.minimum(len(raw) - GRAM - places, REACH)
            digest = xxhash.xxh3_64_intdigest
            # the reach to the left is part of the digest: near a text's start, different anchors may have one and the same context
            contexts = [digest(raw[p - n : e], n) for p, n, e in zip(places.tolist(), left.tolist(), (places + GRAM + right).tolist(), strict=True)]
            for part, value in zip(parts, (hashes, np.array(contexts, np.uint64), np.full(len(places), row), places, left << 8 | right), strict=True):
                part.append(value)
        if not parts[0]:
            continue
        h, c, row, place, extent = (np.concatenate(p) for p in parts)
        order = np.lexsort((c, h))  # stable: within equal contexts the earliest stays first
        again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])])
        first, later = np.sort(order[~again]), np.sort(order[again])
        ids, copies = frame["id"].to_numpy(), frame["copy"].to_numpy()
        yield _rows(h[first], c[first], ids[row[first]], copies[row[first]], place[first], extent[first], np.full(len(first), CONTEXT))
        starts, ends, rows = [], [], []
        for r, own in zip(*_split(row[later]), strict=True):
            own = later[own]
            a, b = united(place[own] - (extent[own] >> 8), place[own] + GRAM + (extent[own] & 255))
            starts.append(a)
            ends.append(b)
            rows.append(np.full(len(a), r))
        if rows:
            rows = np.concatenate(rows)
            yield _rows(mixed(rows.astype(np.uint64)), np.zeros(len(rows), np.uint64), ids[rows], copies[rows], np.concatenate(starts), np.concatenate(ends), np.full(len(rows), COVER))


def _split(sorted_keys: np.ndarray) -> tuple[list, list[np.ndarray]]:
    """The distinct values of a sorted array and the indices of each."""
    bounds = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[bounds].tolist(), np.split(np.arange(len(sorted_keys)), bounds[1:]) if len(bounds) else []


#: place and extent hold a start and an end where the kind is COVER.
OCCURRENCE = {"h": "bigint", "c": "bigint", **KEY, "place": "bigint", "extent": "bigint", "kind": "int"}


def _rows(h, c, ids, copies, place, extent, kind) -> pd.DataFrame:
    signed = lambda x: np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else x
    return pd.DataFrame({"h": signed(h), "c": signed(c), "id": ids, "copy": copies, "place": place, "extent": extent, "kind": kind})


def _buckets(frames: Iterator[pd.DataFrame], hot: int) -> Iterator[pd.DataFrame]:
    """Occurrences sorted by (kind, h, c, place) to covers of repeated contexts, and one occurrence of each context of a bucket of several.

    Only the last row and, of an open bucket, the first are held, whatever a bucket's size.
    """
    last_h = last_c = None
    pending: pd.DataFrame | None = None  # the first occurrence of a bucket that has shown one context so far
    classes = 0
    for frame in frames:
        covers = frame[frame["kind"] == COVER]
        if len(covers):
            yield covers
        frame = frame[frame["kind"] == CONTEXT].reset_index(drop=True)
        if not len(frame):
            continue
        h, c = frame["h"].to_numpy(), frame["c"].to_numpy()
        new_bucket = np.concatenate([[last_h is None or h[0] != last_h], h[1:] != h[:-1]])
        new_context = new_bucket | np.concatenate([[c[0] != last_c], c[1:] != c[:-1]])
        last_h, last_c = h[-1], c[-1]
        again = frame[~new_context]
        if len(again):
            extent = again["extent"].to_numpy()
            yield again.assign(kind=COVER, place=again["place"] - (extent >> 8), extent=again["place"] + GRAM + (extent & 255))
        firsts = np.flatnonzero(new_context)
        starts = new_bucket[firsts]
        if len(firsts) and pending is not None:
            if not starts[0]:
                yield pending
            pending = None
        followed = np.concatenate([~starts[1:], [False]]) if len(firsts) else starts
        several = firsts[~starts | followed]
        if len(several):
            yield frame.iloc[several]
        if len(firsts) and starts[-1]:
            pending = frame.iloc[firsts[-1:]]
        count = np.arange(1, len(firsts) + 1)  # contexts of each bucket so far
        base = np.maximum.accumulate(np.where(starts, count - 1, -classes)) if len(firsts) else count
        count = count - base
        crowded = firsts[count == hot + 1]
        if len(crowded):
            yield frame.iloc[crowded].assign(kind=CROWDED)
        classes = int(count[-1]) if len(firsts) else classes


def repeated_starts(contexts: list[bytes], left: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Which strings of LENGTH bytes, by context and offset, also stand at the same offset in an earlier context of the bucket.

    Contexts are in order of place within their bucket; left is how far each reaches before its anchor.
    """
    n, width = len(contexts), 2 * REACH + GRAM
    data = np.zeros((n, width + 4), np.uint8)
    known = np.zeros((n, width + 4), bool)
    for i, (context, reach) in enumerate(zip(contexts, left.tolist(), strict=True)):
        data[i, REACH - reach : REACH - reach + len(context)] = np.frombuffer(context, np.uint8)
        known[i, REACH - reach : REACH - reach + len(context)] = True
    four = sum(data[:, i : width - 3 + i].astype(np.int64) << (8 * i) for i in range(4))
    whole = known[:, : width - 3] & known[:, 3:width]
    place = bucket[:, None] * np.int64(width) + np.arange(width - 3)
    ids = {4: _bucket_ids(place << np.int64(32) | four, whole)}
    size = 4
    while size < 64:
        ids[2 * size] = _joined(ids[size][:, :-size], ids[size][:, size:])
        size *= 2
    starts = REACH + 1
    longer = _joined(ids[64][:, :starts], ids[32][:, 64 : 64 + starts])
    longer = _joined(longer, ids[4][:, LENGTH - 4 : LENGTH - 4 + starts])
    flat = longer.ravel()
    some = np.flatnonzero(flat >= 0)
    out = np.zeros(flat.shape, bool)
    if len(some):
        order = some[np.argsort(flat[some], kind="stable")]  # rows in order of place within a bucket's id
        out[order[1:]] = flat[order[1:]] == flat[order[:-1]]
    return out.reshape(longer.shape)


def _bucket_ids(keys: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Bucket identifiers of equal keys; -1 where inactive or alone."""
    out = np.full(keys.shape, -1, np.int64)
    if active.any():
        _, ids, counts = np.unique(keys[active], return_inverse=True, return_counts=True)
        out[active] = np.where(counts[ids] > 1, ids, -1)
    return out


def _joined(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Buckets of longer strings, from the identifiers at their start and at a later offset."""
    return _bucket_ids(first * (later.max(initial=0) + 1) + later, (first >= 0) & (later >= 0))


def _refined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts sorted by (h, place) to covers. Buckets are held until they end; none has more than HOT contexts."""
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        for start in range(0, len(frame), ROWS):
            held.append(frame.iloc[start : start + ROWS])
            rows += len(held[-1])
            if rows >= ROWS and (held[0]["h"].iloc[0] != held[-1]["h"].iloc[-1]):
                whole = pd.concat(held, ignore_index=True)
                cut = int((whole["h"] != whole["h"].iloc[-1]).to_numpy().nonzero()[0][-1]) + 1
                yield _covers(whole.iloc[:cut])
                held = [whole.iloc[cut:]]
                rows = len(held[0])
    if rows:
        yield _covers(pd.concat(held, ignore_index=True))


def _covers(frame: pd.DataFrame) -> pd.DataFrame:
    bucket = np.unique(frame["h"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    hits = repeated_starts(frame["context"].tolist(), frame["extent"].to_numpy() >> 8, bucket)
    found = np.flatnonzero(hits.any(axis=1))
    least, most = hits[found].argmax(axis=1), REACH - hits[found, ::-1].argmax(axis=1)
    place = frame["place"].to_numpy()[found] - REACH
    return pd.DataFrame({"id": frame["id"].to_numpy()[found], "copy": frame["copy"].to_numpy()[found], "start": place + least, "end": place + most + LENGTH})


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed as bytes, so that what is shuffled is small."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            yield frame[["doc_id", "id", "copy"]].assign(packed=[packer.compress(t.encode("utf-8", "replace")) for t in frame["text"]])

    return docs.select("doc_id", "id", "copy", "text").mapInPandas(pack, schema(doc_id="bigint", **KEY, packed="binary"))


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each wanted occurrence (h, id, copy, place, extent)."""
    lists = wanted.groupBy("id", "copy").agg(F.collect_list(F.struct("h", (F.shiftleft("place", 16) + F.col("extent")).alias("spot"))).alias("wanted"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        for frame in frames:
            rows = []
            for id_, copy, packed, places in zip(frame["id"], frame["copy"], frame["packed"], frame["wanted"], strict=True):
                raw = unpacker.decompress(packed)
                for x in places:
                    place, extent = x["spot"] >> 16, x["spot"] & 0xFFFF
                    rows.append((x["h"], id_, copy, place, extent, raw[place - (extent >> 8) : place + GRAM + (extent & 255)]))
            yield pd.DataFrame(rows, columns=["h", "id", "copy", "place", "extent", "context"])

    joined = _packed(docs).join(lists, ["id", "copy"]).select("id", "copy", "packed", "wanted")
    return joined.mapInPandas(cut, schema(h="bigint", **KEY, place="bigint", extent="bigint", context="binary"))


def _crowded_covers(contexts: DataFrame) -> DataFrame:
    """Covers of buckets too large for a task: every string of a context is a row, and the first of equal ones is found by aggregation."""

    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for h, id_, copy, place, extent, context in frame[["h", "id", "copy", "place", "extent", "context"]].itertuples(index=False):
                for i in range(len(context) - LENGTH + 1):
                    start = place - (extent >> 8) + i
                    rows.append((h, place - start, xxhash.xxh3_128_digest(context[i : i + LENGTH]), id_, copy, start))
            yield pd.DataFrame(rows, columns=["h", "offset", "digest", "id", "copy", "start"])

    rows = staged(contexts.mapInPandas(strings, schema(h="bigint", offset="int", digest="binary", **KEY, start="bigint")), "strings")
    firsts = rows.groupBy("h", "offset", "digest").agg(F.min(F.struct("id", "copy", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(firsts, ["h", "offset", "digest"]).where(F.struct("id", "copy", "start") != F.col("first"))
    return again.select("id", "copy", "start", (F.col("start") + LENGTH).alias("end"))


def remove_repeats(docs: DataFrame, hot: int = HOT, segment: int = SEGMENT) -> DataFrame:
    """Rows (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept): kept is the text's remaining bytes.

    Texts are UTF-8 bytes; a null text is empty; nothing in a text shorter than LENGTH is repeated. Of repeated rows all but the first go.
    hot: contexts of a bucket that one task refines at most; segment: bytes of a text hashed at once. Neither changes the result.
    """
    docs = _keyed(docs)
    found = docs.mapInPandas(lambda frames: _occurrences(frames, segment), schema(**OCCURRENCE))
    found = found.repartition("h").sortWithinPartitions("h", "c", "id", "copy", "place")
    found = staged(found.mapInPandas(lambda frames: _buckets(frames, hot), schema(**OCCURRENCE)), "occurrences")
    crowded = found.where(F.col("kind") == CROWDED).select("h").distinct()
    several = found.where(F.col("kind") == CONTEXT).select("h", "id", "copy", "place", "extent")
    covers = found.where(F.col("kind") == COVER).select("id", "copy", F.col("place").alias("start"), F.col("extent").alias("end"))
    few = several
    if not crowded.isEmpty():
        crowded = staged(crowded, "crowded")
        few = several.join(crowded, "h", "left_anti")
        covers = covers.unionByName(_crowded_covers(_contexts(docs, several.join(crowded, "h", "left_semi"))))
    contexts = _contexts(docs, few).repartition("h").sortWithinPartitions("h", "id", "copy", "place")
    refined = contexts.mapInPandas(_refined, schema(**KEY, start="bigint", end="bigint"))
    covers = staged(covers.unionByName(refined), "covers")
    lists = covers.groupBy("id", "copy").agg(F.collect_list(F.struct("start", "end")).alias("covers"))
    return _packed(docs).join(lists, ["id", "copy"], "left").select("doc_id", "packed", "covers").mapInPandas(_kept, schema(doc_id="bigint", n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept="binary"))


def _kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpacker = zstandard.ZstdDecompressor()
    for frame in frames:
        rows = []
        for packed, covers in zip(frame["packed"], frame["covers"], strict=True):
            raw = unpacker.decompress(packed)
            if covers is None or not len(covers):
                rows.append((len(raw), 0, 0, raw))
                continue
            starts, ends = united(np.array([x["start"] for x in covers]), np.array([x["end"] for x in covers]))
            edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(raw), len(raw) - len(kept), len(starts), kept))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
        out.insert(0, "doc_id", frame["doc_id"].array)
        yield out


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(id_and_text(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
