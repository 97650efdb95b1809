"""Texts cut into stretches that no pre-token of a byte-level BPE crosses, all texts of an Arrow batch at once.

A stretch is one leading space, if there is one, and what follows without white space; or white space up to the last character
before that. Cuts are found on the UTF-8 bytes of all texts together, and each distinct stretch is handed out once with the places
where it stands, so what is done for a stretch is done once for a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21  # bytes of text cut at once; a longer text is cut alone

#: Unicode's white space in UTF-8: by one byte, two and three.
WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), 32]] = True
WHITE2 = np.array([0xC285, 0xC2A0])
WHITE3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
LEADS = np.zeros(256, bool)
LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def slices(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in runs of about SLICE (or most) bytes of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        windows = (np.cumsum(sizes) - sizes) // (most or SLICE)
        edges = [0, *(np.flatnonzero(np.diff(windows)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    white = WHITE[data]
    leads = np.flatnonzero(LEADS[data])
    if len(leads):
        second, third = (data[np.minimum(leads + k, len(data) - 1)].astype(np.int64) for k in (1, 2))
        two = data[leads].astype(np.int64) << 8 | second
        at = leads[np.isin(two, WHITE2)]
        white[at] = white[at + 1] = True
        at = leads[np.isin(two << 8 | third, WHITE3)]
        white[at] = white[at + 1] = white[at + 2] = True
    return white


def cut(texts: pa.Array, whole: Sequence[str] = ()) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """The distinct stretches of some texts, the number of the stretch at each place, and the place where each text starts.

    A null text is empty. A text that holds one of the strings in whole stays a single stretch. The last start is the number of places.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    offsets = offsets - first
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    buffer = texts.buffers()[2].slice(first, n)
    data = np.frombuffer(buffer, np.uint8)
    white, starts = white_bytes(data), np.zeros(n + 1, bool)
    edge = white[1:] != white[:-1]
    starts[offsets] = True
    last = np.flatnonzero(edge & white[:-1])  # the last byte of white space that another character follows
    last = last[~starts[last + 1]]  # in the same text
    starts[1:n] |= edge & white[1:]
    starts[last[data[last] != 32] + 1] = True
    for _ in range(2):
        last = last - ((data[last] & 0xC0) == 0x80)  # its first byte
    starts[last] = True
    for special in whole:
        for i in np.flatnonzero(pc.match_substring(texts, special).to_numpy(zero_copy_only=False)).tolist():
            starts[offsets[i] + 1 : offsets[i + 1]] = False
    bounds = np.flatnonzero(starts)
    if bounds[-1] != n:
        bounds = np.append(bounds, n)
    found = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), buffer]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.searchsorted(bounds, offsets)


def gathered(values: pa.LargeBinaryArray, places: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The values at some places, one behind the other, and where each starts (the last start is the end)."""
    taken = values.take(pa.array(places))
    if not len(taken):
        return pa.py_buffer(b""), np.zeros(1, np.int64)
    starts = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return taken.buffers()[2] or pa.py_buffer(b""), starts
