"""Documents as arrays of word hashes, for operators on word windows."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII letters in lower case and digits stay, other ASCII becomes a space; bytes of other characters stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
REMEMBERED, LONGEST = 500_000, 48  # words a worker remembers, and bytes of the longest one

_seen: dict[bytes, int] = {}


def word_bytes(text: str) -> list[bytes]:
    """The words of a text: runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word; equal words have equal hashes."""
    if len(_seen) > REMEMBERED:
        _seen.clear()
    new = set(words).difference(_seen)
    _seen.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    hashes = np.fromiter(map(_seen.__getitem__, words), np.uint64, len(words))
    for w in new:
        if len(w) > LONGEST:
            del _seen[w]
    return hashes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k consecutive values, with wrap-around arithmetic."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    n = len(values) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[i : i + n]
    return mixed(out)


def selected(values: np.ndarray, window: int) -> np.ndarray:
    """Winnowing: indices of values that are the least of some window of so many consecutive values.

    Every least value of a window is kept, equal ones too, so what is kept of a window depends on the window alone.
    A sequence shorter than the window is one window.
    """
    n, window = len(values), min(window, len(values))
    if n == 0:
        return np.zeros(0, np.int64)
    least = slide(values, window, np.minimum)
    lead = np.concatenate([np.zeros(window - 1, values.dtype), least, np.zeros(window - 1, values.dtype)])
    return np.flatnonzero(slide(lead, window, np.maximum) == values)


def slide(values: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of every window, in log2(window) passes."""
    width = 1
    while 2 * width <= window:
        values = best(values[: len(values) - width], values[width:])
        width *= 2
    rest = window - width
    return best(values[: len(values) - rest], values[rest:]) if rest else values
