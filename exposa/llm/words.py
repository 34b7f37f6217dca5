"""Words of a whole Arrow string column as numpy arrays.

A column's UTF-8 bytes are classified by byte, so the cost is a few vector
operations a byte and no Python object is made for a word.  Both word rules of
the operators are rules on bytes: every byte of a non-ASCII character is 0x80 or
more, and counts as part of a word.
"""

from __future__ import annotations

import numpy as np

# The word rules' separators, and lower-casing of A-Z alone.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C55          # odd, so it has an inverse modulo 2**64
_CHUNK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z) of an Arrow string column and its n+1 offsets; a null is empty."""
    import pyarrow as pa
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0]:offsets[-1]]
    return LOWER[raw], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int):
    """Runs of rows with about ``most`` bytes each (a longer row is a run of its own)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (n+1)."""
    return runs(rule[data], offsets)


def runs(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``spans``, from whether each byte belongs to a word."""
    before = np.empty_like(word)
    after = np.empty_like(word)
    if len(word):
        before[0] = after[-1] = False
        before[1:] = word[:-1]
        after[:-1] = word[1:]
        inner = offsets[1:-1]
        before[inner[inner < len(word)]] = False
        after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finishing steps of a splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a polynomial in its bytes, from prefix sums, then mixed."""
    global _powers
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + _CHUNK, "right")))
        hi = ends[to - 1]
        need = int(hi - lo) + 1
        if _powers is None or len(_powers[0]) < need:
            size = max(need, _CHUNK + 1)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, down = _powers
        sums = np.zeros(need, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:need - 1], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        if need > 4 * _CHUNK:
            _powers = None          # one giant word: don't keep its tables
        at = to
    return out
