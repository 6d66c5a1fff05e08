"""Words of many texts at once, in numpy over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

#: Bytes of text worked on at once; a longer text is a block by itself.
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


LETTERS = scramble(np.arange(1, 257, dtype=np.uint64))  # a random number for each byte value
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words: ASCII digits, a to z, and whatever is not ASCII; lower-case first.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
_powers: list = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i], times BASE**-i, a hash of data[i:j]."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(len(data))[0], dtype=np.uint64, out=h[1:])
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    import pyarrow as pa

    wide = column.type in (pa.large_string(), pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        sizes = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if (sizes != np.diff(offsets)).any():
            keep = np.repeat(np.asarray(column.is_valid()), np.diff(offsets))
            return data[offsets[0] : offsets[-1]][keep], np.concatenate([[0], np.cumsum(sizes)])
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK):
    """(first, last) row ranges of about `size` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray):
    """(start, end, row, hash) of every word; data: bytes with A-Z lower-cased, rows at offsets."""
    inside = IN_WORD[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    end = np.flatnonzero(inside & (~after | cut[1 : n + 1])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    h = prefix_hash(data)
    return start, end, row, scramble((h[end] - h[start]) * powers(n)[1][start]) if len(start) else np.zeros(0, np.uint64)
