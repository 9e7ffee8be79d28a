"""Vectorised words, shingles and rolling hashes over Arrow string columns.

Words and shingles are hashed from the UTF-8 buffer of a column, many documents
at a time, so no Python object is made per word. All hashes are 64 bits: a
polynomial over a ring of odd base, then a bijective mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _GRAM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Word characters as bytes. Both classes break at ASCII bytes only, so they never cut a UTF-8 sequence.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n at least."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables[base] = (out[0], out[1])
    return _tables[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the SplitMix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def groups(col: pa.Array, max_bytes: int = 1 << 18):
    """(first row, last row + 1, bytes, offsets) for runs of rows of about ``max_bytes``; null texts are empty."""
    col = col.fill_null("").cast(pa.large_string())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray):
    """Start and end of each word, and the index of each document's first word (one more entry than documents)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    is_word = kind[data]
    edge = offs[:-1][offs[:-1] < len(data)]
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    before[edge] = False
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    return starts, np.flatnonzero(is_word & ~after) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, segment: int = 1 << 22) -> np.ndarray:
    """A 64-bit hash of each word. Works in segments, so that a very long text needs no larger tables."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + segment, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(_BASE, b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum((data[a:b].astype(U) + U(1)) * power[:b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U))
        i = j
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes; entry i is that of words i to i + k - 1, over document borders too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    power, inverse = _powers(_GRAM_BASE, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * power[:len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n] + U(k))


def shingle_sets(col: pa.Array, k: int, kind: np.ndarray, fold: bool = True):
    """For each row: its sorted distinct k-word shingles; with fewer words the whole sequence as one, without words none."""
    for _, _, data, offs in groups(col):
        data = lower(data) if fold else data
        starts, ends, first = words(data, offs, kind)
        hashes = word_hashes(data, starts, ends)
        every = grams(hashes, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(every[a:b - k + 1])
            elif b > a:
                yield grams(hashes[a:b], b - a)
            else:
                yield np.zeros(0, U)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:len(x) - w + 1], m[w - span:w - span + len(x) - w + 1]) if span < w else m


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    """Rows of numbers as one Arrow list column."""
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(kind) if kind is np.int64 and flat.dtype.itemsize == 8 else flat.astype(kind)))
