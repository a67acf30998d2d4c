"""Vectorised word and shingle hashing of Arrow text batches.

A block of texts is hashed as one byte array: a prefix sum of keyed byte
values times powers of an odd base (mod 2**64) gives every word's hash by
one subtraction, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in blocks of about this many bytes (bounds the memory).
BLOCK = 1 << 18
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the splitmix64 steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK * 2), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= BLOCK * 2:
            cache[base] = have
    return have[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a lower-cased byte array."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    if not blank[-1]:
        edge = np.concatenate((edge, [n]))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(n, _BASE), out=total[1:])
    return start, end, mix((total[end] - total[start]) * _powers(n, _INVERSE)[start])


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; all other bytes as they are."""
    return _LOWER[data]


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each text) of blocks of a text column.

    Null texts come as empty.  A block ends after ``BLOCK`` bytes; a longer
    text stands alone.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        last = min(last, len(column))
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position, or of all if fewer."""
    if len(h) == 0:
        return h
    m = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = np.full(m, width, np.uint64)
    for j in range(width):
        out += h[j : j + m] * _PLACE[j]
    return mix(out)


def rolling_hashes(h: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of the ``k`` words from each position, in time that ``k`` doesn't change; none if fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h), base), out=total[1:])
    m = len(h) - k + 1
    return mix((total[k:] - total[:m]) * _powers(m, pow(base, -1, 2**64)))


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over the ``width`` values from each position."""
    have = 1
    while have < width and len(x):
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def block_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, edges) of blocks of texts, A-Z lower-cased.

    The words of the i-th text of a block stand from ``edges[i]`` to
    ``edges[i + 1]``.
    """
    for first, raw, at in text_blocks(column):
        start, _, h = word_hashes(_separated(raw, at))
        # one blank was put after each text, so offsets move by the row
        yield first, h, np.searchsorted(start, at + np.arange(len(at)))


def document_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text of a column, A-Z lower-cased."""
    for first, h, edges in block_words(column):
        for i in range(len(edges) - 1):
            yield first + i, h[edges[i] : edges[i + 1]]


def block_shingles(h: np.ndarray, edges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of all texts of a block, and how many each text has.

    They are those of ``window_hashes`` of each text, one after the other.
    """
    n = np.diff(edges)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.empty(int(counts.sum()), np.uint64)
    ends = np.cumsum(counts)
    whole = np.repeat(n >= k, counts)
    if whole.any():
        at = np.arange(len(h))
        out[whole] = window_hashes(h, k)[at[at <= np.repeat(edges[1:] - k, n)]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[ends[i] - 1] = window_hashes(h[edges[i] : edges[i + 1]], k)[0]
    return out, counts


def block_sets(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct values, and how many there are."""
    if len(counts) == 1:
        out = np.unique(values)
        return out, np.array([len(out)])
    owner = np.repeat(np.arange(len(counts)), counts)
    bits = np.uint64(max(1, int(len(counts)).bit_length()))
    # texts in the top bits, so that one sort serves them all
    order = np.argsort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (values >> bits))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(counts))


def _separated(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lower-cased texts of a block with a blank after each."""
    out = np.full(len(raw) + len(at) - 1, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at[1:] + np.arange(len(at) - 1)] = False
    out[keep] = _LOWER[raw]
    return out


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct window hashes of one text."""
    return np.unique(window_hashes(h, k))
