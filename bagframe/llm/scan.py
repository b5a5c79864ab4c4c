"""Vectorised passes over UTF-8 text columns in Arrow batches: blocks of whole texts, word hashes, shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def blocks(column, limit: int = BLOCK):
    """(first row, bytes, offsets from 0) of runs of whole texts of up to about `limit` bytes; a longer text is a run of its own."""
    data, offs = utf8(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; substring_hash() takes differences of them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def substring_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray, stem: int = 0):
    """Hashes of the words of lower-cased texts, their document numbers and the n + 1 offsets of each document's words.

    separator: 256 booleans. stem > 0: only so many leading bytes of a word count.
    """
    low = LOWER[data]
    sep = separator[low]
    edge = np.ones(len(low) + 1, bool)
    if len(low):
        edge[1:-1] = sep[:-1]
        cut = offs[offs < len(low)]
        edge[cut] = True
        start = np.flatnonzero(edge[:-1] & ~sep)
        edge[:-1] = sep
        edge[cut] = True
        stops = np.flatnonzero(edge)
        end = stops[np.searchsorted(stops, start, "right")]
    else:
        start = end = np.zeros(0, np.int64)
    if stem:
        end = np.minimum(end, start + stem)
    doc = np.searchsorted(offs, start, "right") - 1
    return substring_hash(prefix(low), start, end), doc, np.searchsorted(start, offs), start


STEPS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words from each word on (n up to 5); the last n - 1 places are left out."""
    m = max(0, len(hashes) - n + 1)
    out = np.full(m, np.uint64(n))
    for k in range(n):
        out += hashes[k : k + m] * STEPS[k]
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, separator: np.ndarray, n: int = 5):
    """For each text, the sorted distinct hashes of its n-word shingles; fewer words: the whole sequence as one; no words: empty."""
    h, _, at, _ = words(data, offs, separator)
    g = grams(h, n)
    for i in range(len(offs) - 1):
        a, b = at[i], at[i + 1]
        yield np.unique(g[a : b - n + 1]) if b - a >= n else grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


#: Word separators: white space of ASCII only.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Everything of ASCII but digits and letters.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
