"""Vectorised word and n-gram hashes over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240501))
#: A random 64-bit value for each byte, after lower-casing A-Z.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes looked at together; no array is longer, but for results.
WINDOW = 1 << 17
_STEP = 1 << 12
_low = np.full(_STEP, _BASE, np.uint64)
_low[0] = 1
_low = np.multiply.accumulate(_low)


def _power(at: np.ndarray) -> np.ndarray:
    """The base to each power, modulo 2**64, by the low and the high part of the power."""
    out = _low[at & (_STEP - 1)]
    most = int(at.max(initial=0)) // _STEP
    if most:
        high = np.full(most + 1, pow(int(_BASE), _STEP, 1 << 64), np.uint64)
        high[0] = 1
        out = out * np.multiply.accumulate(high)[at // _STEP]
    return out


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of code points of each segment, white space left out, A-Z as a-z.

    ``ends`` rise to ``len(data)``, each the byte after its segment. A segment may be of any
    length: it is summed up window by window.
    """
    total, chars, solid_bytes = (np.zeros(len(ends), t) for t in (np.uint64, np.int64, np.int64))
    for w in range(0, len(data), WINDOW):
        d = data[w : w + WINDOW]
        i, j = np.searchsorted(ends, [w, w + len(d) - 1], "right")
        cuts = np.maximum(np.concatenate(([0], ends[i:j] - w)), 0)
        solid = ~_SPACE[d]
        count = np.cumsum(solid)
        before = count - solid
        since = before[cuts] - np.concatenate((solid_bytes[i : i + 1], np.zeros(j - i, np.int64)))
        at = before - np.repeat(since, np.diff(np.append(cuts, len(d))))
        value = np.where(solid, _BYTE[d] * _power(np.maximum(at, 0)), U(0))
        total[i : j + 1] += np.add.reduceat(value, cuts)
        solid_bytes[i : j + 1] += np.add.reduceat(solid, cuts, dtype=np.int64)
        chars[i : j + 1] += np.add.reduceat(solid & ((d & 0xC0) != 0x80), cuts, dtype=np.int64)
    return mix(total + solid_bytes.astype(np.uint64) * U(0xD1B54A32D192ED03)), chars



def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each row, and for each row the index of its first word."""
    return placed_words(data, offsets)[:2]


def placed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`words`, with each word's first byte and the byte after its last.

    ``data`` holds the rows' bytes one after another; a word never spans two rows. A-Z
    count as a-z; words are runs of bytes other than ASCII white space.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    start, end = word_edges(data, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    # a segment is a word and the white space behind it, and before the first
    h = segments(data, np.append(start[1:], n))[0]
    return h, np.searchsorted(start, offsets), start, end


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each row, sorted, and where each row's begin.

    A row with fewer than ``k`` words has one shingle, its whole sequence; a row without
    words has none.
    """
    rows = len(first) - 1
    n_words = np.diff(first)
    row = np.repeat(np.arange(rows), n_words)
    m = len(hashes)
    out, owner = [], []
    if m >= k:
        s = np.zeros(m - k + 1, np.uint64)
        for j in range(k):
            s += mix(hashes[j : m - k + 1 + j] + U((j + 1) * int(_BASE) % (1 << 64)))
        whole = row[: m - k + 1] == row[k - 1 :]
        out.append(mix(s[whole]))
        owner.append(row[: m - k + 1][whole])
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        s = n_words[short].astype(np.uint64) * U(0xA0761D6478BD642F)
        for j in range(k - 1):
            has = n_words[short] > j
            s[has] += mix(hashes[first[short[has]] + j] + U((j + 1) * int(_BASE) % (1 << 64)))
        out.append(mix(s))
        owner.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h, r = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(rows + 1))
