"""Character n-grams of Arrow string columns as numbers, in NumPy.

An n-gram of up to three characters is its code points side by side, exact; a longer one is
a 64-bit hash where 64 bits don't hold it in the alphabet of its slice. Texts are taken in slices of :data:`SLICE` characters, one text at least, so
memory follows the slice and not the batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters looked at together, about.
SLICE = 1 << 18
_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of some texts one after another, and where each text's begin; nulls: empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    sizes = np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
    data, first = texts.buffers()[2], 0
    while first < len(texts):
        last = min(max(int(np.searchsorted(sizes, sizes[first] + SLICE, "right")) - 1, first + 1), len(texts))
        raw = bytes(memoryview(data)[at[first] : at[last]]) if data is not None else b""
        yield np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), sizes[first : last + 1] - sizes[first]
        first = last


def _kept(points: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of some texts that ``keep`` marks."""
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
    return points[keep], before[offsets]


def _marks(test) -> np.ndarray:
    """For each character of the basic plane, whether it is in a class of one pattern; none beyond is."""
    return np.array([bool(test(chr(c))) for c in range(1 << 16)])


_WHITE = _marks(re.compile(r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").match)
_OVERLAP = _marks(re.compile(r"[\u4e00-\u9fffA-Za-z0-9]").match)


def _class(points: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return marks[np.minimum(points, 0xFFFF)]  # U+FFFF is in none


def compacted(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts without white space: what ``text.compact`` leaves."""
    return _kept(points, offsets, ~_class(points, _WHITE))


def overlap_forms(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as ``text.overlap_form`` has them."""
    points, offsets = _kept(points, offsets, _class(points, _OVERLAP))
    return np.where((points >= 65) & (points <= 90), points + np.uint32(32), points), offsets


def _strings(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    raw = points.tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())


def changed(texts: pa.Array, form) -> pa.Array:
    """Each text in a form of this module; nulls: empty."""
    made = [_strings(*form(*x)) for x in slices(texts)]
    return pa.concat_arrays(made) if made else pa.array([], pa.string())


def _dense(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, int, np.ndarray] | None:
    """Runs of ``n`` characters as numbers in the alphabet of these texts, above them the text's number.

    ``(numbers, what a text's number counts, alphabet)``, in the order of the runs; None where 64
    bits don't hold them. One sort of plain numbers brings equal runs of a text together.
    """
    alphabet = np.flatnonzero(np.bincount(points))
    base = len(alphabet) + 1
    if base**n * (len(offsets) - 1) >= 1 << 63:
        return None
    digit = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint64)
    digit[alphabet] = np.arange(1, base, dtype=np.uint64)
    x = digit[points]
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), base**n, alphabet
    h = x[:m].copy()
    for k in range(1, n):
        h *= _U(base)
        h += x[k : m + k]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    h += row[:m] * _U(base**n)
    return h[row[:m] == row[n - 1 :]], base**n, alphabet


def _runs(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run of ``n`` characters inside a text, and the text it is of."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = row[:m] == row[n - 1 :]
    if n <= 3:
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = (h << _U(21)) + points[k : m + k] + _U(1)
    else:
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = _mix(h + (points[k : m + k] + _U(1)) * _U(_ODD[k % 5]))
    return h[whole], row[:m][whole]


def _most(points: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """How often the most frequent run of ``n`` characters stands in each of some texts."""
    best = np.zeros(len(offsets) - 1, np.int32)
    dense = _dense(points, offsets, n)
    if dense is not None:
        key = np.sort(dense[0])
        of = lambda at: (key[at] // _U(dense[1])).astype(np.int64)
    else:
        h, row = _runs(points, offsets, n)
        key = _mix(h + row.astype(np.uint64) * _U(_ODD[0]))
        order = np.argsort(key)
        key = key[order]
        of = lambda at: row[order[at]]
    if len(key):
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(at, len(key)))
        many = count > 1
        np.maximum.at(best, of(at[many]), count[many].astype(np.int32))
    return np.maximum(best, np.diff(offsets) >= n)


def _repeats_span(points: np.ndarray, offsets: np.ndarray, least: int = 3, most: int = 20) -> np.ndarray:
    """Whether a span of ``least`` to ``most`` characters stands three times in a row in each text.

    That is ``2 * p`` places on end that equal the one ``p`` on. Such a run holds two neighbouring
    multiples of ``p`` and all between them, so only those are tried. A number of its own behind
    each text keeps runs inside it.
    """
    n = len(offsets) - 1
    x = np.insert(points, offsets[1:], np.arange(n, dtype=np.uint32) + np.uint32(0x200000)) if n else points
    starts = offsets[:-1] + np.arange(n)
    out = np.zeros(n, bool)
    for p in range(least, most + 1):
        every = x[::p]
        same = every[:-1] == every[1:]
        spot = np.flatnonzero(same[:-1] & same[1:]) * p
        for d in range(1, p):
            spot = spot[x[spot + d] == x[spot + d + p]]
        if not len(spot):
            continue
        run = np.full(len(spot), p + 1)  # the places from spot to spot + p
        for step in (-1, 1):
            edge, live = spot + (p if step > 0 else 0), np.arange(len(spot))
            for _ in range(p - 1):
                edge = edge + step
                ok = (edge >= 0) & (edge + p < len(x))
                ok[ok] = x[edge[ok]] == x[edge[ok] + p]
                edge, live = edge[ok], live[ok]
                if not len(live):
                    break
                run[live] += 1
        hit = spot[run >= 2 * p]
        out[np.searchsorted(starts, hit, "right") - 1] = True
    return out


def broken_rules(points: np.ndarray, offsets: np.ndarray, min_chars: int, max_chars: int, repeats: int) -> np.ndarray:
    """A row a text, a column a quality flag in the order of ``text.FLAGS``; an empty text breaks that rule alone."""
    n = np.diff(offsets)
    rules = (n == 0, n < min_chars, n > max_chars, _most(points, offsets, 5) >= repeats, _repeats_span(points, offsets))
    out = np.stack(rules, 1)
    out[n == 0, 1:] = False
    return out


def flags(texts: pa.Array, names: tuple[str, ...], min_chars: int, max_chars: int, repeats: int, compact: bool) -> pa.Array:
    """Names of the quality rules each text breaks; ``compact``: white space is taken out first."""
    found = [np.zeros((0, len(names)), bool)]
    for x in slices(texts):
        found.append(broken_rules(*(compacted(*x) if compact else x), min_chars, max_chars, repeats))
    found = np.concatenate(found)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(found.sum(1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(names).take(pa.array(np.nonzero(found)[1])))


def unflagged(texts: pa.Array, min_chars: int, max_chars: int, repeats: int) -> tuple[np.ndarray, pa.Array]:
    """Places and compacted texts of those that break no quality rule; only texts inside the band are searched for repeats."""
    places, kept, at = [np.zeros(0, np.int64)], [], 0
    for x in slices(texts):
        points, offsets = compacted(*x)
        n = np.diff(offsets)
        band = (n > 0) & (n >= min_chars) & (n <= max_chars)
        points, n = points[np.repeat(band, n)], n[band]
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        good = ~broken_rules(points, offsets, min_chars, max_chars, repeats).any(1)
        places.append(np.flatnonzero(band)[good] + at)
        points, n = points[np.repeat(good, n)], n[good]
        kept.append(_strings(points, np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))))
        at += len(band)
    return np.concatenate(places), pa.concat_arrays(kept) if kept else pa.array([], pa.string())


def most_frequent_count(texts: pa.Array, n: int, compact: bool = False) -> pa.Array:
    """How often the most frequent run of ``n`` characters stands in each text; without one: 0."""
    out = [_most(*(compacted(*x) if compact else x), n) for x in slices(texts)]
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32())


def sets(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's runs of ``n`` (3 at most) characters, ascending, and the sets' sizes; a shorter text is its own only member."""
    sizes = np.diff(offsets)
    dense = _dense(points, offsets, n)
    if dense is not None:
        key = np.sort(dense[0])
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        row = (key // _U(dense[1])).astype(np.int64)
        key, number = key % _U(dense[1]), np.append(np.uint64(0), dense[2].astype(np.uint64) + _U(1))
        base, h = _U(len(number)), np.zeros(len(key), np.uint64)
        for k in range(n):
            h |= number[(key % base).astype(np.int64)] << _U(21 * k)
            key = key // base
    else:
        h, row = _runs(points, offsets, n)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    for k in range(1, n):
        if (sizes == k).any():  # such a text has no run of n
            few, mine = _runs(points, offsets, k)
            keep = sizes[mine] == k
            at = np.searchsorted(row, mine[keep])
            h, row = np.insert(h, at, few[keep]), np.insert(row, at, mine[keep])
    return h.view(np.int64), np.bincount(row, minlength=len(sizes))


def distinct(texts: pa.Array, n: int) -> pa.Array:
    """The set of each text's runs of ``n`` characters, ascending; a shorter text is its own only member."""
    values, ends, at = [], [np.zeros(1, np.int64)], 0
    for x in slices(texts):
        h, sizes = sets(*x, n)
        values.append(h)
        ends.append(np.cumsum(sizes) + at)
        at = int(ends[-1][-1])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(flat))
