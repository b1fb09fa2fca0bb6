"""Hashes of all words of an Arrow string column, without a Python object per word.

A word is a run of bytes between ASCII white space, with A-Z lower-cased.  Its
hash is a polynomial over random 64-bit values of its bytes, taken from running
sums over slices of the text buffer, then mixed with its length.
"""

from __future__ import annotations

import functools

#: Bytes hashed at once; slices end at white space.
SLICE = 1 << 19


@functools.lru_cache(1)
def _tables():
    import numpy as np

    g = np.random.Generator(np.random.PCG64(20240229))
    values = g.integers(0, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
    values[0x41:0x5B] = values[0x61:0x7B]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    # ASCII other than digits and letters
    plain = np.ones(256, bool)
    plain[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    return values, space, plain


#: Odd; its inverse takes a word's place in the slice out of its hash again.
_BASE = 0x9E3779B97F4A7C6B
_INVERSE = pow(_BASE, -1, 2**64)


@functools.lru_cache(2)
def _powers(n: int):
    import numpy as np

    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out


def mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def buffers(column):
    """``(bounds, data)`` of an Arrow string column: row i is ``data[bounds[i]:bounds[i + 1]]``; null rows are empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    return bounds, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def hashed_words(column, terms: bool = False, spans: bool = False):
    """``(hashes, offsets)``: the words' hashes, those of row i at ``offsets[i]:offsets[i + 1]``; null rows have none.

    With ``terms`` the words are runs of ASCII digits and letters and of bytes
    from 0x80 up instead.  With ``spans`` the words' first and last places in
    the column's data follow."""
    import numpy as np

    values, space, plain = _tables()
    space = plain if terms else space
    n = len(column)
    bounds, data = buffers(column)
    hashes, places, lasts, at, end = [], [], [], int(bounds[0]), int(bounds[-1])
    while at < end:
        size = SLICE
        while True:
            to = min(end, at + size)
            part = data[at:to]
            gap = space[part]
            if to == end:
                break
            last = np.flatnonzero(gap)
            if len(last):
                to = at + int(last[-1]) + 1
                part, gap = data[at:to], gap[:to - at]
                break
            size *= 2
        edges = bounds[np.searchsorted(bounds, at, "right"):np.searchsorted(bounds, to, "left")] - at
        before, after = np.r_[True, gap[:-1]], np.r_[gap[1:], True]
        before[edges] = True
        after[edges - 1] = True
        starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after)
        if len(starts):
            power, inverse = _powers(max(SLICE, 1 << (len(part) - 1).bit_length()))
            terms = values[part] * power[:len(part)]
            sums = np.cumsum(terms)
            h = (sums[ends] - sums[starts] + terms[starts]) * inverse[starts]
            hashes.append(mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            places.append(starts + at)
            lasts.append(ends + at)
        at = to
    if not hashes:
        none = np.empty(0, np.int64)
        return (np.empty(0, np.uint64), np.zeros(n + 1, np.int64)) + (none, none) * spans
    places = np.concatenate(places)
    row = np.searchsorted(bounds, places, "right") - 1
    out = np.concatenate(hashes), np.r_[0, np.cumsum(np.bincount(row, minlength=n)[:n])]
    return (*out, places, np.concatenate(lasts)) if spans else out
