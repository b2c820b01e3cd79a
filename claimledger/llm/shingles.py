"""Word and shingle hashes of whole texts, vectorised.

A text is bytes; a table says which bytes separate words and how the others
fold.  A word's hash is a polynomial of random 64-bit values of its bytes,
taken for all words at once from one running sum; a shingle's hash mixes
its words' hashes.  Hashes are 64 bits wide: equal words always agree, and
different shingles of a pair of texts collide with a chance of about 2^-64
each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1 << 60, 1 << 62)) * 2 + 1
CHUNK = 1 << 19

#: Words between ASCII white space, A-Z folded.
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
PLAIN = (_space, _lower)
#: Words of ASCII letters and digits and of all bytes beyond ASCII, A-Z folded.
_mark = np.ones(256, bool)
_mark[48:58] = _mark[65:91] = _mark[97:123] = _mark[128:] = False
BARE = (_mark, _lower)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            size = max(n, CHUNK + 1)
            step = np.full(size, BASE, np.uint64)
            back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            cls.up, cls.down = np.cumprod(step), np.cumprod(back)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, breaks: np.ndarray, kind=PLAIN):
    """(hashes, first byte, end byte) of the words of ``data``; no word goes
    over one of the positions ``breaks``."""
    separates, fold = kind
    inside = ~separates[data]
    first = inside.copy()
    first[1:] &= separates[data[:-1]]
    some = breaks[breaks < len(data)]
    first[some] |= inside[some]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= separates[data[1:]]
    some = breaks[(breaks > 0) & (breaks <= len(data))] - 1
    last[some] |= inside[some]
    ends = np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # a chunk of whole words, so that the running sum's arrays stay small
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        a, b = starts[at], ends[upto - 1]
        up, down = _Powers.get(b - a + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[fold[data[a:b]]] * up[:b - a])])
        s, e = starts[at:upto] - a, ends[at:upto] - a
        out[at:upto] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = upto
    return out, starts, ends


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def sets(column, k: int, kind=PLAIN) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a text of
    fewer words is one shingle, a text without words has none."""
    data, at = flat(column)
    h, starts, _ = words(data, at, kind)
    doc = np.searchsorted(at, starts, "right") - 1
    count = np.bincount(doc, minlength=len(at) - 1) if len(h) else np.zeros(len(at) - 1, np.int64)
    ends = np.cumsum(count)
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        s += h[i:len(h) - k + 1 + i] * PLACE[i]
    s = mix(s)
    out = []
    for n, e in zip(count.tolist(), ends.tolist()):
        if n >= k:
            out.append(np.unique(s[e - n:e - k + 1]))
        elif n:
            out.append(mix((h[e - n:e] * PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + PLACE[32 + n]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
