"""Word hashing over UTF-8 buffers with numpy, and Arrow column access.

Every hash is 64 bits and depends on the bytes of the word only, never on the
process, the batch or the partition, so equal words hash alike everywhere. A word
is read in blocks of eight bytes; each block goes through a bijective mixing step
with a key of its place, so words of one length up to eight bytes never share a
hash, and longer ones only by chance (2 ** -64 a pair): no letter pattern cancels
out as it would in a polynomial.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words are runs of everything but ASCII white space (0x20, 0x09-0x0D).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x80:] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    ALNUM[_a:_b] = True

#: bytes.translate table: A-Z to a-z, every non-word byte to a space.
_t = bytearray(c if ALNUM[c] else 0x20 for c in range(256))
for _c in range(0x41, 0x5B):
    _t[_c] = _c + 32
ALNUM_LOWER = bytes(_t)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_Q = np.uint64(0xD6E8FEB86659FD93)
_SLICE = 1 << 20

U = np.uint64
#: Mask of the first n bytes of a block.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (two rounds of xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.zeros(len(data) + 2, dtype=np.int8)
    m[1:-1] = is_word[data]
    d = np.diff(m)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def words(data: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of one text, as byte offsets.

    Long texts go through in slices cut between words, so the working memory
    is bounded by the slice or by the longest single word."""
    n = len(data)
    if n == 0:
        e = np.empty(0, dtype=np.int64)
        return e, e, np.empty(0, dtype=U)
    starts, ends = _spans(data, is_word)
    if len(starts) == 0:
        return starts, ends, np.empty(0, dtype=U)
    if n <= _SLICE:
        return starts, ends, _hash(_FOLD[data] if lower else data, starts, ends)
    out, i = np.empty(len(starts), dtype=U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = data[lo:hi]
        out[i:j] = _hash(_FOLD[part] if lower else part, starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return starts, ends, out


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    at_byte = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))  # the eight bytes from each one on
    size = ends - starts
    h = mix(at_byte[starts] & _FIRST[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] + 7) >> 3
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        at = np.repeat(starts[long], n) + 8 * place
        block = at_byte[at] & _FIRST[np.minimum(np.repeat(ends[long], n) - at, 8)]
        h[long] = np.add.reduceat(mix(block ^ mix(place.astype(U) * _Q)), first)
    return mix(h + size.astype(U) * _Q)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    g = np.full(n, k, dtype=U)
    for j in range(k):
        g *= _Q
        g += h[j:j + n]
    return mix(g)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct ``k``-word shingle hashes, sorted; a shorter text is one
    shingle, a text without words has none."""
    if len(h) == 0:
        return h
    return np.unique(grams(h, min(k, len(h))))


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the k-grams that are the minimum of some window of ``w``
    consecutive ones (ties: all of them, so the choice depends on content
    only). Fewer than ``w`` k-grams select none."""
    n = len(g)
    if n < w or n == 0:
        return np.empty(0, dtype=np.int64)
    if w == 1:
        return np.arange(n)
    low = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1)
    top = low.copy()
    best = np.zeros(n, dtype=U)
    for j in range(w):  # best[p]: largest window minimum among the windows that hold p
        np.maximum(best[j:j + len(top)], top, out=best[j:j + len(top)])
    return np.flatnonzero(best == g)


def buffers(col: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value of a string column, without copies; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    null = col.is_null().to_numpy(zero_copy_only=False) if col.null_count else None
    for i in range(len(col)):
        yield d[0:0] if null is not None and null[i] else d[o[i]:o[i + 1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
