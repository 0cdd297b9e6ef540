"""Vectorised text kernels over Arrow string buffers.

Every kernel works on a *slice*: the UTF-8 bytes of a few documents laid end to end, with the
offsets where each begins.  Slices hold about ``SLICE_BYTES`` (more only if one document is
longer), so the temporary arrays stay in cache and memory does not follow the batch size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF95)
#: Spans of more bytes are hashed by a digest of the bytes, one call for each.
LONG = 256
#: MASK[n] keeps the first n of 8 little-endian bytes.
MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (wrap-around arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word after A-Z are lower-cased: digits, a-z and everything outside ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (nulls count as empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about SLICE_BYTES."""
    raw, offs = string_buffers(arr)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a little-endian number (zeros behind the end)."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), np.dtype("<u8"), padded, strides=(1,)).copy()


def span_hashes(eight: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, wide: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Two independent 64-bit hashes of byte spans (the second only if ``wide``), wherever they stand.

    Blocks of 8 bytes are chained through a mixer that is one-to-one, so no structure of the bytes
    makes spans collide; both hashes together tell spans apart by 128 bits.
    """
    size = end - start
    n = size.astype(np.uint64)
    a = splitmix(n * PRIME + np.uint64(1))
    b = splitmix(n * _ODD + np.uint64(2)) if wide else None
    v = eight[start] & MASK[np.minimum(size, 8)]
    a = splitmix(a ^ v)
    if wide:
        b = splitmix((b + v) * _ODD)
    at, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        v = eight[start[at] + done] & MASK[np.minimum(size[at] - done, 8)]
        a[at] = splitmix(a[at] ^ v)
        if wide:
            b[at] = splitmix((b[at] + v) * _ODD)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG):
        both = np.frombuffer(hashlib.blake2b(buf[start[i] : end[i]], digest_size=16).digest(), dtype=np.uint64)
        a[i] = both[0]
        if wide:
            b[i] = both[1]
    return a, b


def text_ids(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """128-bit digests of the documents of a slice, as rows of two int64."""
    digests = [hashlib.blake2b(buf[s:e], digest_size=16).digest() for s, e in zip(offs[:-1], offs[1:])]
    return np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)


def ordered(row: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """The order of (row, h), for rows below 2**bits."""
    key = (row.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
    order = np.argsort(key)
    tied = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if (h[order[tied + 1]] < h[order[tied]]).any():
        order = np.lexsort((h, row))
    return order


def word_spans(low: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table`` bytes; none crosses a document's bounds."""
    n = len(low)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = table[low]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = m[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = m[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    after[ends] = False
    return np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, word hashes, first word of each document and the total)."""
    low, start, end, h, _, first = wide_words(buf, offs, False)
    return low, start, end, h, first


def wide_words(buf: np.ndarray, offs: np.ndarray, wide: bool = True):
    """``words`` with a second hash of each word, before the last item."""
    low = LOWER[buf]
    start, end = word_spans(low, offs)
    h, h2 = span_hashes(eights(low), low, start, end, wide)
    return low, start, end, h, h2, np.searchsorted(start, offs)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, one for each start (len(h) - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * PRIME + h[j : j + n]
    return splitmix(acc + np.uint64(k))


def _short(h: np.ndarray, first: np.ndarray, short: np.ndarray, n: int) -> np.ndarray:
    acc = h[first[short]].copy()
    for j in range(1, n):
        acc = acc * PRIME + h[first[short] + j]
    return splitmix(acc + np.uint64(n))


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document row, shingle hash, second hash) of every k-word shingle; a shorter document, unless
    it has no word, is one shingle of all its words."""
    _, _, _, h, h2, first = wide_words(buf, offs)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    w, w2 = window_hash(h, k), window_hash(h2, k)
    ok = doc[: len(w)] == doc[k - 1 : k - 1 + len(w)] if len(w) else np.zeros(0, bool)
    rows, hashes, second = [doc[: len(w)][ok]], [w[ok]], [w2[ok]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            rows.append(short)
            hashes.append(_short(h, first, short, n))
            second.append(_short(h2, first, short, n))
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(second)
