"""A run-length index over a collection of strings.

The suffixes of all strings are ordered (each ends at its string's end; equal ones stand in text
order), which gives the Burrows-Wheeler transform.  What is kept are its runs, the text positions of
each run's first and last suffix, and for each run's first suffix the one before it in the order with
the length they share (the phi map).  The suffix order itself is dropped, so a built index is as large
as the number of runs, which in a repetitive collection is far below its bytes.

Between two neighbouring suffixes in one run, stepping one byte to the right keeps them neighbours and
shortens what they share by one, so the phi map at the run heads tells every position's neighbour and
matching statistic; both are streamed from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .bytesops import eights


class RunLengthIndex:
    """``text``: bytes of all strings; ``offsets``: where each begins, and the total."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray):
        self.n = len(text)
        size = np.diff(offsets)
        end = np.repeat(offsets[1:], size)
        order = _suffix_order(text, end, int(size.max()) if len(size) else 0)
        before = np.zeros(self.n, dtype=np.int16)
        before[1:] = text[:-1].astype(np.int16) + 1
        before[offsets[:-1][size > 0]] = 0
        bwt = before[order]
        head = np.ones(self.n, dtype=bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
        self.run_start = np.flatnonzero(head)
        self.run_char = bwt[self.run_start]
        self.first_sample = order[self.run_start]
        self.last_sample = order[np.r_[self.run_start[1:], self.n] - 1] if self.n else order
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])
        self.last_bytes = np.bincount(text[offsets[1:][size > 0] - 1], minlength=256)
        by_text = np.argsort(self.first_sample)
        common = np.zeros(len(by_text), dtype=np.int64)
        to = np.full(len(by_text), -1, dtype=np.int64)
        if self.n:
            to[1:] = self.last_sample[:-1]
            common[1:] = _common(eights(text), end, self.first_sample[1:], to[1:])
        self.phi_at, self.phi_to, self.phi_common = self.first_sample[by_text], to[by_text], common[by_text]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def matching_statistics(self, block: int = 1 << 20) -> Iterator[np.ndarray]:
        """For each text position, how far its suffix agrees with the one before it in order, in blocks."""
        for lo in range(0, self.n, block):
            p = np.arange(lo, min(lo + block, self.n))
            k = np.searchsorted(self.phi_at, p, side="right") - 1
            yield np.maximum(self.phi_common[k] - (p - self.phi_at[k]), 0)

    def neighbours(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Text positions whose next ``length`` bytes also start at the neighbour before them in the
        suffix order, and that neighbour's position."""
        reach = np.diff(np.r_[self.phi_at, self.n])
        n = np.clip(np.minimum(self.phi_common - length + 1, reach), 0, None)
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        return np.repeat(self.phi_at, n) + step, np.repeat(self.phi_to, n) + step

    def earliest(self, length: int, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Text positions whose ``length`` bytes stand at several ones, and the smallest ``place``
        (else text position) among those.

        The neighbours chain all positions of equal bytes to the first of them in the suffix order.
        """
        at, to = self.neighbours(length)
        if not len(at):
            return at, at
        up = np.arange(self.n)
        up[at] = to
        while True:
            jump = up[up]
            if np.array_equal(jump, up):
                break
            up = jump
        member = np.zeros(self.n, dtype=bool)
        member[at] = member[to] = True
        at = np.flatnonzero(member)
        rank = at if place is None else place[at]
        best = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(best, up[at], rank)
        return at, best[up[at]]

    def repeats(self, length: int, place: np.ndarray | None = None) -> np.ndarray:
        """Text positions whose next ``length`` bytes also start at an earlier position, or at one of a
        smaller ``place``."""
        at, best = self.earliest(length, place)
        return at[(at if place is None else place[at]) != best]

    def count(self, pattern: bytes) -> int:
        """Occurrences of a pattern (not empty), by backward search over the runs.

        A suffix that begins with c stands after all that begin with a smaller byte, so the row of
        c + suffix is the number of smaller bytes plus the rank of c in the transform.
        """
        length = np.diff(np.r_[self.run_start, self.n])
        lo, hi = int(self.below[pattern[-1]]), int(self.below[pattern[-1] + 1])
        for c in reversed(pattern[:-1]):
            mine = np.flatnonzero(self.run_char == c + 1)
            start, before = self.run_start[mine], np.concatenate([[0], np.cumsum(length[mine])])
            ranks = []
            for i in (lo, hi):
                k = int(np.searchsorted(start, i))
                ranks.append(int(before[k]) - (max(0, int(start[k - 1] + length[mine[k - 1]]) - i) if k else 0))
            # A string's last byte has no suffix after it; those rows stand first among c's.
            lo, hi = (int(self.below[c] + self.last_bytes[c]) + r for r in ranks)
            if lo >= hi:
                return 0
        return hi - lo


def _suffix_order(text: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Prefix doubling.  A short text's ranks and positions share one word, so each round sorts
    plain numbers; a text of more than 2**21 bytes sorts positions by key."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = n.bit_length()
    packed = 3 * bits <= 64
    used = np.flatnonzero(np.bincount(text, minlength=256))
    code = np.zeros(256, dtype=np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    symbol, width = code[text], int(len(used)).bit_length()
    k = max(1, ((64 - bits) if packed else 63) // width)
    at = np.arange(n)
    left = end - at
    key = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        key <<= np.uint64(width)
        if j < n:
            key[: n - j] |= np.where(left[: n - j] > j, symbol[j:], np.uint64(0))
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    place = at.astype(np.uint64)
    while True:
        if packed:
            s = np.sort((key << shift) | place)
            order = (s & mask).astype(np.int64)
            s >>= shift
        else:
            order = np.argsort(key, kind="stable")
            s = key[order]
        new = np.r_[True, s[1:] != s[:-1]]
        if k >= longest or new.all():
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = rank << shift
        if k < n:
            key[: n - k] |= np.where(left[: n - k] > k, rank[k:], np.uint64(0))
        k *= 2


def _common(eight: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at x and y share, compared 8 at a time."""
    limit = np.minimum(end[x] - x, end[y] - y)
    out, live, done = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), 0
    while len(live):
        differ = eight[x[live] + done] ^ eight[y[live] + done]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
        same = np.minimum(same, limit[live] - done)
        out[live] += same
        done += 8
        live = live[(same == 8) & (limit[live] > done)]
    return out
