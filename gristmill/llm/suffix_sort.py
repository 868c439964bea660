"""Two-stage suffix sorting in numpy, to a bounded depth.

A suffix is of type B if it is smaller than its successor (the suffix that starts one byte later), else of
type A. Only the B suffixes are sorted directly; a scan over the buckets of first bytes, in order, then places
each A suffix: when suffix j has its place and j - 1 is of type A, j - 1 goes to the next free place at the head
of its own bucket. Inside a bucket the A suffixes come before the B suffixes, so a bucket is complete once the
smaller buckets and its own chains of equal bytes have been scanned; each step handles a whole bucket at once.
"""

from __future__ import annotations

import numpy as np


def words8(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one big-endian number; zeros follow the text."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    n, out = len(text), np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= wide[k : k + n] << np.uint64(56 - 8 * k)
    return out


def types_b(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last is larger than the empty one."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    step = np.sign(text[1:].astype(np.int16) - text[:-1])  # of position i against i + 1
    change = np.flatnonzero(step)
    at = np.searchsorted(change, np.arange(n - 1))  # the first differing neighbour from each position on
    some = at < len(change)
    out[:-1][some] = step[change[at[some]]] > 0
    return out


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their suffixes' first `depth` bytes at least; what agrees so far stands together."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    is_b = types_b(text)
    size = np.bincount(text, minlength=256)
    b_size = np.bincount(text[is_b], minlength=256)
    begin = np.concatenate([[0], np.cumsum(size)])
    # Stage one: the B suffixes, by words of 8 bytes.
    b = np.flatnonzero(is_b)
    if len(b):
        word = words8(text)
        keys = []
        for k in range(0, depth, 8):
            at = b + k
            keys.append(np.where(at < n, word[np.minimum(at, n - 1)], np.uint64(0)))
        b = b[np.lexsort(keys[::-1])]
    b_begin = np.concatenate([[0], np.cumsum(b_size)])
    # Stage two: induce the A suffixes.
    out = np.full(n, -1, np.int64)
    free = begin[:-1].copy()  # next place for an A suffix of each bucket

    def place(found: np.ndarray) -> None:
        first = text[found]
        by = np.argsort(first, kind="stable")
        found, first = found[by], first[by]
        count = np.bincount(first, minlength=256)
        rank = np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count)
        out[free[first] + rank] = found
        free[:] += count

    place(np.array([n - 1]))  # before all: the successor of the last suffix is empty
    for c in np.flatnonzero(size):
        done = begin[c]
        while done < free[c]:  # chains of this byte
            now = out[done : free[c]]
            done = free[c]
            before = now[now > 0] - 1
            before = before[(text[before] == c) & ~is_b[before]]
            if len(before):
                place(before)
        out[begin[c + 1] - b_size[c] : begin[c + 1]] = b[b_begin[c] : b_begin[c + 1]]
        full = out[begin[c] : begin[c + 1]]
        before = full[full > 0] - 1
        before = before[(text[before] > c) & ~is_b[before]]
        if len(before):
            place(before)
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each position in `order` with the one before it, `most` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    word, n = words8(text), len(text)
    left, right = order[:-1], order[1:]
    alive, got = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k in range(0, most, 8):
        a, b = left[alive] + k, right[alive] + k
        differ = np.where(a < n, word[np.minimum(a, n - 1)], np.uint64(0)) ^ np.where(b < n, word[np.minimum(b, n - 1)], np.uint64(0))
        same = differ == 0
        lead = np.zeros(int((~same).sum()), np.int64)
        rest = differ[~same]
        for byte in range(7):  # leading equal bytes
            lead += rest < np.uint64(1 << (56 - 8 * byte))
        got[alive[~same]] = k + lead
        got[alive[same]] = k + 8
        alive = alive[same]
        if not len(alive):
            break
    out[1:] = np.minimum(np.minimum(got, most), n - np.maximum(left, right))
    return out
