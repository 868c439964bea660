"""Vectorised views of Arrow text: words, their 64-bit hashes and shingles, straight from the UTF-8 buffers.

A slice is a run of rows of about SLICE bytes, so the temporaries (8 bytes a byte of text) stay in cache
whatever the batch holds. Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]; none of those bytes
occurs inside a multi-byte character, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.atleast_1d(x)
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
BYTE_LOWER = BYTE[LOWER]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SLICE + 1), base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[k] = p
    if n > 4 * SLICE:  # a very long text: don't keep its table
        out = _POWERS[0], _POWERS[1]
        _POWERS[:] = [p[: SLICE + 1].copy() for p in out]
        return out
    return _POWERS[0], _POWERS[1]


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words; a word ends with its document."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[buf]
    begin, end = np.empty(len(buf), bool), np.empty(len(buf), bool)
    begin[0], end[-1] = solid[0], solid[-1]
    begin[1:] = solid[1:] & ~solid[:-1]
    end[:-1] = solid[:-1] & ~solid[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    begin[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, doc


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hashes of the byte runs, from one prefix sum over the buffer."""
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def rolling_hashes(buf: np.ndarray, width: int, table: np.ndarray = BYTE) -> np.ndarray:
    """Hash of each run of `width` bytes, by its start."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse[:n])


_SEQ = mix(np.arange(11, 31, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words (regardless of documents)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _SEQ[0]
    for k in range(1, width):
        out += words[k : k + n] * _SEQ[k]
    return mix(out)


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each document, and how many each document has.

    counts: words of each document, in order. With fewer words than the width the whole sequence is one shingle.
    """
    first = np.concatenate([[0], np.cumsum(counts)])
    all_windows = window_hashes(words, width)
    doc_of_word = np.repeat(np.arange(len(counts)), counts)
    inside = doc_of_word[: len(all_windows)] == doc_of_word[width - 1 :] if len(all_windows) else np.zeros(0, bool)
    hashes, docs = all_windows[inside], doc_of_word[: len(all_windows)][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for j, d in enumerate(short):
            w = words[first[d] : first[d + 1]]
            extra[j] = mix((w * _SEQ[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))[0]
        hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes):
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        hashes, docs = hashes[keep], docs[keep]
    return hashes, np.bincount(docs, minlength=len(counts)).astype(np.int64)


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of the given lengths."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return total[at[1:]] - total[at[:-1]]


def release() -> None:
    """Give memory that this worker no longer uses back to the system: a worker outlives its task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def forget_encoders() -> None:
    """Drop the pieces that tokens.py remembers in this worker, some hundred bytes each."""
    if tokens := sys.modules.get(f"{__package__}.tokens"):
        tokens.forget()


def batchwise(run, encoders: bool = False):
    """A function of record batches that releases memory at its task's end, and encoders before it starts unless it leaves them."""

    def wrapped(batches):
        if not encoders:
            forget_encoders()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def groupwise(run):
    """A function of one group's table that releases memory at its end."""

    def wrapped(table):
        forget_encoders()
        try:
            return run(table)
        finally:
            release()

    return wrapped
