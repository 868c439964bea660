"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

Spark counts every training token (by 64-bit hash), every pair of neighbouring classes, and after which classes each
word stands. The most frequent tokens are classes of their own, CLASSES with one for each suffix class; all other
words share a class with words of the same ending. Two log-bilinear levels:

1. Class after class: score = (r[previous] C) . q[next] + b[next].
2. Word in its class: every word that occurs LEAST times or more, so a vocabulary that grows with the corpus, has a
   vector of its own: p(word | class, previous) is its smoothed share times exp((r[previous] C) . q[word] + b[word]),
   normalised. Rarer words have their share.

Both minimise the noise-contrastive loss over all counts; its expectation over the noise is taken exactly instead of
sampled. The first is some products of matrices of CLASSES squared in numpy; in the second each word's vector is a
problem of its own, solved by the tasks, a block of words at a time, whose batched products also give the words' part of
the normaliser of their class after each class. The sum over all known words and one unknown word a suffix class is 1
after any context.

Counts of the FREQUENT most frequent tokens and vectors of the NEAR most frequent are broadcast. All other tokens go to their counts by a plain
equi-join on the hash, of a row per document and distinct rare word, and to their vectors by one of a row an occurrence
(a bitmap of fixed size keeps most words without a vector away), so no key is hot.

Defined results: a null text is empty and has its end token alone; a null id is held out; rows repeated with the
same id are scored each; without training documents N and V are 0 and the model is uniform; an empty table
gives no rows; columns besides the two named are not read; a very long text is scored whole, by the task that reads it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BYTE_LOWER, LOWER, batchwise, groupwise, mix, span_hashes, sums_by, text_slices, word_bounds
from .shared import Workspace

#: Classes of the model, those of suffixes among them; the tokens whose counts, and those whose vectors, are broadcast.
CLASSES, SUFFIXES, FREQUENT, NEAR = 1024, 224, 1 << 16, 1 << 14
DIMENSION, NOISE, STEPS, RATE = 48, 20, 250, 0.05
#: Occurrences from which a word has a vector, words solved at once, their steps, and the weight of their prior.
LEAST, BLOCK, SOLVES, PRIOR = 32, 1024, 12, 4.0
#: Words of a block whose matrices are in cache together.
TILE = 128
#: Bits of a hash by which the vocabulary is looked up.
PREFIX = 18
#: Bits of the bitmap of words with vectors.
BITMAP = 1 << 24
END_TOKEN = int(mix(np.array([0x454E44], np.uint64)).astype(np.int64)[0])
#: Class numbers: the end token, then suffixes, then frequent words.
END, FIRST_SUFFIX, FIRST_WORD = 0, 1, 1 + SUFFIXES
HELD = 2_000_000


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, suffix classes and document numbers of the tokens of a slice, without the ends."""
    starts, ends, doc = word_bounds(buf, offs)
    h = span_hashes(buf, starts, ends, BYTE_LOWER).view(np.int64)
    code = np.zeros(len(ends), np.uint64)  # the last three bytes, or as many as there are
    for k in (1, 2, 3):
        part = LOWER[buf[np.maximum(ends - k, 0)]].astype(np.uint64) << np.uint64(8 * k - 8)
        code |= np.where(ends - starts >= k, part, np.uint64(0))
    suffix = mix(code) % np.uint64(SUFFIXES)
    return h, suffix.astype(np.int16) + np.int16(FIRST_SUFFIX), doc


def with_ends(values: np.ndarray, doc: np.ndarray, n: int, end) -> tuple[np.ndarray, np.ndarray]:
    """The documents' token values, each document followed by its end; and the tokens of each document."""
    counts = np.bincount(doc, minlength=n) + 1
    out = np.full(len(values) + n, end, values.dtype)
    out[np.arange(len(values)) + doc] = values
    return out, counts


def _count_words(batches):
    """Partial counts: (h, suffix class, count); one row a distinct token and task."""
    schema = pa.schema([("h", pa.int64()), ("suffix", pa.int16()), ("n", pa.int64())])
    parts, size = [], 0

    def rows(parts):
        h, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(at, n, len(h)).astype(np.int64)
        return h, s[first], n

    for batch in batches:
        for first, last, buf, offs in text_slices(batch.column(0)):
            h, s, _ = words_of(buf, offs)
            h, s = np.append(h, np.int64(END_TOKEN)), np.append(s, np.int16(END))
            u, i, n = np.unique(h, return_index=True, return_counts=True)
            n[np.searchsorted(u, END_TOKEN)] = last - first
            parts.append((u, s[i], n))
            size += len(u)
        if size > 2 * HELD:
            parts = [rows(parts)]
            size = len(parts[0][0])
            if size > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], schema=schema)
                parts, size = [], 0
    if parts:
        h, s, n = rows(parts)
        for k in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in (h, s, n)], schema=schema)


class Vocabulary:
    """Sorted hashes of the frequent tokens, their counts, and the classes of those that have their own."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        rank = np.lexsort((h, -n))[:FREQUENT]
        h, n = h[rank], n[rank]
        own = np.full(len(h), -1, np.int16)
        room = CLASSES - FIRST_WORD
        plain = np.flatnonzero(h != END_TOKEN)[:room]
        own[plain] = FIRST_WORD + np.arange(len(plain))
        own[h == END_TOKEN] = END
        by = np.argsort(h)
        self.h, self.n, self.own = h[by], n[by], own[by]
        self.may = (self.own < 0) & (self.n >= LEAST)
        self.bits = np.zeros(0, np.uint8)  # of the other words that may have a vector
        self.vectors, self.vector_of = np.zeros((0, DIMENSION + 1), np.float32), np.full(len(h), -1)
        self.first = None  # the place of the first hash with each prefix; a worker makes its own

    def add_vectors(self, h: np.ndarray, vectors: np.ndarray) -> None:
        self.vectors, at = vectors, np.searchsorted(self.h, h)
        self.vector_of[at] = np.arange(len(h))

    def far(self, h: np.ndarray) -> np.ndarray:
        """Which of the tokens that are not here may have a vector."""
        if not len(self.bits):
            return np.zeros(len(h), bool)
        at = h & (BITMAP - 1)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    def asks(self, h: np.ndarray, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Which tokens may have a vector that is not here."""
        return np.where(hit, self.may[at] & (self.vector_of[at] < 0) if len(self.h) else False, self.far(h))

    def able(self, h: np.ndarray, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Which tokens may have a vector."""
        return np.where(hit, self.may[at] if len(self.h) else hit, self.far(h))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if self.first is None:
            self.first = np.searchsorted(self.h, np.arange(-(1 << PREFIX - 1), 1 << PREFIX - 1) << 64 - PREFIX)
        last = len(self.h) - 1
        at = np.minimum(self.first[(h >> 64 - PREFIX) + (1 << PREFIX - 1)], last)
        behind = np.flatnonzero((self.h[at] < h) & (at < last))
        while len(behind):
            at[behind] += 1
            behind = behind[(self.h[at[behind]] < h[behind]) & (at[behind] < last)]
        return at, self.h[at] == h

    def classes(self, at: np.ndarray, hit: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return suffix
        own = self.own[at]
        return np.where(hit & (own >= 0), own, suffix)


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive runs of the values as bytes, a row each."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _group_pairs(at, h, previous, suffix):
    """Of tokens that may have a vector: each distinct word's number, suffix class and run of pairs, and each pair's class before and count.

    at: the tokens' places in the vocabulary, or -1; h: the hashes of those without a place, numbered after the others.
    """
    far, inside = np.unique(h, return_inverse=True)
    most = int(at.max(initial=-1)) + 1
    word = at.astype(np.int64)
    word[at < 0] = most + inside
    group = np.zeros(most + len(far), np.int64)
    group[word] = suffix
    key, m = np.unique(word * CLASSES + previous, return_counts=True)
    first = np.flatnonzero(np.diff(key // CLASSES, prepend=-1))
    runs, word = np.diff(np.append(first, len(key))), key[first] // CLASSES
    return most, far, word, group[word], first, runs, (key % CLASSES).astype(np.int16), m.astype(np.int32)


def _count_pairs(state):
    """Counts of each task: class after class (n), and a row a block of words of a class: the block's words that may have a vector, with the classes before them; a document begins after an end."""
    blob = pa.binary()
    schema = pa.schema([("previous", pa.int16()), ("next", pa.int16()), ("n", pa.int64()), ("suffix", pa.int16()), ("salt", pa.int32()), ("words", blob), ("runs", blob), ("before", blob), ("times", blob)])

    def emit(v, salts, held):
        at, previous, suffix = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
        most, far, word, suffix, first, runs, before, times = _group_pairs(at, np.concatenate([x[3] for x in held]), previous, suffix)
        h = np.where(word < most, v.h[np.minimum(word, len(v.h) - 1)] if len(v.h) else 0, far[np.maximum(word - most, 0)] if len(far) else 0)
        salt = h % salts[suffix]
        by = np.lexsort((h, salt, suffix))
        suffix, salt, runs = suffix[by], salt[by], runs[by]
        ends = np.append(0, np.cumsum(runs))
        pairs = np.repeat(first[by] - ends[:-1], runs) + np.arange(ends[-1])
        edge = np.append(np.flatnonzero((np.diff(suffix, prepend=-1) != 0) | (np.diff(salt, prepend=-1) != 0)), len(by))
        columns = [pa.array(suffix[edge[:-1]].astype(np.int16)), pa.array(salt[edge[:-1]].astype(np.int32)), _blobs(h[by], edge), _blobs(runs.astype(np.int32), edge), _blobs(before[pairs], ends[edge]), _blobs(times[pairs], ends[edge])]
        none = [pa.nulls(len(edge) - 1, t) for t in (pa.int16(), pa.int16(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, *columns], schema=schema)

    def run(batches):
        v, salts = state.value
        table, held, size = np.zeros(CLASSES * CLASSES, np.int64), [], 0
        for batch in batches:
            for first, last, buf, offs in text_slices(batch.column(0)):
                words, suffix, doc = words_of(buf, offs)
                h, _ = with_ends(words, doc, last - first, np.int64(END_TOKEN))
                suffix, _ = with_ends(suffix, doc, last - first, np.int16(END))
                at, hit = v.find(h)
                c = v.classes(at, hit, suffix)
                previous = np.concatenate([[END], c[:-1]])
                table += np.bincount(previous.astype(np.int64) * CLASSES + c, minlength=len(table))
                able = np.flatnonzero(v.able(h, at, hit))
                held.append((np.where(hit[able], at[able], -1).astype(np.int32), previous[able].astype(np.int16), suffix[able], h[able][~hit[able]]))
                size += len(able)
                if size > HELD:
                    yield from emit(v, salts, held)
                    held, size = [], 0
        if size:
            yield from emit(v, salts, held)
        some = np.flatnonzero(table)
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((part // CLASSES).astype(np.int16)), pa.array((part % CLASSES).astype(np.int16)), pa.array(table[part]), *(pa.nulls(len(part), f.type) for f in list(schema)[3:])], schema=schema)

    return run


def _bitmap(batches):
    """The words of a task, as bits."""
    bits = np.zeros(BITMAP, bool)
    for batch in batches:
        bits[batch.column(0).to_numpy() & (BITMAP - 1)] = True
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])


def _solve_words(state):
    """One block of words of a class, from the tasks' rows words, runs, before, times: each word's vector, and in a row without word the sums over them by previous class."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("suffix", pa.int16()), ("salt", pa.int32()), ("vector", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        contexts, pairs, mass = state.value
        suffix, salt = table.column("suffix")[0].as_py(), table.column("salt")[0].as_py()
        h, runs, before, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("words", np.int64), ("runs", np.int32), ("before", np.int16), ("times", np.int32)))
        h, at = np.unique(h, return_inverse=True)
        at = np.repeat(at, runs)
        n = np.bincount(at, times, len(h)).astype(np.int64)  # each occurrence has a class before it
        kept = n >= LEAST  # the bitmap lets others through
        mine = kept[at]
        at, before, times = (np.cumsum(kept) - 1)[at[mine]], before[mine], times[mine]
        h, n = h[kept], n[kept]
        vectors, sums = np.empty((len(h), contexts.shape[1]), np.float32), np.zeros(CLASSES)
        for k in range(0, len(h), BLOCK):
            own, mine = slice(k, k + BLOCK), (at >= k) & (at < k + BLOCK)
            size = len(h[own])
            data = np.bincount((at[mine] - k) * CLASSES + before[mine], times[mine], size * CLASSES).astype(np.float32).reshape(size, CLASSES)
            vectors[own] = train_words(data, (n[own] + 0.1) / mass[suffix], pairs[:, suffix], contexts)
            sums += (n[own] + 0.1) @ np.expm1(vectors[own].astype(np.float64) @ contexts.T.astype(np.float64))
        made = [x.tobytes() for x in vectors] + [sums.tobytes()]
        columns = [pa.array([*h.tolist(), None], pa.int64()), pa.array([*n.tolist(), 0]), pa.array([suffix] * len(made), pa.int16()), pa.array([salt] * len(made), pa.int32()), pa.array(made, pa.binary())]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _total(table: pa.Table) -> pa.Table:
    """The sums of all blocks of a class."""
    table = table.sort_by("salt")
    total = np.sum([np.frombuffer(x) for x in table.column("vector").to_pylist()], 0)
    return pa.table({"suffix": table.column("suffix")[:1], "total": pa.array([total.tobytes()], pa.binary())})


def _far_words(state):
    """(doc_row, extra) from rows doc_row, previous, vector."""

    def run(batches):
        contexts = state.value
        for batch in batches:
            rows, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            vectors = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, contexts.shape[1])
            dots = np.einsum("ij,ij->i", vectors.astype(np.float64), contexts[batch.column(1).to_numpy()].astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, dots, len(rows)) / np.log(10))], names=["doc_row", "extra"])

    return run


def train_log_bilinear(pairs: np.ndarray, dimension: int = DIMENSION, noise: int = NOISE, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Normalised natural-log probabilities [previous, next] from a matrix of pair counts, and the context vectors.

    Noise-contrastive estimation with `noise` samples a pair from the smoothed unigram, in expectation; Adam.
    """
    k, rng = len(pairs), np.random.default_rng(seed)
    if not pairs.sum():
        return np.full((k, k), -np.log(k), np.float32), np.zeros((k, dimension), np.float32)
    row = pairs.sum(1, keepdims=True).astype(np.float32)
    unigram = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * k)
    data, total = pairs.astype(np.float32), float(pairs.sum())
    log_noise = np.log(noise * unigram).astype(np.float32)
    weight = (row * (noise * unigram)).astype(np.float32)  # expected noise draws a cell
    w = [rng.normal(0, 0.1, (k, dimension)), np.eye(dimension) + rng.normal(0, 0.01, (dimension, dimension)), rng.normal(0, 0.1, (k, dimension)), np.log(unigram)]
    w = [x.astype(np.float32) for x in w]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    # Rows and columns are scaled by their own weight, so that rare classes learn as fast as frequent ones.
    row_scale, column_scale = 1 / (row + 1), 1 / (data.sum(0)[:, None] + 1)
    for step in range(1, steps + 1):
        r, c, q, b = w
        context = r @ c
        with np.errstate(over="ignore"):
            sure = 1 / (1 + np.exp(log_noise - context @ q.T - b))  # that a cell is data
        g = data * (1 - sure) - weight * sure
        left = g @ q
        grads = [(left @ c.T) * row_scale, (r.T @ left) / total, (g.T @ context) * column_scale, g.sum(0) * column_scale[:, 0]]
        speed = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for x, grad, m, v in zip(w, grads, first, second, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    r, c, q, b = w
    scores = (r @ c) @ q.T + b
    scores -= scores.max(1, keepdims=True)
    return (scores - np.log(np.exp(scores).sum(1, keepdims=True))).astype(np.float32), r @ c


def train_words(data: np.ndarray, share: np.ndarray, after: np.ndarray, contexts: np.ndarray, noise: int = NOISE, steps: int = SOLVES, prior: float = PRIOR) -> np.ndarray:
    """Vectors (the last number of each its bias) of words of one class: a row each.

    data[word, previous]: counts; share: the words' shares of the class, which the noise draws by; after[previous]: how
    often the class stands after each; contexts: a row for each previous class, ending in 1. Each is a step of
    Newton's method with the curvature's diagonal, in the basis in which the contexts are uncorrelated.
    """
    spread = (contexts * after[:, None]).T @ contexts / max(after.sum(), 1)
    basis = np.linalg.eigh(spread.astype(np.float64))[1].astype(np.float32)
    x, out = contexts @ basis, np.empty((len(data), contexts.shape[1]), np.float32)
    squares, across = x * x, np.ascontiguousarray(x.T)
    for first in range(0, len(data), TILE):
        own = data[first : first + TILE]
        seen, q = own @ x, np.zeros((len(own), x.shape[1]), np.float32)
        both = own + (noise * share[first : first + TILE, None] * after[None]).astype(np.float32)  # with the expected noise draws
        below = np.full_like(own, np.log(noise))  # minus the score
        odds, pull = np.empty_like(own), np.empty_like(own)
        for _ in range(steps):
            with np.errstate(over="ignore"):
                np.exp(below, out=odds)
            odds += 1
            np.divide(both, odds, out=pull)  # 1 / odds: that a cell is data
            slope = seen - pull @ x - prior * q
            np.divide(pull, odds, out=odds)
            pull -= odds
            step = slope / (pull @ squares + prior)
            change = step @ across
            scale = 0.7 / np.maximum(np.maximum(change.max(1, keepdims=True), -change.min(1, keepdims=True)), 1)  # no score moves by more than that
            q += scale * step
            change *= scale
            below -= change
        out[first : first + TILE] = q
    return out @ basis.T


def _score(state):
    """Per document what needs no join, and its rare words with how often each occurs."""
    schema = pa.schema([("doc_row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("far", pa.list_(pa.int64())), ("previous", pa.list_(pa.int16()))])

    def run(batches):
        v, table, in_class, contexts = state.value
        table, row = table.astype(np.float64), TaskContext.get().partitionId() << 40
        logs = np.log10(v.n + 0.1)
        for batch in batches:
            ids = batch.column(0)
            for first, last, buf, offs in text_slices(batch.column(1)):
                n = last - first
                words, suffix, doc = words_of(buf, offs)
                h, counts = with_ends(words, doc, n, np.int64(END_TOKEN))
                suffix, _ = with_ends(suffix, doc, n, np.int16(END))
                doc = np.repeat(np.arange(n), counts)
                at, hit = v.find(h)
                c = v.classes(at, hit, suffix)
                previous = np.concatenate([[END], c[:-1]])
                log_count = np.where(hit, logs[at] if len(logs) else 0.0, 0.0)
                own = hit & (v.own[at] >= 0) if len(logs) else hit
                score = table[previous, c] / np.log(10)
                other = np.flatnonzero(~own)  # these share their class
                score[other] += log_count[other] - in_class[previous[other], c[other]]
                if len(v.vectors):
                    mine = np.flatnonzero(hit & (v.vector_of[at] >= 0))
                    score[mine] += np.einsum("ij,ij->i", v.vectors[v.vector_of[at[mine]]], contexts[previous[mine]]) / np.log(10)
                rare = np.flatnonzero(~hit)
                by = rare[np.lexsort((h[rare], doc[rare]))]
                new = np.ones(len(by), bool)
                new[1:] = (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(by))).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[by][start], minlength=n))]).astype(np.int32)
                arrays = [np.arange(row, row + n), ids[first:last], counts, sums_by(hit.astype(np.int64), counts), sums_by(log_count, counts), sums_by(score, counts)]
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (h[by][start], times)]
                far = np.flatnonzero(v.asks(h, at, hit))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[far], minlength=n))]).astype(np.int32)
                lists += [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (h[far], previous[far].astype(np.int16))]
                row += n
                yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x) for x in arrays), *lists], schema=schema)

    return run


def train_model(work: Workspace, train: DataFrame, counts: DataFrame, total: int) -> tuple[tuple, DataFrame]:
    """What scoring broadcasts: vocabulary, class table, log10 normalisers [previous, class], contexts; and the table of the other words' vectors."""
    spark = work.spark
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()  # FREQUENT rows
    v = Vocabulary(top.column("h").to_numpy(), top.column("n").to_numpy())

    def among(most: int):
        """Whether a word is among the `most` most frequent."""
        n, h = (top.column(c)[min(most, len(top)) - 1].as_py() for c in ("n", "h")) if len(top) else (0, 0)
        return (F.col("n") > n) | (F.col("n") == n) & (F.col("h") <= h)

    near = among(NEAR)
    maps = counts.where((F.col("n") >= LEAST) & ~among(FREQUENT)).select("h").coalesce(8).mapInArrow(_bitmap, "bits binary").collect()  # 8 rows at most
    if maps:
        v.bits = np.bitwise_or.reduce([np.frombuffer(r.bits, np.uint8) for r in maps])

    # A class's words are dealt over blocks by their hash.
    salts = np.ones(CLASSES, np.int64)
    for r in counts.where(F.col("n") >= LEAST).groupBy("suffix").agg(F.count("*").alias("words")).collect():  # a row a suffix class
        salts[r.suffix] = r.words // BLOCK + 1

    pairs = np.zeros((CLASSES, CLASSES), np.int64)
    fields = "previous short, next short, n long, suffix short, salt int, words binary, runs binary, before binary, times binary"
    counted = work.write(train.mapInArrow(batchwise(_count_pairs(spark.sparkContext.broadcast((v, salts)))), fields), "pairs")
    table = counted.where("suffix is null").groupBy("previous", "next").agg(F.sum("n").alias("n")).toArrow()  # CLASSES ** 2 rows at most
    pairs[table.column("previous").to_numpy(), table.column("next").to_numpy()] = table.column("n").to_numpy()
    log_p, contexts = train_log_bilinear(pairs)
    contexts = np.append(contexts, np.ones((CLASSES, 1)), 1).astype(np.float32)

    # Each suffix class's smoothed mass: its words that have no class of their own, and one unknown word.
    mass = np.full(CLASSES, 0.1)
    for r in counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # a row a suffix class
        mass[r.suffix] += r.n + 0.1 * r.words
    owned = v.own >= FIRST_WORD
    classes = dict(zip(top.column("h").to_pylist(), top.column("suffix").to_pylist(), strict=True))
    for h, n in zip(v.h[owned].tolist(), v.n[owned].tolist(), strict=True):
        mass[classes[h]] -= n + 0.1

    rows = counted.where("suffix is not null").select("suffix", "salt", "words", "runs", "before", "times")
    solve = _solve_words(spark.sparkContext.broadcast((contexts, pairs.astype(np.float32), mass)))
    solved = work.write(rows.groupBy("suffix", "salt").applyInArrow(groupwise(solve), "h long, n long, suffix short, salt int, vector binary"), "vectors")
    work.drop("pairs")
    normal = np.tile(mass, (CLASSES, 1))
    for r in solved.where("h is null").select("suffix", "salt", "vector").groupBy("suffix").applyInArrow(_total, "suffix short, total binary").collect():  # a row a suffix class
        normal[:, r.suffix] += np.frombuffer(r.total)
    held = solved.where(F.col("h").isNotNull() & near).select("h", "vector").toArrow()  # NEAR rows at most
    if len(held):
        v.add_vectors(held.column("h").to_numpy(), np.frombuffer(b"".join(held.column("vector").to_pylist()), np.float32).reshape(len(held), -1))
    return (v, log_p, np.log10(normal), contexts), solved.where(F.col("h").isNotNull() & ~near).select("h", "vector")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document.

    It learns from the documents for which crc32 of the id as text, modulo 10, is not 0.
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "lm")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = docs.where(~held).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    counted = train.mapInArrow(batchwise(_count_words), "h long, suffix short, n long").groupBy("h", "suffix").agg(F.sum("n").alias("n"))
    counts = work.write(counted, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model, vectors = train_model(work, train, counts, int(total))
    state = spark.sparkContext.broadcast(model)

    fields = "doc_row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>, far array<long>, previous array<short>"
    partial = work.write(rows.mapInArrow(batchwise(_score(state)), fields), "partial")
    rare = partial.select("doc_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("doc_row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = rare.join(counts.select("h", "n"), "h", "left")
    log_count = F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.1)
    zero = F.lit(0).cast("long")
    lines = found.select("doc_row", zero.alias("doc_id"), F.lit(False).alias("own"), zero.alias("n_tokens"), F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).cast("long").alias("n_known"), log_count.alias("base"), log_count.alias("score"))
    lines = lines.union(partial.select("doc_row", "doc_id", F.lit(True), "n_tokens", "n_known", "base", "score"))
    if len(model[0].bits) or (model[0].may & (model[0].vector_of < 0)).any():
        far = partial.select("doc_row", F.explode(F.arrays_zip("far", "previous")).alias("x")).select("doc_row", F.col("x.far").alias("h"), F.col("x.previous").alias("previous"))
        far = far.join(vectors, "h").select("doc_row", "previous", "vector").mapInArrow(batchwise(_far_words(spark.sparkContext.broadcast(model[3]))), "doc_row long, extra double")
        lines = lines.union(far.select("doc_row", zero, F.lit(False), zero, zero, F.lit(0.0), "extra"))
    # Sums of fixed point: the order in which parts arrive changes nothing.
    exact = lambda c: (F.sum(F.round(F.col(c) * 1e9).cast("long")) / 1e9).alias(c)
    sums = lines.groupBy("doc_row").agg(F.max(F.when(F.col("own"), F.col("doc_id"))).alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), exact("base"), exact("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total) + 0.1 * (distinct + 1)))
    scores = sums.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("score"))
    return work.keep(scores)
