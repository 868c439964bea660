"""Removing repeated byte strings with suffix arrays.

Any string of `length` bytes has a minimizer: of its runs of GRAM bytes the one with the least hash, the first of
equals. Equal strings have equal minimizers, so strings can only repeat where a minimizer does:

1. Each task sends the 32-bit remainders of its texts' minimizers, as blobs, to the bucket that the upper bits
   name; a bucket returns, per text, those that another text has too. Of a minimizer that many texts of a task's
   blob share, two go to the bucket and the others' way back begins at once.
2. A text's strings with such a minimizer form runs of starts. Each distinct run with its context (the bytes that
   its strings cover) goes once a blob to its minimizer's bucket, with the least document of the blob that holds it;
   the others that hold it lose all its strings, whatever the bucket finds.
3. There the contexts of a minimizer are joined and suffix-sorted in two stages (see suffix_sort); adjacent common
   prefixes of `length` bytes or more form the groups of equal strings, whose least id decides.
4. Each document gets a bit a start back, and cuts what the marked strings cover.

Equal whole texts are represented by the one with the least id; the others go entirely. A passage that all
documents share travels once a task, not once a document.

Defined results: a null text is empty; null ids count as larger than all others and as equal to each other;
rows repeated with the same id never remove each other; an empty table gives no rows; columns besides the two named
are not read, whatever they are called; a very long text is cut whole, by one task, its minimizers found in stretches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batchwise, groupwise, rolling_hashes, span_hashes, text_slices
from .shared import Workspace, partitions
from .suffix_sort import common_prefixes, sort_suffixes

LENGTH, GRAM = 50, 20
#: Text of contexts that is sorted at once, minimizers a bucket, starts whose minimizers are found at once.
SORTED, BUCKET, STRETCH = 1 << 20, 2_000_000, 1 << 22
#: Bytes of text, or of contexts, that a task gathers before it sends them; text whose contexts share a bucket.
HELD, CONTEXT_BUCKET = 1 << 23, 1 << 22
LAST = (1 << 63) - 1
LOW32, LOW24 = np.uint64((1 << 32) - 1), np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------- minimizers
def runs(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, starts, document, minimizer's hash) of the runs of strings that share a minimizer occurrence."""
    out = []
    for low in range(0, max(1, len(buf) - length + 1), STRETCH):
        part = buf[low : low + STRETCH + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            continue
        h = rolling_hashes(part, GRAM)
        least, span, width = (h & ~LOW24) | np.arange(len(h), dtype=np.uint64), 1, length - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        at = (least & LOW24).astype(np.int64)
        starts = low + np.arange(n)
        doc = np.searchsorted(offs, starts, "right") - 1
        p = np.flatnonzero(starts + length <= offs[doc + 1])
        q = at[p]
        new = np.ones(len(p), bool)
        new[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        out.append((starts[p[first]], np.diff(np.append(first, len(p))), doc[p[first]], h[q[first]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _runs_by_size(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


# ---------------------------------------------------------------- step 1: which minimizers repeat
def _send_minimizers(n_buckets: int, length: int):
    """Rows (bucket, texts: class hashes, counts: minimizers of each, rest: their remainders)."""
    schema = pa.schema([("bucket", pa.int32()), ("texts", pa.binary()), ("counts", pa.binary()), ("rest", pa.binary())])

    def run(batches):
        for batch in batches:
            key, held, weight = batch.column(0).to_numpy(), [], 0
            for first, last, buf, offs in text_slices(batch.column(1)):
                _, _, doc, h = runs(buf, offs, length)
                held.append((bucket_of(h, n_buckets), doc + first, (h & LOW32).astype(np.uint32)))
                weight += len(buf)
                if weight >= HELD or last == batch.num_rows:
                    yield from rows(key, held)
                    held, weight = [], 0

    def rows(key, held):
        b, doc, rest = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((rest, doc, b))
        b, doc, rest = b[by], doc[by], rest[by]
        if not len(b):
            return
        keep = np.ones(len(b), bool)
        keep[1:] = (b[1:] != b[:-1]) | (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])
        b, doc, rest = b[keep], doc[keep], rest[keep]
        text = key[doc]
        few = _least_two(text, (b.astype(np.uint64) << np.uint64(32)) | rest)
        far = np.flatnonzero(~few)  # of these it is known here that another text has them
        far = far[np.lexsort((text[far], _group_of(text[far], n_buckets)))]
        grp = _group_of(text[far], n_buckets)
        codes = (b[far].astype(np.uint64) << np.uint64(32)) | rest[far]
        rows = _group_rows(n_buckets + grp, [text[far]], [codes])
        b, text, rest = b[few], text[few], rest[few]
        by = np.lexsort((rest, text, b))
        rows += _group_rows(b[by], [text[by]], [rest[by]])
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _least_two(text: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which entries are among the first two distinct texts of their code."""
    by = np.lexsort((text, code))
    t, c = text[by], code[by]
    new_code = np.ones(len(by), bool)
    new_code[1:] = c[1:] != c[:-1]
    new_text = new_code.copy()
    new_text[1:] |= t[1:] != t[:-1]
    rank = np.cumsum(new_text)
    rank -= np.repeat(rank[new_code], np.diff(np.append(np.flatnonzero(new_code), len(by))))
    out = np.empty(len(by), bool)
    out[by] = rank < 2
    return out


def _group_rows(grp: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray]) -> list[tuple]:
    """Rows (group; its keys and their counts; the values) of entries sorted by group and key."""
    if not len(grp):
        return []
    change = np.ones(len(grp), bool)
    change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (grp, *keys)])
    edge = np.flatnonzero(change)
    count, at = np.diff(np.append(edge, len(grp))).astype(np.uint32), grp[edge]
    cut = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
    spot = np.append(edge, len(grp))[cut]
    return [(int(at[i]), *(k[edge[i:j]].tobytes() for k in keys), count[i:j].tobytes(), *(v[x:y].tobytes() for v in values)) for i, j, x, y in zip(cut, cut[1:], spot, spot[1:], strict=False)]


def _columns(table: pa.Table, names: tuple[str, ...], kinds: tuple) -> list[np.ndarray]:
    parts = [[np.frombuffer(x, k) for x, k in zip(r, kinds, strict=True)] for r in zip(*(table.column(c).to_pylist() for c in names), strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _group_of(text: np.ndarray, n: int) -> np.ndarray:
    return (text.view(np.uint64) % np.uint64(n)).astype(np.int64)


def _repeated(n_groups: int):
    """One bucket: to each text's group, those of its minimizers that another text has too."""
    schema = pa.schema([("grp", pa.int32()), ("texts", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        grp = table.column("bucket")[0].as_py() - n_groups
        if grp >= 0:  # known already, on their way to their texts
            return pa.Table.from_arrays([pa.array([grp] * len(table), pa.int32()), *(table.column(c) for c in ("texts", "counts", "rest"))], schema=schema)
        texts, counts, rest = _columns(table, ("texts", "counts", "rest"), (np.int64, np.uint32, np.uint32))
        texts = np.repeat(texts, counts)
        by = np.lexsort((texts, rest))
        texts, rest = texts[by], rest[by]
        new = np.concatenate([[True], (rest[1:] != rest[:-1]) | (texts[1:] != texts[:-1])])
        texts, rest = texts[new], rest[new]
        same = np.concatenate([[False], rest[1:] == rest[:-1], [False]])
        shared = same[1:] | same[:-1]
        texts, rest = texts[shared], rest[shared]
        codes = (np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)) | rest.astype(np.uint64)
        grp = _group_of(texts, n_groups)
        by = np.lexsort((texts, grp))
        rows = _group_rows(grp[by], [texts[by]], [codes[by]])
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], t.type) for c, t in enumerate(schema)], schema=schema)

    return run


def _gather(names: tuple[str, ...], key_kinds: tuple, value_kinds: tuple, schema: pa.Schema):
    """One group: a row a key, with its values in one piece, sorted by the first."""

    def run(table: pa.Table) -> pa.Table:
        columns = _columns(table, names, (*key_kinds, np.uint32, *value_kinds))
        keys, counts, values = columns[: len(key_kinds)], columns[len(key_kinds)], columns[len(key_kinds) + 1 :]
        keys = [np.repeat(k, counts) for k in keys]
        by = np.lexsort((values[0], *keys[::-1]))
        keys, values = [k[by] for k in keys], [v[by] for v in values]
        change = np.ones(len(by), bool)
        change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in keys])
        edge = np.append(np.flatnonzero(change), len(by))
        arrays = [pa.array(k[edge[:-1]]) for k in keys] + [pa.array([v[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], pa.binary()) for v in values]
        return pa.Table.from_arrays(arrays, schema=schema)

    return run


# ---------------------------------------------------------------- step 2: contexts
def _marked_runs(buf, offs, length, wanted):
    """The runs whose minimizers are among those wanted, per document: arrays of (bucket, remainder) keys."""
    start, count, doc, h = runs(buf, offs, length)
    keep = np.zeros(len(h), bool)
    at = _runs_by_size(np.bincount(doc, minlength=len(offs) - 1))
    n_buckets, keys = wanted
    code = (bucket_of(h, n_buckets).astype(np.uint64) << np.uint64(32)) | (h & LOW32)
    for d, own in enumerate(keys):
        keep[at[d] : at[d + 1]] = np.isin(code[at[d] : at[d + 1]], own)
    return start[keep], count[keep], doc[keep], h[keep]


def _send_contexts(n_buckets: int, n_contexts: int, length: int):
    """Rows (bucket; per context: minimizer, hash, strings, bytes; per context and document: context's place, order, key)."""
    names = ("minimizers", "hashes", "counts", "bytes", "places", "orders", "texts")
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in names)])

    def run(batches):
        for batch in batches:
            key, order = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            held, weight = [], 0
            for first, last, buf, offs in text_slices(batch.column(2)):
                start, count, doc, h = _marked_runs(buf, offs, length, (n_buckets, wanted[first:last]))
                if len(start):
                    c = span_hashes(buf, start, start + count + length - 1)
                    u, own, at = np.unique(c, return_index=True, return_inverse=True)
                    pair = np.unique(at * (1 << 32) + doc)
                    size = count[own] + length - 1
                    body = buf[np.repeat(start[own] - _runs_by_size(size)[:-1], size) + np.arange(size.sum())]
                    held.append((h[own], u, count[own].astype(np.uint8), body, pair >> 32, (pair & 0xFFFFFFFF) + first))
                    weight += len(body)
                if held and (weight >= HELD or last == batch.num_rows):
                    yield send(key, order, held)
                    held, weight = [], 0

    def send(key, order, held):
        h, c, count = (np.concatenate([x[k] for x in held]) for k in range(3))
        body = np.concatenate([x[3] for x in held])
        lead = _runs_by_size(np.array([len(x[0]) for x in held]))
        place, doc = np.concatenate([x[4] + d for x, d in zip(held, lead, strict=False)]), np.concatenate([x[5] for x in held])
        bucket, size = bucket_of(h, n_contexts), count.astype(np.int64) + length - 1
        begin = _runs_by_size(size)
        # All strings of a context go from those documents that aren't its first here; only the first one asks.
        _, same = np.unique(c, return_inverse=True)
        same, own = same[place], order[doc]
        least = np.full(len(c), LAST)
        np.minimum.at(least, same, own)
        far = own > least[same]
        text, own, of = key[doc[far]], own[far], place[far]
        grp = _group_of(text, n_buckets)
        by = np.lexsort((own, text, grp))
        every = ((np.uint64(1) << count[of[by]].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        rows = [(n_contexts + g, marks, hashes, counts, b"", b"", orders, texts) for g, texts, orders, counts, hashes, marks in _group_rows(grp[by], [text[by], own[by]], [c[of[by]], every])]
        place, doc = place[~far], doc[~far]
        by = np.argsort(bucket, kind="stable")
        new_place = np.empty(len(by), np.int64)
        edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]])), len(by))
        pair_by = np.argsort(bucket[place], kind="stable")
        pair_at = np.searchsorted(bucket[place][pair_by], np.arange(n_contexts + 1))
        for i, j in zip(edges, edges[1:], strict=False):
            mine, b = by[i:j], int(bucket[by[i]])
            new_place[mine] = np.arange(len(mine))
            pairs = pair_by[pair_at[b] : pair_at[b + 1]]
            texts = body[np.repeat(begin[mine] - _runs_by_size(size[mine])[:-1], size[mine]) + np.arange(size[mine].sum())]
            rows.append((b, h[mine].tobytes(), c[mine].tobytes(), count[mine].tobytes(), texts.tobytes(), new_place[place[pairs]].astype(np.uint32).tobytes(), order[doc[pairs]].tobytes(), key[doc[pairs]].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


# ---------------------------------------------------------------- step 3: equal strings
def least_orders(h, count, body, begin, order, length: int) -> np.ndarray:
    """For each distinct context and start the least order of a document with the same string: a row of 32 a context.

    h: minimizers, count: starts, begin: where each context begins in body, order: least order of its documents.
    """
    out = np.repeat(order[:, None], 32, 1)
    by = np.argsort(h, kind="stable")
    size = count + length - 1
    group = np.concatenate([[0], np.cumsum(h[by][1:] != h[by][:-1])])
    several = np.bincount(group)[group] > 1  # a context alone has strings of its own only
    by, group = by[several], group[several]
    done = 0
    total = np.cumsum(size[by])
    while done < len(by):  # whole minimizers, about SORTED bytes
        stop = int(np.searchsorted(total, (total[done - 1] if done else 0) + SORTED, "right"))
        stop = int(np.searchsorted(group, group[max(stop, done + 1) - 1], "right"))
        mine = by[done:stop]
        done = stop
        own = _runs_by_size(size[mine])
        text = body[np.repeat(begin[mine] - own[:-1], size[mine]) + np.arange(own[-1])]
        starts = np.repeat(own[:-1] - _runs_by_size(count[mine])[:-1], count[mine]) + np.arange(count[mine].sum())
        is_start = np.zeros(len(text), bool)
        is_start[starts] = True
        context = np.repeat(np.arange(len(mine)), size[mine])
        sa = sort_suffixes(text, length)
        sa = sa[is_start[sa]]
        lcp = common_prefixes(text, sa, length)
        new = np.flatnonzero(lcp < length)
        of = context[sa]
        least = np.minimum.reduceat(order[mine][of], new)
        out[mine[of], sa - own[of]] = np.repeat(least, np.diff(np.append(new, len(sa))))
    return out


def _resolve(n_groups: int, n_contexts: int, length: int):
    """One bucket: to each document's group, its contexts that have strings to remove, with a bit a start."""
    schema = pa.schema([("grp", pa.int32()), *((c, pa.binary()) for c in ("texts", "orders", "counts", "hashes", "marks"))])

    def run(table: pa.Table) -> pa.Table:
        grp = table.column("bucket")[0].as_py() - n_contexts
        if grp >= 0:  # known already, on their way to their texts
            return pa.Table.from_arrays([pa.array([grp] * len(table), pa.int32()), *(table.column(k) for k in ("texts", "orders", "counts", "hashes", "minimizers"))], schema=schema)
        rows = list(zip(*(table.column(k).to_pylist() for k in ("minimizers", "hashes", "counts", "bytes", "places", "orders", "texts")), strict=True))
        kinds = (np.uint64, np.uint64, np.uint8, np.uint8, np.uint32, np.int64, np.int64)
        got = [[np.frombuffer(x, k) for x, k in zip(r, kinds, strict=True)] for r in rows]
        lead = _runs_by_size(np.array([len(g[0]) for g in got]))
        h, c, count, body = (np.concatenate([g[k] for g in got]) for k in range(4))
        place = np.concatenate([g[4].astype(np.int64) + d for g, d in zip(got, lead, strict=False)])
        order, text = (np.concatenate([g[k] for g in got]) for k in (5, 6))
        count = count.astype(np.int64)
        # Distinct contexts, by both hashes.
        both = c ^ (h * np.uint64(0x9E3779B97F4A7C15))
        _, first, same = np.unique(both, return_index=True, return_inverse=True)
        begin = _runs_by_size(count + length - 1)[:-1][first]
        of = same[place]
        least = np.full(len(first), LAST)
        np.minimum.at(least, of, order)
        found = least_orders(h[first], count[first], body, begin, least, length)
        bits = (found[of] < order[:, None]) & (np.arange(32) < count[first][of][:, None])
        marks = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)
        some = marks > 0
        of, order, text, marks = of[some], order[some], text[some], marks[some]
        grp = _group_of(text, n_groups)
        by = np.lexsort((order, text, grp))
        rows = _group_rows(grp[by], [text[by], order[by]], [c[first][of[by]], marks[by]])
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)

    return run


# ---------------------------------------------------------------- step 4: cutting
def _cut(n_buckets: int, length: int):
    schema = pa.schema([("text_key", pa.int64()), ("ord", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha", pa.string())])

    def run(batches):
        for batch in batches:
            keys, orders, texts = batch.column(0), batch.column(1), batch.column(2)
            hashes, marks = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out = []
            for first, _, buf, offs in text_slices(texts):
                start, count, doc, _ = runs(buf, offs, length)
                context = span_hashes(buf, start, start + count + length - 1)
                at = _runs_by_size(np.bincount(doc, minlength=len(offs) - 1))
                for d in range(len(offs) - 1):
                    h, m = np.frombuffer(hashes[first + d], np.uint64), np.frombuffer(marks[first + d], np.uint32)
                    mine = slice(at[d], at[d + 1])
                    spot = np.minimum(np.searchsorted(h, context[mine]), len(h) - 1)
                    bits = np.where(h[spot] == context[mine], m[spot], np.uint32(0))
                    low = start[mine][:, None] + np.arange(32)
                    low = low[(bits[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(bool)] - offs[d]
                    text = buf[offs[d] : offs[d + 1]]
                    cover = np.zeros(len(text) + 1, np.int64)
                    np.add.at(cover, low, 1)
                    np.add.at(cover, low + length, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([keys, orders, *(pa.array(c) for c in zip(*out, strict=True))], schema=schema)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: each byte that a string of `length` bytes covers which also
    starts in a document with a smaller id is removed."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "repeats")
    n = partitions(spark)
    if not GRAM < length <= GRAM + 31:
        raise ValueError(f"length must lie in {GRAM + 1} .. {GRAM + 31}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), text.alias("text"))
    rows = rows.withColumns({"text_key": F.xxhash64("text"), "sha": F.sha2("text", 256)})
    heads = work.write(rows.select("ord", "text_key", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "heads")
    total = heads.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_buckets = max(n, int(total) // 15 // BUCKET)

    sent = rows.select("text_key", "text").mapInArrow(batchwise(_send_minimizers(n_buckets, length)), "bucket int, texts binary, counts binary, rest binary")
    repeated = sent.groupBy("bucket").applyInArrow(groupwise(_repeated(n_buckets)), "grp int, texts binary, counts binary, codes binary")
    one = _gather(("texts", "counts", "codes"), (np.int64,), (np.uint64,), pa.schema([("text_key", pa.int64()), ("codes", pa.binary())]))
    marked = work.write(repeated.groupBy("grp").applyInArrow(groupwise(one), "text_key long, codes binary"), "repeated")
    # The first document of each distinct text stands for all.
    first = work.write(heads.groupBy("sha", "text_key", "n_bytes").agg(F.min("ord").alias("least")), "first")
    todo = first.join(marked, "text_key").select("text_key", F.col("least").alias("ord"), "sha", "codes")
    found = rows.join(todo, ["ord", "text_key", "sha"]).select("text_key", "ord", "text", "codes")
    found = work.write(found, "marked")
    text_size = found.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_contexts = max(n, int(text_size) // CONTEXT_BUCKET)
    contexts = found.mapInArrow(batchwise(_send_contexts(n_buckets, n_contexts, length)), "bucket int, minimizers binary, hashes binary, counts binary, bytes binary, places binary, orders binary, texts binary")
    marks = contexts.groupBy("bucket").applyInArrow(groupwise(_resolve(n_buckets, n_contexts, length)), "grp int, texts binary, orders binary, counts binary, hashes binary, marks binary")
    one = _gather(("texts", "orders", "counts", "hashes", "marks"), (np.int64, np.int64), (np.uint64, np.uint32), pa.schema([("text_key", pa.int64()), ("ord", pa.int64()), ("hashes", pa.binary()), ("marks", pa.binary())]))
    per_doc = work.write(marks.groupBy("grp").applyInArrow(groupwise(one), "text_key long, ord long, hashes binary, marks binary"), "marks")
    cut = found.select("text_key", "ord", "text").join(per_doc, ["text_key", "ord"]).select("text_key", "ord", "text", "hashes", "marks")
    cut = work.write(cut.mapInArrow(batchwise(_cut(n_buckets, length)), "text_key long, ord long, n_removed long, n_spans long, kept_sha string").distinct(), "cut")
    for name in ("repeated", "marked", "marks"):
        work.drop(name)

    # Copies of an earlier text go whole; first documents take what was cut.
    whole = heads.join(first, ["sha", "text_key", "n_bytes"]).join(cut, ["text_key", "ord"], "left")
    gone = (F.col("ord") > F.col("least")) & (F.col("n_bytes") >= length)
    pick = lambda copy, cut, none: F.when(gone, copy).otherwise(F.coalesce(cut, none))
    return whole.select(
        F.when(F.col("ord") < LAST, F.col("ord")).alias("doc_id"), "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), F.lit(0).cast("long")).alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha"), F.col("sha")).alias("kept_sha256"),
    )
