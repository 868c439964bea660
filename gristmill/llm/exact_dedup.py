"""Exact dedup over an extendible-hash index kept in shared files.

Plan: one scan of the texts writes an entry table (a row per document, one body and one running total per
distinct text and task); a histogram of key prefixes, of at most 2**MAX_DEPTH rows, decides where the
directory doubles; owner tasks each stream a contiguous range of buckets in key order, chain the texts
that share a 64-bit key and compare their bytes. A text that a third of all documents repeat reaches its
owner once a task, not once a document. The last join is a plain equi-join that AQE can split.

Defined results: a null text counts as empty; a null id loses ties against any id; rows repeated with the
same id and text are copies, of which exactly one is kept; an empty table gives no rows; other columns of
the input are not read, whatever they are called; a very long text is hashed and compared whole, by one task. Inside a
scanning task an equal SHA-256 stands for equal bytes; between tasks the bytes are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batchwise
from .shared import Workspace, named, numbered, partitions, place

WHITE = b" \t\n\x0b\x0c\r"
#: Deepest directory: 2**16 slots, so what the driver holds doesn't grow with the data.
MAX_DEPTH = 16
#: Distinct texts of which a scanning task keeps running totals before it emits them.
HELD = 100_000
ENTRY = "kind int, h long, sha binary, doc_row long, doc_id long, n_cp long, size long, body binary"
INDEX = "h long, sha binary, bucket int, chain int, keep_row long, keep_id long, group_size long"


class Directory:
    """Slots by key prefix; a bucket of local depth d is shared by 2**(depth - d) slots."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.depth, self.slots, self.local = 0, np.zeros(1, np.int64), [0]
        top = int(len(counts)).bit_length() - 1
        total = np.concatenate([[0], np.cumsum(counts)])
        todo = [(0, 0, 0)]  # bucket, its prefix, its depth
        while todo:
            bucket, prefix, d = todo.pop()
            width = top - d
            if d == top or total[(prefix + 1) << width] - total[prefix << width] <= capacity:
                continue
            if d == self.depth:  # the directory doubles
                self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
            new = len(self.local)
            self.local[bucket] = d + 1
            self.local.append(d + 1)
            span = 1 << (self.depth - d - 1)
            at = (2 * prefix + 1) * span
            self.slots[at : at + span] = new
            todo += [(bucket, 2 * prefix, d + 1), (new, 2 * prefix + 1, d + 1)]

    def owners(self, n: int) -> np.ndarray:
        """Owner of each slot: n contiguous ranges of buckets."""
        change = np.concatenate([[0], np.cumsum(self.slots[1:] != self.slots[:-1])])
        return change * n // (change[-1] + 1)


def _entries(batches):
    part, row, held, seen = TaskContext.get().partitionId() << 40, 0, {}, set()
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("sha", pa.binary()), ("doc_row", pa.int64()), ("doc_id", pa.int64()), ("n_cp", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def totals():
        return [(2, int.from_bytes(s[:8], "big", signed=True), s, r, i, n, size, None) for s, (n, r, i, size) in held.items()]

    for batch in batches:
        out, weight = [], 0
        ids = batch.column(0).to_pylist()
        lengths = batch.column(2).to_pylist()
        for doc_id, text, n_cp in zip(ids, batch.column(1), lengths, strict=True):
            body = bytes(text.as_buffer() or b"").translate(None, WHITE)
            sha = hashlib.sha256(body).digest()
            h = int.from_bytes(sha[:8], "big", signed=True)
            at = part + row
            row += 1
            out.append((0, h, sha, at, doc_id, n_cp, 1, None))
            if sha not in held:
                if sha not in seen:
                    seen.add(sha)
                    out.append((1, h, sha, None, None, None, 0, body))
                    weight += len(body)
                held[sha] = (n_cp, at, doc_id, 1)
            else:
                n, r, i, size = held[sha]
                better = (-n_cp, doc_id is None, doc_id or 0, at) < (-n, i is None, i or 0, r)
                held[sha] = (n_cp, at, doc_id, size + 1) if better else (n, r, i, size + 1)
            if weight > 8 << 20:
                yield rows(out)
                out, weight = [], 0
            if len(held) >= HELD:
                out += totals()
                held, seen = {}, set()
        if out:
            yield rows(out)
    if held:
        yield rows(totals())


def _chains(slots: np.ndarray, depth: int):
    """Owner task: entries arrive in key order; one chain of distinct texts is held at a time."""
    schema = pa.schema([("h", pa.int64()), ("sha", pa.binary()), ("bucket", pa.int32()), ("chain", pa.int32()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def close(h, chain):
        slot = (h & ((1 << 64) - 1)) >> (64 - depth)
        return [(h, sha, int(slots[slot]), k, best[3], best[4], size) for k, (sha, (_, best, size)) in enumerate(sorted(chain.items()))]

    def run(batches):
        now, chain = None, {}
        for batch in batches:
            out = []
            for h, sha, row, doc_id, n_cp, size, body in zip(*(batch.column(k).to_pylist() for k in range(6)), batch.column(6), strict=True):
                if h != now:
                    out += close(now, chain) if chain else []
                    now, chain = h, {}
                known = chain.setdefault(sha, [None, None, 0])
                if size:
                    best = (-n_cp, doc_id is None, doc_id or 0, row, doc_id)
                    if known[1] is None or best[:4] < known[1][:4]:
                        known[1] = best
                    known[2] += size
                else:
                    body = body.as_buffer()
                    if known[0] is None:
                        known[0] = bytes(body)
                    elif known[0] != bytes(body):
                        raise ValueError(f"two texts with the SHA-256 {sha.hex()}")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if chain:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*close(now, chain), strict=True), schema, strict=True)], schema=schema)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_cp, and its place in the index: bucket, chain.

    Texts are equal when equal after dropping ASCII white space; of equal ones the row with the most code
    points, then the smallest id, stays. capacity: distinct texts a bucket holds before it splits.
    """
    spark = docs.sparkSession
    work, n = Workspace(spark, "exact"), partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("n_cp"))
    entries = work.write(rows.mapInArrow(batchwise(_entries), ENTRY), "entries")

    prefix = F.shiftrightunsigned("h", 64 - MAX_DEPTH)
    counts = np.zeros(1 << MAX_DEPTH, np.int64)
    for p, c in entries.where("kind = 1").groupBy(prefix.alias("p")).count().collect():  # 2**MAX_DEPTH rows at most
        counts[p] = c
    directory = Directory(counts, capacity or max(1024, int(counts.sum()) // (8 * n)))
    owners, depth = directory.owners(4 * n), directory.depth

    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    table = spark.createDataFrame([(k, int(o), int(directory.slots[k]), directory.local[directory.slots[k]]) for k, o in enumerate(owners)], "slot long, owner int, bucket int, local_depth int")
    table = work.write(table.coalesce(1), "directory")
    owned = F.broadcast(table.select("slot", "owner"))  # 2**MAX_DEPTH rows at most
    dealt = entries.where("kind > 0").select("h", "sha", "doc_row", "doc_id", "n_cp", "size", "body", slot.alias("slot"))
    dealt = dealt.join(owned, "slot").repartition(n, "owner").sortWithinPartitions("owner", "h").drop("slot", "owner")
    index = work.write(dealt.mapInArrow(batchwise(_chains(directory.slots, depth)), INDEX), "index")

    found = entries.where("kind = 0").select("h", "sha", "doc_id", "doc_row", "n_cp").join(index, ["h", "sha"])
    kept, sha = F.col("doc_row") == F.col("keep_row"), F.lower(F.hex("sha"))
    return work.keep(found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), sha.alias("text_sha256"), "n_cp", "bucket", "chain"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of rows that agree in id, in text but for white space, and in length, any one stays."""
    own = numbered(docs)
    own_id, own_text = place(docs, id_col), place(docs, text_col)
    text, keys = F.coalesce(F.col(own_text), F.lit("")), ["_id", "_none", "_sha", "_n"]
    named_by = lambda c: {"_id": F.coalesce(c, F.lit(0)), "_none": c.isNull()}  # noqa: E731  null ids are equal to each other only
    kept = exact_dedup(own, own_id, own_text).where("kept").select(*(v.alias(k) for k, v in named_by(F.col("doc_id")).items()), F.col("text_sha256").alias("_sha"), F.col("n_cp").alias("_n"))
    rows = own.withColumns(named_by(F.col(own_id).cast("long")) | {"_sha": F.sha2(F.translate(text, WHITE.decode(), ""), 256), "_n": F.char_length(text).cast("long")})
    return named(rows.join(kept, keys, "left_semi").dropDuplicates(keys), docs)
