"""Packing by concatenation: all documents' tokens form one line, cut into windows of fixed length.

First pass: encode, write each document's ids with its offset inside its partition. The partitions' totals (a row a
partition) give each partition's global offset. Second pass: each document is cut at multiples of the window, so a
document that crosses a boundary gives one piece on either side; no row needs any other row.

Defined results: a null text is empty and has the end id alone; null ids are kept; repeated rows are documents of
their own; an empty table gives no pieces; columns besides the two named are not read, whatever they are called; a very
long text is encoded whole, by one task. Every sequence but the last is full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batchwise
from .shared import Workspace
from .tokens import Encoder


def _encode(tokenizer: str, end_id: int, small: bool):
    schema = pa.schema([("part", pa.int32()), ("local_start", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    kind = "<u2" if small else "<u4"

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        encode, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for k in range(0, len(doc_ids), 256):
                ids = [np.frombuffer(raw + end, "<u4") for raw in encode(texts[k : k + 256].to_pylist())]
                n = np.array([len(x) for x in ids])
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(start), doc_ids[k : k + 256], pa.array(n), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], schema=schema)

    return run


def _cut(base: dict[int, int], window: int, small: bool):
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(c, pa.int64()) for c in names])
    kind = "<u2" if small else "<u4"

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for part, local, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = base[part] + local
                raw, done = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes()), 0
                while done < n:
                    sequence, offset = divmod(first + done, window)
                    length = min(n - done, window - offset)
                    for column, value in zip(out, (doc_id, done, length, zlib.crc32(raw[4 * done : 4 * (done + length)]), n, sequence, offset), strict=True):
                        column.append(value)
                    done += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def pack_sequences(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. tokenizer: a tokenizers JSON file."""
    work, small = Workspace(docs.sparkSession, "pack"), vocabulary <= 1 << 16
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoded = work.write(rows.mapInArrow(batchwise(_encode(tokenizer, end_id, small), encoders=True), "part int, local_start long, doc_id long, n long, ids binary"), "ids")
    base, total = {}, 0
    for r in sorted(encoded.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row a partition
        base[r.part] = total
        total += r.n
    pieces = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return encoded.select("part", "local_start", "doc_id", "n", "ids").mapInArrow(batchwise(_cut(base, window, small), encoders=True), pieces)
