"""Token ids in fixed-width bit-packed shard files, written in document order and read back.

A shard: MAGIC, the packed blocks, the footer's arrays, the footer's JSON header, its length, MAGIC. Each id takes
`bits`, the least that the vocabulary needs, so id k of a block lies at bit k * bits and any id or document can
be read alone; a block holds BLOCK ids and the footer has each block's offset. The footer also lists the
documents and their token counts.

The documents are dealt by range of doc_id, sorted inside a task, encoded and written by the task straight to
the shared folder under a temporary name, then renamed: a task that runs again replaces its own shard with
equal bytes. Only a row a shard reaches the driver, for the prefix sums of the shards' totals.

Defined results: a null text is empty and has the end id alone; null ids come first; rows repeated with the same
id are ordered by a hash of the text; an empty table gives no rows; columns besides the two named are not read, whatever
they are called; a very long text is encoded whole, by one task.
"""

from __future__ import annotations

import json
import struct
import zlib
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batchwise
from .shared import Workspace, open_store, partitions
from .tokens import Encoder

MAGIC, BLOCK = b"GMBP0001", 1 << 16


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, each in `bits` bits, lowest bit first, padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(raw, count: int, bits: int, first: int = 0) -> np.ndarray:
    """`count` ids from id `first` of a packed run."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    lead = first * bits
    data = np.frombuffer(raw, np.uint8)[lead // 8 : (lead + count * bits + 7) // 8]
    planes = np.unpackbits(data, bitorder="little")[lead % 8 : lead % 8 + count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = planes
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.offsets, self.docs, self.known, self.counts, self.rest, self.total = [], [], [], [], [], 0
        self.pending = 0
        out.write(MAGIC)

    def _flush(self, least: int) -> None:
        if self.pending < max(least, 1):
            return
        ids = np.concatenate(self.rest)
        end = len(ids) // least * least if least > 1 else len(ids)
        for k in range(0, end, BLOCK):
            raw = pack(ids[k : min(k + BLOCK, end)], self.bits)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.rest, self.pending = [ids[end:]], len(ids) - end

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.counts.append(len(ids))
        self.rest.append(ids)
        self.pending += len(ids)
        self.total += len(ids)
        if self.pending >= 4 * BLOCK:
            self._flush(BLOCK)

    def close(self) -> None:
        self._flush(1)
        arrays = [np.array(self.offsets, "<i8"), np.array(self.docs, "<i8"), np.array(self.counts, "<i8"), np.array(self.known, np.uint8)]
        head = json.dumps({"bits": self.bits, "block": BLOCK, "ids": self.total, "blocks": len(self.offsets), "docs": len(self.docs), "footer": self.at}).encode()
        self.out.write(b"".join(a.tobytes() for a in arrays) + head + struct.pack("<q", len(head)) + MAGIC)


class Shard:
    """A shard file opened for reading; ids(first, count) reads any run without the rest."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard of packed ids, or cut short")
        n = struct.unpack("<q", tail[:8])[0]
        source.seek(size - 16 - n)
        self.head = json.loads(source.read(n))
        source.seek(self.head["footer"])
        raw, at = source.read(size - 16 - n - self.head["footer"]), 0
        parts = []
        for kind, count in (("<i8", self.head["blocks"]), ("<i8", self.head["docs"]), ("<i8", self.head["docs"]), ("u1", self.head["docs"])):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes
        self.offsets, self.doc_ids, self.counts, self.known = parts

    def ids(self, first: int, count: int) -> np.ndarray:
        bits, out = self.head["bits"], []
        while count > 0:
            block, skip = divmod(first, BLOCK)
            n = min(count, BLOCK - skip)
            lead = skip * bits // 8
            self.source.seek(int(self.offsets[block]) + lead)
            raw = self.source.read((skip * bits % 8 + n * bits + 7) // 8)
            if skip * bits % 8:
                planes = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[skip * bits % 8 :]
                raw = np.packbits(planes, bitorder="little").tobytes()
            out.append(unpack(raw, n, bits))
            first, count = first + n, count - n
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def _write(folder: str, tokenizer: str, end_id: int, bits: int):
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches):
        task = TaskContext.get()
        store, path = open_store(folder)
        name = f"{path}/shard-{task.partitionId():06d}.ids"
        encode, end = Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        writer = None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary())
            for k in range(0, len(ids), 256):
                if writer is None:
                    store.create_dir(path, recursive=True)
                    temporary = f"{name}.{task.taskAttemptId()}.part"
                    out = store.open_output_stream(temporary)
                    writer = ShardWriter(out, bits)
                for doc_id, raw in zip(ids[k : k + 256], encode(texts[k : k + 256].to_pylist()), strict=True):
                    writer.add(doc_id, np.frombuffer(raw + end, "<u4"))
        if writer:
            writer.close()
            out.close()
            store.move(temporary, name)
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": f"{folder}/{name.rpartition('/')[2]}", "n_docs": len(writer.docs), "n_ids": writer.total}], schema=schema)

    return run


def _read(shards: list[tuple[str, int]]):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                uri, base = shards[k]
                store, path = open_store(uri)
                with closing(store.open_input_file(path)) as source:
                    shard = Shard(source, source.size())
                    starts = np.cumsum(shard.counts) - shard.counts
                    first = 0
                    while first < len(starts):  # some 2**20 ids at a time, or one document
                        last = max(first + 1, int(np.searchsorted(starts, starts[first] + (1 << 20))))
                        counts = shard.counts[first:last]
                        raw = memoryview(shard.ids(int(starts[first]), int(counts.sum())).tobytes())
                        at = 4 * (starts[first:last] - starts[first])
                        crc = [zlib.crc32(raw[a : a + 4 * c]) for a, c in zip(at.tolist(), counts.tolist(), strict=True)]
                        docs = pa.array(shard.doc_ids[first:last], mask=shard.known[first:last] == 0)
                        yield pa.RecordBatch.from_arrays([docs, pa.array(base + starts[first:last]), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)
                        first = last

    return run


def write_packed_ids(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> list[tuple[str, int]]:
    """Write the shards; returns each one's path and the ids of all shards before it. tokenizer: a tokenizers JSON file."""
    spark = docs.sparkSession
    work, n = Workspace(spark, "ids"), partitions(spark)
    bits = max(1, int(vocabulary - 1).bit_length())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")  # the range's sample holds no texts
    task = _write(folder or f"{work.path}/shards", tokenizer, end_id, bits)
    manifest = work.write(rows.mapInArrow(batchwise(task, encoders=True), "part int, path string, n_docs long, n_ids long"), "manifest")
    shards, base = [], 0
    for r in sorted(manifest.collect()):  # a row a shard
        shards.append((r.path, base))
        base += r.n_ids
    return shards


def read_packed_ids(spark, shards: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    at = spark.range(0, max(1, len(shards)), 1, max(1, len(shards))).where(F.col("id") < len(shards))
    return at.mapInArrow(batchwise(_read(shards), encoders=True), "doc_id long, start long, n_tokens long, ids_crc32 long")
