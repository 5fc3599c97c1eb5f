"""Op 1. Token ids as directly addressable codes: any token is read from a few bytes, without decoding a block.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the lowest chunk of every token; a continuation bitmap
beside it marks the tokens that have a chunk at level 1, and so on. A rank directory counts the marks before each 512 bits,
so the position of a token's next chunk is one directory entry plus the marks in at most 64 bytes.

File (little endian): ``DAC1``, then u64 documents, tokens, levels; i64 ids of the documents; u64 first token of each document
and the end; for each level u64 entries, its chunks, and, but for the last level, its bitmap and its directory of u64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import arrow_type, documents
from factloom.llm.tokens import encoder
from factloom.session import shared_folder, stored

MAGIC, BLOCK, NO_ID = b"DAC1", 512, -1 << 63
SHARD_TOKENS = 16_000_000


def pack(doc_ids: list[int], ids: list[bytes]) -> bytes:
    """One file: ``ids`` holds each document's ids as little-endian unsigned 32-bit integers."""
    counts = np.array([len(x) // 4 for x in ids], np.uint64)
    values = np.frombuffer(b"".join(ids), "<u4")
    levels, rest = [], values
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        levels.append((chunk, more))
        if not more.any():
            break
        rest = rest[more]
    out = [MAGIC, struct.pack("<3Q", len(doc_ids), len(values), len(levels)), np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(),
           np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k + 1 < len(levels):
            marks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
            out += [np.packbits(more, bitorder="little").tobytes(), np.concatenate([[0], np.cumsum(marks)[:-1]]).astype("<u8").tobytes()]
    return b"".join(out)


class Reader:
    """Random access to a packed file; ``source`` is bytes or any buffer, such as a memory map."""

    def __init__(self, source):
        self.data = memoryview(source)
        if bytes(self.data[:4]) != MAGIC:
            raise ValueError("not a DAC1 file")
        self.docs, self.tokens, levels = struct.unpack_from("<3Q", self.data, 4)
        at = 28
        self.doc_ids, at = np.frombuffer(self.data, "<i8", self.docs, at), at + 8 * self.docs
        self.starts, at = np.frombuffer(self.data, "<u8", self.docs + 1, at).astype(np.int64), at + 8 * (self.docs + 1)
        self.levels = []
        for k in range(levels):
            n, at = struct.unpack_from("<Q", self.data, at)[0], at + 8
            chunk, at, bits, ranks = np.frombuffer(self.data, np.uint8, n, at), at + n, None, None
            if k + 1 < levels:
                bits, at = np.frombuffer(self.data, np.uint8, -(-n // 8), at), at + -(-n // 8)
                ranks, at = np.frombuffer(self.data, "<u8", -(-n // BLOCK), at), at + 8 * -(-n // BLOCK)
            self.levels.append((chunk, bits, ranks))

    def token(self, i: int) -> int:
        """The id at position ``i`` of the file."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            inside = int.from_bytes(bits[first >> 3:(i >> 3) + 1].tobytes(), "little") & ((1 << (i - first)) - 1)
            i, shift = int(ranks[first // BLOCK]) + inside.bit_count(), shift + 8
        return value

    def decode(self) -> np.ndarray:
        """All ids, in order."""
        value = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            whole = chunk.astype(np.uint32)
            if bits is not None:
                whole[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)] |= value << np.uint32(8)
            value = whole
        return value

    def document(self, k: int) -> list[int]:
        return [self.token(i) for i in range(self.starts[k], self.starts[k + 1])]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":/", ":///", 1))


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, pieces: str | None, end: int | None,
           shard_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, encode, last = TaskContext.get(), encoder(path, pieces).encode, b"" if end is None else struct.pack("<I", end)
    store, base = _store(folder)
    shards: list[tuple] = []

    def flush(docs: list[int], ids: list[bytes]) -> None:
        name = f"{base}/{task.partitionId():08d}-{len(shards):06d}.dac"
        part = f"{name}.{task.taskAttemptId()}.part"
        with store.open_output_stream(part) as sink:  # whole under another name, then renamed: a lost task leaves no half file
            sink.write(pack(docs, ids))
        store.move(part, name)
        shards.append((name.rsplit("/", 1)[1], len(docs), sum(map(len, ids)) // 4))

    docs, ids, size = [], [], 0
    for batch in batches:
        for doc, got in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
            docs.append(doc)
            ids.append(got + last)
            size += len(ids[-1]) // 4
            if size >= shard_tokens:
                flush(docs, ids)
                docs, ids, size = [], [], 0
    if docs:
        flush(docs, ids)
    if shards:
        yield pa.RecordBatch.from_pydict(dict(zip(("shard", "n_docs", "n_tokens"), map(list, zip(*shards)))),
                                         schema=arrow_type("shard string, n_docs bigint, n_tokens bigint"))


def write(df: DataFrame, folder: str, path: str, pieces: str | None = "words", end: int | None = None,
          id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every whole text and write DAC files in ascending id order; returns the manifest, one row for each file.

    One range shuffle on the id orders the documents; a task then writes its own range, in files of at most about
    ``shard_tokens`` tokens. Files get their place by rename, so that an attempt that is lost or repeated leaves the same
    files. Null texts are empty, rows with a null id come first, repeated rows are each written, other columns are ignored. An empty table
    gives an empty manifest. ``start`` is the number of tokens in all files before this one.
    """
    spark = df.sparkSession
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    ordered = documents(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(ordered.mapInArrow(partial(_write, folder=folder, path=path, pieces=pieces, end=end, shard_tokens=shard_tokens),
                                         "shard string, n_docs bigint, n_tokens bigint"), "manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each file, some hundred MB of text
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = _store(folder)
    schema = arrow_type("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    for batch in batches:
        for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
            with store.open_input_file(f"{base}/{shard}") as source:
                reader = Reader(source.read_buffer())
            ids = memoryview(reader.decode().astype("<u4").tobytes())
            for first in range(0, reader.docs, 512):
                many = range(first, min(first + 512, reader.docs))
                parts = [bytes(ids[4 * reader.starts[k]:4 * reader.starts[k + 1]]) for k in many]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": [None if d == NO_ID else d for d in reader.doc_ids[first:many.stop].tolist()], "start": reader.starts[first:many.stop] + start,
                    "n_tokens": [len(p) // 4 for p in parts], "ids_crc32": [zlib.crc32(p) for p in parts], "ids": parts}, schema=schema)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The documents of the files of ``manifest``: doc_id, start, n_tokens, ids_crc32, and the ids as bytes (u32, little endian)."""
    files = manifest.select("shard", "start")
    n = max(1, min(files.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return files.repartitionByRange(n, "shard").mapInArrow(
        partial(_read, folder=folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def digests(spark: SparkSession, df: DataFrame, path: str, pieces: str | None, end: int | None, **columns) -> DataFrame:
    """Write ``df`` to a new folder of the shared one and return doc_id, start, n_tokens and ids_crc32 as read back."""
    folder = shared_folder(spark, "dac")
    return read(write(df, folder, path, pieces, end, **columns), folder).drop("ids")
