"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A segment is one byte string: a header, the ids as one little-endian array of
16 or 32 bits, the Elias-Fano code of the boundaries (where each document ends)
and the Elias-Fano code of the doc_ids, which ascend. Elias-Fano keeps the low
bits of each value packed and the high bits as a unary bit vector, so n values
up to u take about n * (2 + log2(u / n)) bits. The position of the i-th set bit
(select) gives value i back: a directory in the file says how many bits are set
before each block of 512, and within one block bytes are counted. It adds 32
bits to 512, and no table of 64-bit offsets is ever made; readers select the
offsets of as many documents as they are about to return. Segments are rows of a
Parquet table (part, seq, n_ids, payload), hence any store that Spark can write
holds them and Spark's commit protocol protects them from lost executors.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, parts_for
from .tokens import encoder

MAGIC = b"EFTK"
_HEAD = struct.Struct("<4sBQQQq")  # magic, bytes an id, documents, ids, documents with a null doc_id, least doc_id


_BLOCK = 64  # bytes of the bit vector for one entry of the directory
#: Place of set bit k in each byte value; 8 if there is none.
_IN_BYTE = np.array([(*(b for b in range(8) if v >> b & 1), *[8] * 8)[:8] for v in range(256)], np.uint8)


def ef_encode(values: np.ndarray) -> bytes:
    """Code of ascending non-negative integers: n, u, low bits, high bits in unary, directory."""
    v = np.asarray(values, dtype=np.uint64)
    n, u = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (u // n).bit_length() - 1) if n else 0
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    ones = np.zeros(-(-(n + (u >> low) + 1) // (8 * _BLOCK)) * 8 * _BLOCK, np.uint8)
    ones[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    high = np.packbits(ones, bitorder="little")
    counts = np.bitwise_count(high).reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint32)
    directory = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
    return struct.pack("<QQB", n, u, low) + np.packbits(bits, bitorder="little").tobytes() + b"\0" * 9 + high.tobytes() + directory.tobytes()


class EliasFano:
    """Read access to ef_encode's bytes from offset at; end is where they stop."""

    def __init__(self, raw: bytes, at: int = 0):
        self.n, self.u, self.low = struct.unpack_from("<QQB", raw, at)
        at += 17
        self.low_bits = np.frombuffer(raw, np.uint8, (self.n * self.low + 7) // 8 + 9, at)
        at += len(self.low_bits)
        blocks = -(-(self.n + (self.u >> self.low) + 1) // (8 * _BLOCK))
        self.high_bits = np.frombuffer(raw, np.uint8, blocks * _BLOCK, at).reshape(blocks, _BLOCK)
        at += blocks * _BLOCK
        self.directory = np.frombuffer(raw, "<u4", blocks, at)
        self.end = at + 4 * blocks

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values i, each from the directory, its block's byte counts and its byte."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.directory, i, side="right") - 1
        left = i - self.directory[block]
        upto = np.cumsum(np.bitwise_count(self.high_bits[block]), axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(axis=1)
        left -= np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0)[:, None], axis=1)[:, 0], 0)
        place = block * (8 * _BLOCK) + byte * 8 + _IN_BYTE[self.high_bits[block, byte], left]
        at = i * self.low
        word = self.low_bits[(at >> 3)[:, None] + np.arange(9)]
        shift = (at & 7).astype(np.uint64)
        bits = np.ascontiguousarray(word[:, :8]).view("<u8")[:, 0] >> shift
        bits |= np.where(shift > 0, word[:, 8].astype(np.uint64) << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((place - i).astype(np.uint64) << np.uint64(self.low)) | (bits & np.uint64((1 << self.low) - 1))


def encode_segment(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One segment; doc_ids ascend, nulls first. Raises if an id does not fit width bytes."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    ends, flat = np.cumsum([len(x) for x in ids], dtype=np.uint64), np.concatenate(ids)
    if len(flat) and int(flat.max()) >> (8 * width):
        raise ValueError(f"id {int(flat.max())} does not fit {width} bytes")
    # differences of int64 are taken modulo 2 ** 64, as the code holds unsigned values
    return _HEAD.pack(MAGIC, width, len(ids), len(flat), nulls, least) + flat.astype(f"<u{width}").tobytes() + ef_encode(ends) + ef_encode(known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1))


class Segment:
    """Reads a segment: spans and doc_ids of documents a to b - 1, and the ids of document i."""

    def __init__(self, raw: bytes):
        magic, width, self.n, total, self.nulls, self.least = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.ids = np.frombuffer(raw, f"<u{width}", total, _HEAD.size)
        self.bounds = EliasFano(raw, _HEAD.size + total * width)
        self.known = EliasFano(raw, self.bounds.end)

    def spans(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of documents a to b - 1 in ids, by select."""
        edge = self.bounds.select(np.arange(max(a - 1, 0), b)).astype(np.int64)
        edge = edge if a else np.concatenate([[0], edge])
        return edge[:-1], edge[1:]

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        known = self.known.select(np.arange(max(a, self.nulls), b) - self.nulls) if b > self.nulls else np.zeros(0, np.uint64)
        return [None] * max(0, min(b, self.nulls) - a) + (known + np.uint64(self.least & (1 << 64) - 1)).astype(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        (a,), (b,) = self.spans(i, i + 1)
        return self.ids[a:b]


def write_token_files(docs: DataFrame, out: str, path: str, kind: str, end_id: int, segment_bytes: int = 8 << 20, part_bytes: int = 128 << 20) -> None:
    """Write documents (doc_id, text) as segments to the Parquet folder out, in ascending doc_id order.

    Null and empty texts are the end id alone; rows without a doc_id come first;
    equal doc_ids and repeated rows are documents of their own, in order of their
    texts; an empty table makes no segment; other columns take no part. An id
    takes two bytes if the vocabulary allows, else four. segment_bytes bounds
    the text of a segment (a longer document is a segment of its own), part_bytes
    is what a task writes on average.
    """

    def run(it):
        enc = encoder(path, kind)
        seq = 0
        for batch in batches(it, segment_bytes):
            ids = [np.append(x, np.uint32(end_id)) for x in enc.encode([t or "" for t in batch.column("text").to_pylist()])]
            raw = encode_segment(batch.column("doc_id").to_pylist(), ids, enc.dtype.itemsize)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("part")[0].as_py()], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(map(len, ids))], pa.int64()), pa.array([raw], pa.large_binary())], ["part", "seq", "n_ids", "payload"])
            seq += 1

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts_for(docs.sparkSession, d.agg(F.sum(F.octet_length("text"))).first()[0] or 0, part_bytes)
    ordered = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(run, "part int, seq int, n_ids long, payload binary").write.option("compression", "uncompressed").parquet(out)


def read_token_files(spark, out: str, at_once: int = 4096) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in write_token_files' folder.

    start counts the ids of all documents before it. Segment totals are summed
    per part, then over the parts, so no task orders the whole table. at_once:
    documents whose offsets are selected together.
    """
    seg = spark.read.parquet(out)
    sums = seg.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    bases = seg.select("part", "seq", "n_ids").join(parts, "part").withColumn("base", F.col("before") + F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "seq", "base")

    def run(it):
        for batch in it:
            part, seq = batch.column("part").to_pylist(), batch.column("seq").to_pylist()
            for k in range(batch.num_rows):
                s = Segment(batch.column("payload")[k].as_py())
                for a in range(0, s.n, at_once):
                    b = min(s.n, a + at_once)
                    starts, ends = s.spans(a, b)
                    crc = [zlib.crc32(s.ids[x:y].astype("<u4").tobytes()) for x, y in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([part[k]] * (b - a), pa.int32()), pa.array([seq[k]] * (b - a), pa.int32()), pa.array(s.doc_ids(a, b), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = seg.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
