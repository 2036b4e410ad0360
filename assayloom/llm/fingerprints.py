"""Document fingerprints by winnowing.

Rolling hashes of k code points; of each window of w consecutive hashes the
least is chosen, the rightmost one on ties, and kept with its position. Any
passage of at least w + k - 1 code points that two texts share leaves a common
hash in both: 15 with the values here, so every text of 22 code points or more
shares a hash with its edited text, which keeps two thirds of it. A text with
fewer than w hashes is one window, a text shorter than k code points is one
hash, and an empty text has none.

The positions make the guarantee usable: passages() starts from the common
hashes at their kept positions, checks the code points and extends to maximal
shared passages, so it finds every one of w + k - 1 code points or more.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, parts_for

K, W = 8, 8  # powers of two
_BASE = 0x9E3779B97F4A7C15


def winnow(texts: list[str], k: int = K, w: int = W) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chosen 32-bit hashes and their positions for each text, in text order."""
    pad = "\0" * (w + k)
    code = np.frombuffer((pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(n + w + k)[:-1]]) if len(n) else n
    h, step = code.astype(np.uint64) + np.uint64(1), 1
    while step < k:
        h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + count, -1)
    valid = np.cumsum(edge[:-1]).astype(bool)
    # the least hash, then the rightmost place
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    key[~valid] = np.uint64(0xFFFFFFFFFFFFFFFF)
    low, step = key, 1
    while step < w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    out = []
    for a, c in zip(at.tolist(), count.tolist()):
        least = low[a : a + max(1, c - w + 1)] if c else low[:0]
        if len(least):
            least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        out.append(((least >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64) - a))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    x, y = set(a.tolist()), set(b.tolist())
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes array<long>, positions array<long>) of each row of docs (doc_id, text).

    Null and empty texts have empty arrays; null and repeated doc_ids are rows of
    their own; equal texts have equal arrays; an empty table gives no rows. Other
    columns of docs take no part.
    """

    def run(it):
        for batch in batches(it, 2 << 20):
            got = winnow([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def passages(a: str, b: str, k: int = K, w: int = W, print_a: tuple | None = None, print_b: tuple | None = None) -> list[tuple[int, int, int]]:
    """Maximal shared passages (start in a, start in b, length) of at least min(k, both lengths) code points, by start.

    print_a, print_b: the texts' winnow() entries, made here if not given. Every
    shared passage of w + k - 1 code points lies within one that is returned; the
    places of one hash are all paired, so a text that repeats itself has several.
    """
    (ha, pa_), (hb, pb) = (print_a or winnow([a], k, w)[0]), (print_b or winnow([b], k, w)[0])
    at: dict[int, list[int]] = {}
    for h, p in zip(hb.tolist(), pb.tolist()):
        at.setdefault(h, []).append(p)
    out, done = [], {}
    for h, p in zip(ha.tolist(), pa_.tolist()):
        for q in at.get(h, ()):
            if done.get(p - q, -1) > p or a[p : p + k] != b[q : q + k]:
                continue
            i, j, e = p, q, min(k, len(a) - p, len(b) - q)
            while i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            while p + e < len(a) and q + e < len(b) and a[p + e] == b[q + e]:
                e += 1
            done[p - q] = p + e
            out.append((i, j, p + e - i))
    return sorted(out)


def with_next(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt so that descending neighbours meet, with a single shuffle of the texts.

    Adds bucket and copy: rows of a bucket are a run of the descending order
    (null ids last, equal ids by text), and a bucket's copies are the rows that
    may follow its last one: those with the greatest id of the next bucket, or
    of the first after the last. A bucket is looked up in two steps, among every
    root-th head and then between two of them. Null ids are one run of the order
    and hence one bucket.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("k")).repartitionByRange(parts, F.col("k").desc())
    # one number a partition
    tops = sorted((r[0] for r in ids.groupBy(F.spark_partition_id()).agg(F.max("k")).select("max(k)").collect()), reverse=True)
    if not tops:
        return docs.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(False).alias("copy")), 1
    root = math.isqrt(len(tops)) + 1
    heads, coarse = F.array(*[F.lit(t).cast("long") for t in tops]), F.array(*[F.lit(t).cast("long") for t in tops[::root]])
    run = F.greatest(F.size(F.filter(coarse, lambda t: t >= key)) - 1, F.lit(0)) * root
    bucket = F.greatest(run + F.size(F.filter(F.slice(heads, run + 1, F.lit(root)), lambda t: t >= key)) - 1, F.lit(0))
    d = docs.select("doc_id", "text", bucket.alias("_b"))
    copies = F.when(F.element_at(heads, F.col("_b") + 1) == key, F.pmod(F.col("_b") - 1, F.lit(len(tops))))
    own = F.struct(F.col("_b").alias("bucket"), F.lit(False).alias("copy"))
    both = F.when(copies.isNotNull(), F.array(own, F.struct(copies.alias("bucket"), F.lit(True).alias("copy")))).otherwise(F.array(own))
    return d.select("doc_id", "text", F.explode(both).alias("p")).select("doc_id", "text", "p.bucket", "p.copy"), len(tops)


def edited_fingerprints(docs: DataFrame, part_bytes: int = 128 << 20) -> DataFrame:
    """The op2 query's rows: each text's fingerprint beside that of its edited text and of the next document.

    Fingerprints are hashes of 8 hex digits in text order; positions and
    edited_positions are where they stand, written likewise.
    Nulls are empty texts; a null doc_id comes after all others; equal doc_ids
    are in descending order of their texts; a table of one row is its own next;
    an empty table gives no rows. part_bytes: text that a task holds on average.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt, buckets = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts_for(spark, n_bytes, part_bytes))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions string, edited_positions string"

    def run(it):
        last = None  # a row whose next one has not come: (bucket, doc_id, text, hashes, positions)
        for batch in batches(it, 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, edits = [], []
            for b, copy, d, t, (h, p) in zip(batch.column("bucket").to_pylist(), batch.column("copy").to_pylist(), batch.column("doc_id").to_pylist(), texts, winnow(texts)):
                if last is not None and last[0] == b:
                    n = len(last[2])
                    edits.append(last[2][: n - n // 3] + t[: n // 3])
                    rows.append((last[1], n, last[3], h, last[4]))
                    last = None
                if not copy:
                    last = (b, d, t, h, p)
            if rows:
                hexed = lambda x: x.astype(">u4").tobytes().hex()
                other = winnow(edits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]),
                        pa.array([hexed(r[2]) for r in rows]), pa.array([hexed(x) for x, _ in other]),
                        pa.array([likeness(r[2], x) for r, (x, _) in zip(rows, other)]), pa.array([likeness(r[2], r[3]) for r in rows]),
                        pa.array([hexed(r[4]) for r in rows]), pa.array([hexed(p) for _, p in other]),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions"],
                )
        if last is not None:
            raise RuntimeError("a bucket ended without the row that follows it")

    order = ["bucket", "copy", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    return dealt.repartition(buckets, "bucket").sortWithinPartitions(*order).mapInArrow(run, schema)
