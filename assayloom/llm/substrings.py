"""Substring dedup by fixed-block anchors.

Reference blocks of BLOCK words are indexed without overlap, at every multiple
of BLOCK in each document; every rolling window of BLOCK words probes them. Any
passage of 2 * BLOCK - 1 words holds a whole reference block, wherever it
stands, so a repeat of WINDOW = 13 = 2 * 7 - 1 words cannot be missed. Hits are
then extended: a hit's windows of 13 words look for their first copy (the least
doc_id, by 96 bits of two independent hashes), and neighbours whose copies are
neighbours join to maximal repeats (place, place of the copy, length), which no
word before or after prolongs. Each is checked on its words: both sides' 128-bit
digests must agree, else the run fails. A window counts as repeated if its first
copy is in a document with a smaller doc_id.

Data flow: documents are frozen into chunk rows of bounded size. Each chunk
sends, to a bounded number of hash parts, its distinct probes once (30 bits
each: a false hit only costs a comparison later) and gets one bit a probe back;
then its distinct candidate windows once, with their first copy in the chunk,
and gets the first copies that are elsewhere back. A passage that a third of all
documents hold is thus one entry a chunk, its repeats are one request to check,
and no pairs of documents are ever made.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, discard, grams, materialize

WINDOW, BLOCK = 13, 7
_LAST = (1 << 63) - 1
_LOW = np.uint64((1 << 30) - 1)


def freeze(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, n_bytes, payload): documents (doc_id, text) packed in rows of about chunk_bytes of text."""

    def run(it):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        held, size, seq, part = [], 0, 0, TaskContext.get().partitionId()

        def out():
            ids = np.array([_LAST if d is None else d for d, _ in held], np.int64)
            none = np.array([d is None for d, _ in held], np.uint8)
            raw = [t.encode("utf-8", "surrogatepass") for _, t in held]
            body = struct.pack("<q", len(held)) + ids.tobytes() + none.tobytes() + np.array(list(map(len, raw)), np.int64).tobytes() + b"".join(raw)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([size]), pa.array([press.compress(body)], pa.binary())], ["chunk", "n_bytes", "payload"])

        for batch in batches(it, chunk_bytes):
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                t = t or ""
                held.append((d, t))
                size += len(t) + 8
                if size >= chunk_bytes:
                    yield out()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, n_bytes long, payload binary")


class Chunk:
    """A frozen chunk's documents, words and windows."""

    def __init__(self, payload: bytes, parts: int):
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(payload)
        (n,) = struct.unpack_from("<q", raw)
        self.ids = np.frombuffer(raw, np.int64, n, 8)
        self.none = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(bool)
        size = np.frombuffer(raw, np.int64, n, 8 + 9 * n)
        at = 8 + 17 * n + np.concatenate([[0], np.cumsum(size)])
        self.texts = [raw[a:b] for a, b in zip(at, at[1:])]
        w = Words([t.decode("utf-8", "surrogatepass") for t in self.texts])
        self.first, self.parts = w.first, parts
        self.h = (w.hashes(0), w.hashes(1))
        self.doc = w.doc_of_word()
        self.place = np.arange(len(self.doc)) - w.first[self.doc] if len(self.doc) else self.doc

    def _whole(self, n: int) -> np.ndarray:
        """Whether the n words from each place lie in one document."""
        m = len(self.doc) - n + 1
        return self.doc[n - 1 :] == self.doc[:m] if m > 0 else np.zeros(0, bool)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of rolling windows, their distinct (part, 30-bit hash) in order, and each place's entry."""
        at = np.flatnonzero(self._whole(BLOCK))
        h = grams(self.h[0], BLOCK)[at] if len(at) else np.zeros(0, np.uint64)
        key = (((h >> np.uint64(32)) % np.uint64(self.parts)) << np.uint64(30)) | (h & _LOW)
        entries, of = np.unique(key, return_inverse=True)
        return at, entries, of

    def candidates(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows that hold a probe with a hit; distinct keys (part, 64 bits, 32 bits), entry of each start, each entry's least doc_id and its first start there."""
        whole = self._whole(WINDOW)
        if not len(whole):
            z = np.zeros(0, np.int64)
            return z, np.zeros(0, _KEY), z, z, z
        near = np.concatenate([[0], np.cumsum(hit)])
        s = np.arange(len(whole))
        at = np.flatnonzero(whole & (near[s + WINDOW - BLOCK + 1] > near[s]))
        a, b = grams(self.h[0], WINDOW)[at], grams(self.h[1], WINDOW, 1)[at]
        key = np.empty(len(at), _KEY)
        key["part"] = (b >> np.uint64(32)) % np.uint64(self.parts)
        key["a"], key["b"] = a, b & np.uint64(0xFFFFFFFF)
        order = np.lexsort((key["b"], key["a"], key["part"]))
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        of = np.empty(len(k), np.int64)
        of[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        own = self.ids[self.doc[at]]
        least = np.minimum.reduceat(own[order], first) if len(first) else np.zeros(0, np.int64)
        where = np.minimum.reduceat(np.where(own[order] == least[of[order]], at[order], _LAST), first) if len(first) else np.zeros(0, np.int64)
        return at, k[new], of, least, where


_KEY = np.dtype([("part", "<u4"), ("a", "<u8"), ("b", "<u4")])


def _bits(rows, parts: np.ndarray, n: int) -> tuple[np.ndarray, list]:
    """The flags of n entries from (part, packed bits, more) rows, and (entries, more) of rows with more; entries are ordered by part."""
    out, rest = np.zeros(n, bool), []
    edge = np.searchsorted(parts, np.arange(int(parts[-1]) + 2)) if n else None
    for part, bits, more in rows or ():
        a, b = edge[part], edge[part + 1]
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        if more:
            rest.append((a + np.flatnonzero(out[a:b]), more))
    return out, rest


def _pairs(column, k: int) -> list[tuple[int, bytes, bytes | None]]:
    return [(x["part"], x["bits"], x["more"]) for x in column[k].as_py() or ()]


def _split(parts: np.ndarray):
    """Runs (part, start, stop) of an ascending array."""
    edge = np.flatnonzero(np.diff(parts)) + 1 if len(parts) else []
    for a, b in zip([0, *edge], [*edge, len(parts)]):
        if b > a:
            yield int(parts[a]), int(a), int(b)


def _answers(sent: DataFrame, decide) -> DataFrame:
    """(chunk, flags): decide(chunks, data) per part says which entries of each chunk hit, and bytes to send back with them."""

    def run(pdf):
        hits = decide(pdf["chunk"].to_numpy(), pdf["data"].tolist())
        rows = [(c, p, np.packbits(h).tobytes(), more) for c, p, (h, more) in zip(pdf["chunk"], pdf["part"], hits) if h.any()]
        return pd.DataFrame(rows, columns=["chunk", "part", "bits", "more"])

    back = sent.groupBy("part").applyInPandas(run, "chunk long, part int, bits binary, more binary")
    return back.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits", "more")).alias("flags"))


def _repeated(chunks: np.ndarray, data: list[bytes]) -> list[tuple[np.ndarray, None]]:
    """Probes that stand twice or more, one of them as a reference block."""
    parts = [np.frombuffer(d, np.uint32) for d in data]
    flat = np.concatenate(parts)
    order = np.argsort(flat >> np.uint32(2), kind="stable")
    h = flat[order]
    r = h >> np.uint32(2)
    first = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
    times = np.add.reduceat(1 + ((h >> np.uint32(1)) & np.uint32(1)).astype(np.int64), first)
    aligned = np.bitwise_or.reduceat(h & np.uint32(1), first)
    ok = np.empty(len(flat), bool)
    ok[order] = np.repeat((times > 1) & (aligned > 0), np.diff([*first, len(r)]))
    return [(x, None) for x in np.split(ok, np.cumsum([len(p) for p in parts])[:-1])]


def _smaller(chunks: np.ndarray, data: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
    """Windows that also stand in another chunk under a smaller doc_id, and where their first copies are: chunk and place of each."""
    import zstandard

    parts = [_unpack_windows(d) for d in data]
    size = [len(p[0]) for p in parts]
    a, b, d, w = (np.concatenate(x) for x in zip(*parts))
    of = np.repeat(np.arange(len(size)), size)
    # equal windows together, the least doc_id's first; of rows of one doc_id in several chunks the least chunk's
    order = np.lexsort((w, chunks[of], d, b, a))
    sa, sb, sd = a[order], b[order], d[order]
    first = np.concatenate([[0], np.flatnonzero((np.diff(sa) != 0) | (np.diff(sb) != 0)) + 1])
    head = np.repeat(order[first], np.diff([*first, len(sd)]))
    ok, copy = np.empty(len(a), bool), np.empty(len(a), np.int64)
    ok[order], copy[order] = d[head] < sd, head
    press, out, at = zstandard.ZstdCompressor(level=1), [], 0
    for n in size:
        h = ok[at : at + n]
        c = copy[at : at + n][h]
        out.append((h, press.compress(chunks[of[c]].astype("<i8").tobytes() + w[c].astype("<u4").tobytes()) if len(c) else None))
        at += n
    return out


def _pack_windows(k: np.ndarray, least: np.ndarray, where: np.ndarray) -> bytes:
    """Keys, doc_ids, the latter as small offsets where their range allows, and places."""
    base = int(least.min())
    width = 4 if int(least.max()) - base < 1 << 32 else 8
    return struct.pack("<qBq", base, width, len(k)) + np.ascontiguousarray(k["a"]).tobytes() + np.ascontiguousarray(k["b"]).tobytes() + where.astype("<u4").tobytes() + (least - base).astype(f"<u{width}").tobytes()


def _unpack_windows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    base, width, n = struct.unpack_from("<qBq", raw)
    a = np.frombuffer(raw, "<u8", n, 17)
    b, w = np.frombuffer(raw, "<u4", n, 17 + 8 * n), np.frombuffer(raw, "<u4", n, 17 + 12 * n)
    return a, b, np.frombuffer(raw, f"<u{width}", n, 17 + 16 * n).astype(np.int64) + base, w


def found_windows(chunk: Chunk, flags: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's candidates under the probes' flags."""
    at, entries, of = chunk.probes()
    hit = np.zeros(len(chunk.doc), bool)
    if len(at):
        hit[at] = _bits(flags, (entries >> np.uint64(30)).astype(np.int64), len(entries))[0][of]
    return chunk.candidates(hit)


def maximal_repeats(chunk: Chunk, number: int, flags: list, flags2: list) -> np.ndarray:
    """Rows (place, chunk of the first copy, place there, words) of the chunk's maximal repeats with documents of smaller doc_ids."""
    import zstandard

    at, keys, of, least, where = found_windows(chunk, flags)
    if not len(at):
        return np.zeros((0, 4), np.int64)
    elsewhere, more = _bits(flags2, keys["part"].astype(np.int64), len(keys))
    far, place = np.full(len(keys), number), where.copy()
    for entries, raw in more:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        far[entries] = np.frombuffer(raw, "<i8", len(entries))
        place[entries] = np.frombuffer(raw, "<u4", len(entries), 8 * len(entries))
    again = elsewhere[of] | (least[of] < chunk.ids[chunk.doc[at]])
    at, far, place = at[again], far[of[again]], place[of[again]]
    if not len(at):
        return np.zeros((0, 4), np.int64)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(far) != 0) | (np.diff(place) != 1)]))
    return np.stack([at[new], far[new], place[new], np.diff([*new, len(at)]) + WINDOW - 1], axis=1)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _check(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(far, place, words) of those requests (far, place, words, digest) whose words in chunk far have another digest."""

    def run(it):
        for batch in it:
            for k in range(batch.num_rows):
                c = Chunk(batch.column("payload")[k].as_py(), 1)
                words = [w for t in c.texts for w in t.split()]
                bad = [r for r in batch.column("asked")[k].as_py() if _digest(words[r["place"] : r["place"] + r["words"]]) != r["digest"]]
                number = batch.column("chunk")[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(bad), pa.int64()), pa.array([r["place"] for r in bad], pa.int64()), pa.array([r["words"] for r in bad], pa.int64())], ["far", "place", "words"])

    asked = requests.groupBy("far", "place", "words", "digest").agg(F.count("*")).groupBy("far").agg(F.collect_list(F.struct("place", "words", "digest")).alias("asked"))
    return chunks.select("chunk", "payload").join(asked, F.col("chunk") == F.col("far")).select("chunk", "payload", "asked").mapInArrow(run, "far long, place long, words long")


def substring_dedup(docs: DataFrame, chunk_bytes: int = 4 << 20, part_bytes: int = 6 << 20, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept], repeats) of each row of docs (doc_id, text).

    Words covered by a window of 13 words that also starts in a document with a
    smaller doc_id are removed; kept words are joined by one space. repeats: the
    row's maximal repeats, which cover those words. Null and empty texts have no
    words. Rows without doc_id come after all others, and rows of one doc_id are
    one document, whose repeats stay. An empty table gives no rows; other columns
    take no part. chunk_bytes and part_bytes bound what a task holds: a chunk is
    about chunk_bytes of text, or one longer document.
    """
    spark = docs.sparkSession
    chunks = materialize(freeze(docs, chunk_bytes))
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / part_bytes))

    def send_probes(it):
        for batch in it:
            for k in range(batch.num_rows):
                c = Chunk(batch.column("payload")[k].as_py(), parts)
                at, entries, of = c.probes()
                if not len(at):
                    continue
                many = np.bincount(of, minlength=len(entries)) > 1
                aligned = np.zeros(len(entries), bool)
                aligned[of[c.place[at] % BLOCK == 0]] = True
                data = ((entries & _LOW) << np.uint64(2) | many.astype(np.uint64) << np.uint64(1) | aligned).astype(np.uint32)
                runs = list(_split((entries >> np.uint64(30)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("chunk")[k].as_py()] * len(runs), pa.int64()), pa.array([p for p, _, _ in runs], pa.int32()), pa.array([data[a:b].tobytes() for _, a, b in runs], pa.binary())], ["chunk", "part", "data"])

    hits = materialize(_answers(chunks.select("chunk", "payload").mapInArrow(send_probes, "chunk long, part int, data binary"), _repeated))

    def send_windows(it):
        for batch in it:
            for k in range(batch.num_rows):
                c = Chunk(batch.column("payload")[k].as_py(), parts)
                _, keys, _, least, where = found_windows(c, _pairs(batch.column("flags"), k))
                runs = list(_split(keys["part"].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("chunk")[k].as_py()] * len(runs), pa.int64()), pa.array([p for p, _, _ in runs], pa.int32()), pa.array([_pack_windows(keys[a:b], least[a:b], where[a:b]) for _, a, b in runs], pa.binary())], ["chunk", "part", "data"])

    marked = chunks.select("chunk", "payload").join(hits, "chunk")
    copies = materialize(_answers(marked.mapInArrow(send_windows, "chunk long, part int, data binary"), _smaller).withColumnRenamed("flags", "flags2"))
    request = pa.struct([("far", pa.int64()), ("place", pa.int64()), ("words", pa.int64()), ("digest", pa.binary())])
    span = pa.struct([("start", pa.int64()), ("words", pa.int64())])

    def finish(it):
        for batch in it:
            for k in range(batch.num_rows):
                c, number = Chunk(batch.column("payload")[k].as_py(), parts), batch.column("chunk")[k].as_py()
                found = maximal_repeats(c, number, _pairs(batch.column("flags"), k), _pairs(batch.column("flags2"), k))
                edge = np.zeros(len(c.doc) + 1, np.int64)
                np.add.at(edge, found[:, 0], 1)
                np.add.at(edge, found[:, 0] + found[:, 3], -1)
                gone = np.cumsum(edge[:-1]) > 0
                own = np.searchsorted(found[:, 0], c.first)
                rows, asked = [], set()
                for i, (a, b) in enumerate(zip(c.first[:-1].tolist(), c.first[1:].tolist())):
                    words, g = c.texts[i].split(), gone[a:b]
                    n, here = int(g.sum()), found[own[i] : own[i + 1]].tolist()
                    asked.update((far, place, m, _digest(words[s - a : s - a + m])) for s, far, place, m in here)
                    kept = b" ".join([words[j] for j in np.flatnonzero(~g)] if n else words)
                    rows.append((None if c.none[i] else int(c.ids[i]), b - a, n, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "replace")] * keep_text, [{"start": s - a, "words": m} for s, _, _, m in here], None))
                rows[0] = (*rows[0][:-1], [dict(zip(("far", "place", "words", "digest"), x)) for x in asked])
                types = [*[pa.int64()] * 3, *[pa.string()] * (1 + keep_text), pa.list_(span), pa.list_(request)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [*names, "requests"])

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text, "repeats"]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text + ", repeats array<struct<start: long, words: long>>, requests array<struct<far: long, place: long, words: long, digest: binary>>"
    both = chunks.select("chunk", "payload").join(hits.join(copies, "chunk", "left"), "chunk", "left")
    done = materialize(both.mapInArrow(finish, schema))
    discard(hits, copies)
    wrong = _check(done.where("requests is not null").select(F.explode("requests").alias("r")).select("r.*"), chunks).count()
    if wrong:
        raise RuntimeError(f"{wrong} repeats differ in their words though their windows' hashes agree")
    discard(chunks)
    return done.select(*names)
