"""MinHash near-dedup by a multi-index Hamming join.

A text's shingles give a signature of SYMBOLS b-bit minima, split into CHUNKS
chunks of SPAN symbols. Two signatures that differ in at most FAR = 2 * CHUNKS - 1
symbols have a chunk with at most one error (pigeonhole), so indexing each chunk
under its SPAN subsets without one symbol (the allowed error enumerated) finds
every pair within FAR. At a similarity of 0.8, 9.6 of 48 symbols differ on
average and more than 23 in 3.3 pairs of a million. Pairs within FAR are then
confirmed on full shingle sets.

Texts with equal sets are one class. Candidates of a bucket are first compared
with its leader, so a group of s near copies costs s comparisons; buckets that
still hold several components are compared by signatures in blocks of bounded
size, and only pairs across components and within FAR are confirmed on sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, components, grams, materialize, mix64, parts_for

CHUNKS, SPAN, BITS = 12, 4, 24
SYMBOLS, FAR = SPAN * CHUNKS, 2 * CHUNKS - 1
_SEEDS = mix64(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, A-Z lower-cased; of the whole sequence if it has fewer words."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = grams(h, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, SYMBOLS) b-bit minima of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.int32)
    for k in range(SYMBOLS):
        v = (flat ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1))
        v ^= v >> np.uint64(29)
        low = np.minimum.reduceat(v * np.uint64(0xBF58476D1CE4E5B9), at)
        out[:, k] = (mix64(low) & np.uint64((1 << BITS) - 1)).astype(np.int32)
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, n: int, keep: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of each row of docs (doc_id, text).

    digest and sig are null for empty sets, which null, empty and blank texts
    have. Rows are taken one by one, so null and repeated doc_ids and other
    columns make no difference; keep names a column of longs that is copied.
    """
    own = [keep] * bool(keep)

    def run(it):
        for batch in batches(it, 2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full])):
                    sig[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(sig, pa.list_(pa.int32())), *[batch.column(c) for c in own]],
                ["doc_id", "n_shingles", "digest", "sig", *own],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig array<int>" + f", `{keep}` long" * bool(keep))


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, set): full sets of the wanted documents."""

    def run(it):
        for batch in batches(it, 2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "set"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.join(wanted.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(run, "rep long, set binary")


def _similar(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def _with_leaders(pairs: DataFrame, sets: DataFrame, percent: int, salt: int = 128) -> DataFrame:
    """Links (src, dst) among pairs (rep, leader): a leader's members are dealt over groups of about salt rows."""
    sizes = pairs.groupBy("leader").count().withColumn("salts", F.ceil(F.col("count") / salt).cast("int")).drop("count")
    dealt = pairs.join(sizes.hint("merge"), "leader").withColumn("s", F.pmod(F.xxhash64("rep"), F.col("salts")))
    members = dealt.join(sets.hint("merge"), "rep").select("leader", "s", "rep", "set")
    heads = sizes.select(F.col("leader").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s")).join(sets.hint("merge"), "rep").select(F.col("rep").alias("leader"), F.col("s").cast("long").alias("s"), "rep", "set")

    def run(pdf):
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        own = (pdf["rep"] == pdf["leader"]).to_numpy()
        rest = [i for i in range(len(sets)) if not own[i]]
        found = []
        for h in np.flatnonzero(own):
            if rest:
                head, flat = sets[h], np.concatenate([sets[i] for i in rest])
                at = np.minimum(np.searchsorted(head, flat), len(head) - 1)
                size = np.array([len(sets[i]) for i in rest])
                both = np.add.reduceat((head[at] == flat).astype(np.int64), np.cumsum([0, *size[:-1]]))
                ok = _similar(both, size, len(head), percent)
                found += [(pdf["rep"].iloc[i], pdf["leader"].iloc[0]) for i, k in zip(rest, ok) if k]
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return members.unionByName(heads).groupBy("leader", "s").applyInPandas(run, "src long, dst long")


def _owner(same: np.ndarray) -> np.ndarray:
    """For pairs' symbol agreements (pairs, SYMBOLS): the first index variant under which both stand."""
    per = same.reshape(len(same), CHUNKS, SPAN)
    chunk = (per.sum(axis=2) >= SPAN - 1).argmax(axis=1)
    own = per[np.arange(len(same)), chunk]
    return chunk * SPAN + np.where(own.all(axis=1), 0, own.argmin(axis=1))


def _near_in_blocks(buckets: DataFrame, block: int = 2048) -> DataFrame:
    """(key, i, j, b, rep, comp) of rows with a partner within FAR and in another component, by pairs of blocks (i, j) of a bucket; b is the row's own.

    buckets: (key, variant, rep, comp, sig). A bucket's largest component has
    blocks of its own (numbers under 0), which only meet those of the others:
    one large group of copies is read once however few rows stand beside it. A
    pair that shares several buckets is looked at in the first of them only.
    """
    sizes = buckets.groupBy("key", "comp").count().groupBy("key").agg(F.sum("count").alias("n"), F.max(F.struct("count", "comp")).alias("top"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    rest = F.col("n") - F.col("top.count")
    sizes = materialize(sizes.select("key", F.col("top.comp").alias("top"), blocks(F.col("top.count")).alias("big"), blocks(rest).alias("small"), (rest * (F.col("top.count") + rest)).cast("double").alias("work")))
    # tasks by comparisons, as their rows say little about the time that they take
    tasks = parts_for(buckets.sparkSession, int(sizes.agg(F.sum("work")).first()[0] or 0), block * block * 16)
    b = buckets.join(sizes.hint("merge"), "key").withColumn("large", F.col("comp") == F.col("top"))
    b = b.withColumn("b", F.when(F.col("large"), -1 - F.pmod(F.xxhash64("rep"), F.col("big"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("small"))).cast("int"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    across = F.transform(count(F.col("small")), lambda o: pair(F.col("b"), o))
    among = F.concat(F.transform(count(F.col("small")), lambda o: pair(F.least("b", o), F.greatest("b", o))), F.transform(count(F.col("big")), lambda o: pair(-1 - o, F.col("b"))))
    units = b.withColumn("u", F.explode(F.when(F.col("large"), across).otherwise(among))).select("key", "u.i", "u.j", "b", "variant", "rep", "comp", "sig")

    def run(key, pdf):
        rep, comp, b = pdf["rep"].to_numpy(), pdf["comp"].to_numpy(), pdf["b"].to_numpy()
        sig = np.stack(pdf["sig"].to_numpy())
        rows, cols = np.flatnonzero(b == key[1]), np.flatnonzero(b == key[2])
        own = np.zeros(len(pdf), bool)
        for at in range(0, len(rows), 128):  # some rows against all columns, which bounds what pairs take
            some = rows[at : at + 128]
            far = np.zeros((len(some), len(cols)), np.uint8)
            for k in range(SYMBOLS):
                far += sig[some, k][:, None] != sig[cols, k][None, :]
            p, q = np.nonzero((far <= FAR) & (comp[some][:, None] != comp[cols][None, :]))
            p, q = some[p], cols[q]
            for a in range(0, len(p), 1 << 15):
                x, y = p[a : a + (1 << 15)], q[a : a + (1 << 15)]
                ok = _owner(sig[x] == sig[y]) == pdf["variant"].iloc[0]
                own[x[ok]] = own[y[ok]] = True
        return pd.DataFrame({"key": key[0], "i": key[1], "j": key[2], "b": b[own], "rep": rep[own], "comp": comp[own]})

    return units.repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInPandas(run, "key long, i int, j int, b int, rep long, comp long")


def common(a: list[np.ndarray], b: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by products of 0/1 matrices of bounded width."""

    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (x, of_x), (y, of_y) = flat(a), flat(b)
    both = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for v, of in ((x, of_x), (y, of_y)):
        at = np.minimum(np.searchsorted(both, v), max(len(both) - 1, 0))
        keep = both[at] == v if len(both) else np.zeros(len(v), bool)
        order = np.argsort(at[keep], kind="stable")
        sides.append((at[keep][order], of[keep][order]))
    for k in range(0, len(both), width):
        m = []
        for (at, of), n in zip(sides, (len(a), len(b))):
            lo, hi = np.searchsorted(at, [k, k + width])
            one = np.zeros((n, width), np.float32)
            one[of[lo:hi], at[lo:hi] - k] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int32)


def _links_in_units(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) that join the components of each unit (key, i, j), as a forest."""

    def run(key, pdf):
        comp, rep, b = pdf["comp"].to_numpy(), pdf["rep"].to_numpy(), pdf["b"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        size = np.array(list(map(len, sets)), np.int32)
        rows, cols = np.flatnonzero(b == key[1]), np.flatnonzero(b == key[2])
        keep = []
        if len(rows) and len(cols):
            ok = _similar(common([sets[x] for x in rows], [sets[x] for x in cols]), size[rows][:, None], size[cols][None, :], percent)
            ok &= comp[rows][:, None] != comp[cols][None, :]
            top = {c: c for c in comp.tolist()}

            def find(c):
                while top[c] != c:
                    top[c] = c = top[top[c]]
                return c

            for x, near in zip(rows, ok):
                for y in cols[np.flatnonzero(near)]:
                    p, q = find(comp[x].item()), find(comp[y].item())
                    if p != q:
                        top[p] = q
                        keep.append((rep[x], rep[y]))
        return pd.DataFrame(keep, columns=["src", "dst"], dtype="int64")

    return units.join(sets.hint("merge"), "rep").groupBy("key", "i", "j").applyInPandas(run, "src long, dst long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, keep: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept[, keep]) of each row of docs (doc_id, text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their
    sets of n-word shingles; component_id is the smallest doc_id reachable, kept
    says that it is the row's own. Null and empty texts are linked with nothing.
    Rows of one doc_id are one document for links. A row without doc_id has no
    component and is kept. An empty table gives no rows. Rows that agree in all
    columns agree in the result; keep names a column of longs that is copied, by
    which rows can be told apart.
    """
    all_rows = materialize(sketch(docs, n, keep))
    classes = materialize(all_rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min_by("sig", "doc_id").alias("sig"), F.min("doc_id").alias("rep")))
    sub = [(c, [SPAN * c + i for i in range(SPAN) if i != out]) for c in range(CHUNKS) for out in range(SPAN)]
    keys = F.array(*[F.xxhash64(F.lit(at[0] * SYMBOLS * SYMBOLS + at[1] * SYMBOLS + at[2]), *[F.col("sig")[i] for i in at]) for _, at in sub])
    index = classes.select("rep", F.posexplode(keys).alias("variant", "key"))
    heads = index.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("_last")).where("leader <> _last").drop("_last")
    members = materialize(index.join(heads.hint("merge"), "key"))
    sigs = classes.select("rep", "sig")
    apart = F.size(F.filter(F.zip_with("sig", "other", lambda x, y: x != y), lambda x: x))
    first = members.select("rep", "leader").where("rep <> leader").distinct().join(sigs.hint("merge"), "rep").join(sigs.select(F.col("rep").alias("leader"), F.col("sig").alias("other")).hint("merge"), "leader")
    first = materialize(first.where(apart <= FAR).select("rep", "leader"))
    ends = lambda p: p.select("rep").union(p.select("leader")).distinct()
    sets = materialize(_sets(docs, ends(first), n))
    links = materialize(_with_leaders(first, sets, percent))
    comp = components(links)
    named = members.join(comp.hint("merge"), members.rep == comp.id, "left").select("key", "variant", "rep", F.coalesce("component", "rep").alias("comp"))
    # a bucket of two is its leader and one more, which have been compared
    open_ = named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a <> b and n > 2").select("key")
    units = materialize(_near_in_blocks(named.join(open_.hint("merge"), "key").join(sigs.hint("merge"), "rep")))
    if not units.isEmpty():
        wanted = units.select("rep").distinct().join(ends(first).hint("merge"), "rep", "left_anti")
        sets = sets.union(materialize(_sets(docs, wanted, n)))
        links = materialize(links.union(_links_in_units(units, sets, percent)))
        comp = components(links)
    final = classes.select("digest", "rep").join(comp.hint("merge"), classes.rep == comp.id, "left").select("digest", F.coalesce("component", "rep").alias("_comp"))
    out = all_rows.join(final.hint("merge"), "digest", "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"), *[keep] * bool(keep))
