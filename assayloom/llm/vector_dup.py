"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and split into
BLOCKS low-dimensional blocks. Two vectors whose squared distance is at most
B = 2 - 2 * cosine have a block in which it is at most B / BLOCKS, so a range
join of every block under that budget finds all pairs. A block's range join is
a grid over its first coordinates, two more at a time, and only where a cell is
crowded: a vector goes to every cell that its box of half the radius touches,
hence both vectors of a pair go to the cell of their midpoint. Candidates are
verified by cosine on the whole vectors. A pair is counted once: in its first
block within the budget, in its midpoint's cell.

Rows that only carry ids and a block's coordinates find the cells; the vectors
join the settled cells once. Equal vectors are one class with a count. Cells
still crowded at the last axis are compared in pairs of blocks of bounded size,
which send back link counts and a spanning forest of their links, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, materialize, mix64, parts_for

BLOCKS, AXES, STEP = 4, 12, 2


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(unit: np.ndarray) -> np.ndarray:
    """unit @ rotation, summed in a fixed order so that a vector's result never depends on its neighbours."""
    turn, out = rotation(unit.shape[1]), np.zeros(unit.shape)
    for j in range(unit.shape[1]):
        out += unit[:, j : j + 1] * turn[j]
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """x times a power of two by row, with components under 1: exact, and no square of it overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def block_edges(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def radius(cosine: float, dim: int) -> float:
    return float(np.sqrt((2 - 2 * cosine + 1e-9) / min(BLOCKS, dim)))


def cells(rot: np.ndarray, code: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for all cells, within the cell code of each row, that a box of half-width r / 2 around the row of rot touches."""
    half, side = r / 2 * (1 + 1e-9) + 1e-12, _side(r)
    lo, hi = np.floor((rot - half) / side).astype(np.int64), np.floor((rot + half) / side).astype(np.int64)
    who = np.arange(len(rot))
    for a in range(rot.shape[1]):
        two = np.flatnonzero((hi > lo)[who, a])
        c = lo[who, a]
        who, code = np.concatenate([who, who[two]]), np.concatenate([_within(code, c), _within(code[two], c[two] + 1)])
    return who, code


def _within(code: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A 64-bit name of the cell c within the cell code."""
    return mix64(code.astype(np.uint64) * np.uint64(2654435761) + (c + 1024).astype(np.uint64)).astype(np.int64)


def middle(a: np.ndarray, b: np.ndarray, r: float) -> np.ndarray:
    """The cell that holds the midpoint of rows of a and b."""
    at = np.floor((a + b) / 2 / _side(r)).astype(np.int64)
    code = np.zeros(len(a), np.int64)
    for k in range(a.shape[1]):
        code = _within(code, at[:, k])
    return code


def _side(r: float) -> float:
    """Twice the radius, and at least what keeps an axis within 1000 cells."""
    return max(2 * r, 1 / 500)


def _linked(x: np.ndarray, cosine: float, block: np.ndarray, axes: np.ndarray, cell: np.ndarray, side: np.ndarray, runs: list[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with cosine within runs (start, stop, whether only pairs across sides), that belong to the run's block and cell."""
    x, u = scaled(x), units(x)
    found_a, found_b = [], []
    for s, t, across in runs:
        if across:
            rows, cols = s + np.flatnonzero(side[s:t] == 0), s + np.flatnonzero(side[s:t] == 1)
            a, b = np.nonzero(u[rows] @ u[cols].T >= cosine - 1e-9)
            a, b = rows[a], cols[b]
        else:
            a, b = np.nonzero(u[s:t] @ u[s:t].T >= cosine - 1e-9)
            a, b = a[a < b] + s, b[a < b] + s
        if len(a):
            found_a.append(a)
            found_b.append(b)
    if not found_a:
        z = np.zeros(0, np.int64)
        return z, z
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    dim = x.shape[1]
    edges, r = block_edges(dim), radius(cosine, dim)
    size = np.sqrt((x * x).sum(axis=1))
    used = np.unique(np.concatenate([a, b]))
    rot = np.zeros_like(x)
    rot[used] = rotated(u[used])
    keep = np.zeros(len(a), bool)
    for i in range(0, len(a), 1 << 15):
        p, q = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
        ok = (x[p] * x[q]).sum(axis=1) / (size[p] * size[q]) >= cosine
        gap = (rot[p] - rot[q]) ** 2
        own, first = block[p], np.full(len(p), -1)
        for k in range(len(edges) - 2, -1, -1):
            first = np.where(gap[:, edges[k] : edges[k + 1]].sum(axis=1) <= r * r, k, first)
        ok &= first == own
        for k, n in {(int(k), int(n)) for k, n in zip(own[ok], axes[p[ok]])}:
            here = np.flatnonzero(ok & (own == k) & (axes[p] == n))
            lead = slice(edges[k], edges[k] + n)
            ok[here] = middle(rot[p[here], lead], rot[q[here], lead], r) == cell[p[here]]
        keep[i : i + (1 << 15)] = ok
    return a[keep], b[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of pairs that form a spanning forest."""
    top: dict[int, int] = {}

    def find(c):
        while top.setdefault(c, c) != c:
            top[c] = c = top[top[c]]
        return c

    out, most = [], len(np.unique(np.concatenate([a, b]))) - 1 if len(a) else 0
    for i, (s, t) in enumerate(zip(a.tolist(), b.tolist())):
        s, t = find(s), find(t)
        if s != t:
            top[s] = t
            out.append(i)
            if len(out) == most:
                break
    return out


def _edges(t: pa.Table, names: list[str]) -> list[int]:
    """Ends of the runs of equal values of the named columns."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for c in names:
        x = t.column(c)
        x = np.array(x.to_pylist(), dtype=object) if c == "label" else x.to_numpy()
        new |= x[1:] != x[:-1]
    return [*(np.flatnonzero(new) + 1).tolist(), t.num_rows] if t.num_rows else []


def _compare(t: pa.Table, ends: list[int], cosine: float, kind: np.dtype):
    """Link counts and forests of whole runs, in slices of one dimension and some thousand rows."""
    starts, dim = [0, *ends[:-1]], t.column("dim").to_numpy()
    at = 0
    while at < len(ends):
        to = at
        while to < len(ends) and dim[starts[to]] == dim[starts[at]] and (to == at or ends[to] - starts[at] <= 8192):
            to += 1
        s, e = starts[at], ends[to - 1]
        part = t.slice(s, e - s)
        v, no, rep, n = part.column("v").to_pylist(), *(part.column(c).to_numpy() for c in ("no", "rep", "n"))
        x = np.frombuffer(b"".join(v), kind).reshape(len(v), -1).astype(np.float64)
        i, j = part.column("i").to_numpy(), part.column("j").to_numpy()
        runs = [(starts[k] - s, ends[k] - s, i[starts[k] - s] != j[starts[k] - s]) for k in range(at, to) if ends[k] - starts[k] > 1]
        a, b = _linked(x, cosine, *(part.column(c).to_numpy() for c in ("b", "axes", "cell", "side")), runs)
        at = to
        if not len(a):
            continue
        more = np.zeros(len(v), np.int64)
        np.add.at(more, a, n[b])
        np.add.at(more, b, n[a])
        own, tree = np.flatnonzero(more), _forest(a, b)
        zeros, none = np.zeros(len(tree), np.int64), np.full(len(own), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((no[own], zeros), (more[own], zeros), (none, rep[a[tree]]), (none, rep[b[tree]]))], ["no", "more", "src", "dst"])


def near_vectors(vectors: DataFrame, cosine: float = 0.98, crowd: int = 1024, part_rows: int = 1 << 15) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Vectors of one non-null label and one length are linked if their cosine, in
    double precision, is at least the given one. Null, empty and zero vectors
    and those with a null or non-finite component are linked with nothing, like
    rows without label. n_links counts other rows, equal ones among them;
    component_id is the smallest vec_id reachable; rows of one vec_id are one
    vector in components; a null vec_id has no links and no component and is
    kept. An empty table gives no rows; other columns take no part. crowd: rows
    from which a cell is divided; part_rows: rows that a task compares.
    """
    spark = vectors.sparkSession
    wide = isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    kind = np.dtype("<f8" if wide else "<f4")

    def read(it):
        for batch in it:
            col = batch.column("embedding")
            flat, at = col.values.to_numpy(zero_copy_only=False).astype(kind), col.offsets.to_numpy()
            none, out = col.is_null().to_pylist(), []
            for i, gone in enumerate(none):
                v = flat[at[i] : at[i + 1]]
                out.append(None if gone or not len(v) or not np.isfinite(v).all() or not v.any() else (v + kind.type(0)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "v"])

    rows = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").mapInArrow(read, "vec_id long, label string, v binary"))
    classes = rows.where("v is not null and label is not null and vec_id is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()))

    def spread(it):
        for batch in it:
            v = batch.column("v").to_pylist()
            size = np.array([len(x) // kind.itemsize for x in v])
            for dim in np.unique(size).tolist():
                own = np.flatnonzero(size == dim)
                rot, edges = rotated(units(np.frombuffer(b"".join(v[i] for i in own), kind).reshape(-1, dim).astype(np.float64))), block_edges(dim)
                for b in range(len(edges) - 1):
                    lead = rot[:, edges[b] : min(edges[b] + AXES, edges[b + 1])]
                    yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(own)), batch.column("no").take(pa.array(own)), pa.array(np.full(len(own), dim), pa.int32()), pa.array(np.full(len(own), b), pa.int32()), pa.array(np.zeros(len(own)), pa.int32()), pa.array(np.zeros(len(own), np.int64)), pa.array([x.tobytes() for x in lead], pa.binary())], ["label", "no", "dim", "b", "axes", "cell", "lead"])

    def divide(it):
        for batch in it:
            size = np.array([len(x) // 8 for x in batch.column("lead").to_pylist()])
            dims, axes = batch.column("dim").to_numpy(), batch.column("axes").to_numpy()
            for dim, at, n in {(int(d), int(a), int(m)) for d, a, m in zip(dims, axes, size)}:
                own = np.flatnonzero((dims == dim) & (axes == at) & (size == n))
                lead = np.frombuffer(b"".join(batch.column("lead").take(pa.array(own)).to_pylist()), np.float64).reshape(-1, n)
                who, code = cells(lead[:, at : at + STEP], batch.column("cell").to_numpy()[own], radius(cosine, dim))
                out = batch.take(pa.array(own[who]))
                yield out.set_column(out.schema.get_field_index("axes"), "axes", pa.array(np.full(len(who), min(at + STEP, n)), pa.int32())).set_column(out.schema.get_field_index("cell"), "cell", pa.array(code))

    key = ["label", "dim", "b", "axes", "cell"]
    schema = "label string, no long, dim int, b int, axes int, cell long, lead binary"
    open_, settled = materialize(classes.select("label", "no", "v").mapInArrow(spread, schema)), []
    while open_ is not None:
        counts = open_.groupBy(*key).agg(F.count("*").alias("rows"), (F.max(F.octet_length("lead")) / 8).alias("most")).where((F.col("rows") > crowd) & (F.col("axes") < F.col("most"))).select(*key)
        counts = materialize(counts)
        settled.append(open_.join(counts, key, "left_anti").drop("lead"))
        # a crowded cell's rows are dealt anew by their numbers, so that one cell is no one task
        open_ = None if counts.isEmpty() else materialize(open_.join(counts, key, "left_semi").select("label", "no", "dim", "b", "axes", "cell", "lead").mapInArrow(divide, schema))
    dealt = settled[0]
    for more in settled[1:]:
        dealt = dealt.unionByName(more)
    crowded = dealt.groupBy(*key).count().where(F.col("count") > crowd).withColumn("parts", F.ceil(F.col("count") / crowd).cast("int")).drop("count")
    cut = dealt.join(crowded, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = materialize(cut.select(*key, F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).cast("int").alias("side"), "no"))
    # cells of one row hold no pair
    alone = cut.groupBy(*key, "i", "j").count().where("count > 1").drop("count")
    cut = cut.join(alone, [*key, "i", "j"], "left_semi").join(classes.select("no", "rep", "n", "v"), "no")

    def compare(it):
        held = None
        for batch in it:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            ends = _edges(held, [*key, "i", "j"])
            if len(ends) > 1:
                yield from _compare(held.slice(0, ends[-2]), ends[:-1], cosine, kind)
                held = held.slice(ends[-2])
        if held is not None and held.num_rows:
            yield from _compare(held, _edges(held, [*key, "i", "j"]), cosine, kind)

    parts = parts_for(spark, cut.count(), part_rows)
    found = materialize(cut.repartition(parts, *key, "i", "j").sortWithinPartitions("dim", "label", "b", "axes", "cell", "i", "j").mapInArrow(compare, "no long, more long, src long, dst long"))
    links = found.where("more > 0").groupBy("no").agg(F.sum("more").alias("more"))
    comp = components(found.where("more = 0").select("src", "dst"))
    final = classes.join(links, "no", "left").join(comp, classes.rep == comp.id, "left").select("label", "v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("_comp"))
    cid = F.when(F.col("vec_id").isNotNull(), F.coalesce("_comp", "vec_id"))
    single = F.col("vec_id").isNull()
    return rows.join(final, ["label", "v"], "left").select("vec_id", F.when(single, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(cid == F.col("vec_id"), F.lit(True)).alias("kept"))
