"""Merkle manifest of a dataset, with DataFrame functions.

Method: rows are hashed to leaves and numbered within their tree, numbers are
floor-divided by the fanout, and the sorted children of a parent are hashed into
it, level by level; siblings are then appended on the way back from the root.

A pass takes up to 256 sorted nodes as one row and climbs as many levels as they
allow, so that a tree of any size is two passes, or three, instead of a shuffle
for every level; the way down joins each row with the proof of its top only, so
that no proof is shuffled more than once. Numbers come from ranges of the order
and the ranges' counts, so that a tree which holds most rows is spread like any
other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Levels that a pass climbs: 2 ** SPAN sorted nodes are one row.
SPAN = 8
_STEP = "array<struct<left: string, right: string>>"


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values, concatenated as text."""
    return F.sha2(F.concat(*[v.cast("binary") for v in values]), 256)


def field(value: Column) -> Column:
    """A column's value as it enters a leaf: '-' if null, else its number of UTF-8 bytes, ':' and the value."""
    v = value.cast("string")
    return F.when(value.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.octet_length(v).cast("string").cast("binary"), F.lit(":").cast("binary"), v.cast("binary")))


def _places(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df, written in order of (tree, order), with i, the place within the tree, and n, the tree's size. Nulls come first."""
    by = [F.col(tree), *[F.col(c) for c in order]]
    d = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    d = d.withColumn("_p", F.shiftright("_at", 33))
    # a tree's rows stand together in each range; one row a range and tree
    runs = d.groupBy("_p", F.col(tree).alias("_t")).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    over = Window.partitionBy("_t")
    before = F.coalesce(F.sum("_c").over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_p").alias("_q"), "_t", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(over).alias("n"))
    return d.join(runs, (F.col("_p") == F.col("_q")) & F.col(tree).eqNullSafe(F.col("_t"))).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_p", "_q", "_t", "_shift")


def _up(nodes: Column, fanout: int) -> Column:
    """One level's hashes from the level below, an array."""
    child = lambda q, k: F.coalesce(F.get(nodes, (q * fanout + k).cast("int")), F.lit(""))
    parents = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(parents, lambda q: F.sha2(F.concat(*[child(q, k) for k in range(fanout)]), 256))


def _blocks(nodes: DataFrame, depth: Column, at: int, fanout: int, span: int, extra: list[str]) -> DataFrame:
    """(t, b, n, items, levels): sorted runs of fanout ** span nodes (t, i, n, h, extra) and the hashes of all levels above them in this pass.

    depth: levels of the node's tree; at: levels below this pass.
    """
    width = fanout**span
    item = F.struct("i", "h", *extra)
    b = nodes.groupBy("t", F.floor(F.col("i") / width).cast("long").alias("b"), "n").agg(F.array_sort(F.collect_list(item)).alias("items"))
    climbs = F.greatest(F.lit(0), F.least(F.lit(span), depth - at))
    start = F.array(F.transform("items", lambda x: x["h"]))
    steps = F.when(climbs > 0, F.sequence(F.lit(1), climbs)).otherwise(F.array().cast("array<int>"))
    return b.withColumn("levels", F.aggregate(steps, start, lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1), fanout)))))


def _steps(i: Column, fanout: int, span: int) -> Column:
    """The siblings of node i of a run, level by level, as what stands left and right of it."""

    def step(level: Column, k: Column) -> Column:
        node = F.floor(F.pmod(i, F.lit(fanout**span)) / F.pow(F.lit(fanout), k)).cast("int")
        first = (F.floor(node / fanout) * fanout).cast("int")
        left = F.array_join(F.slice(level, first + 1, node - first), "")
        right = F.array_join(F.slice(level, node + 2, first + F.lit(fanout) - node - 1), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), step)


def _depth(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree of n: how often n can be divided, rounded up, until one node is left."""
    bits = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    if fanout == 2:
        return bits
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(n.alias("n"), F.lit(0).alias("d")), lambda acc, _: F.struct(F.ceil(acc["n"] / fanout).alias("n"), (acc["d"] + (acc["n"] > 1).cast("int")).alias("d")))["d"]


def _forest(nodes: DataFrame, extra: list[str], fanout: int, span: int) -> list[DataFrame]:
    """The passes of all trees over nodes (t, i, n, h, extra), from the leaves up; in the last each tree is one row."""
    depth = _depth(F.col("n"), fanout)
    most = nodes.agg(F.max(depth)).first()[0]
    passes = [materialize(_blocks(nodes, depth, 0, fanout, span, extra))]
    for at in range(span, most or 0, span):
        tops = passes[-1].select("t", F.col("b").alias("i"), "n", F.element_at("levels", -1)[0].alias("h"))
        passes.append(materialize(_blocks(tops, depth, at, fanout, span, [])))
    return passes


def _proofs(passes: list[DataFrame], tops: DataFrame, carried: list[str], fanout: int, span: int) -> DataFrame:
    """Items of the lowest pass with proof, the steps from the item to the root. tops: (t, proof, carried) of each tree."""
    above = tops.withColumn("i", F.lit(0).cast("long"))
    for k in range(len(passes) - 1, -1, -1):
        up = above.select(F.col("t").alias("_t"), F.col("i").alias("_i"), F.col("proof").alias("_proof"), *carried)
        j = passes[k].join(up, F.col("t").eqNullSafe(F.col("_t")) & (F.col("b") == F.col("_i")))
        item = j.select("t", "levels", "_proof", *carried, F.explode("items").alias("x"))
        proof = F.concat(_steps(F.col("x.i"), fanout, span), "_proof")
        above = item.select("t", F.col("x.i").alias("i"), proof.alias("proof"), *carried, *([F.col("x")] if k == 0 else []))
        if k:
            above = materialize(above)
    return above


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", count: str = "n_chars", every: int = 7, fanout: int = 2, span: int = SPAN) -> DataFrame:
    """(key, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of each row of docs.

    A leaf is the digest of the row's fields. The leaves of a group, in order of
    key (null first, rows that share a key by leaf), are a tree whose root is the
    group's subroot; subroots in order of group (null first) are the tree of the
    root. proof: the siblings of every level from the leaf to the root, as what
    stands left and right. folded_root is recomputed from the proof and the
    row's leaf, for which count is one more than it was where every divides the
    CRC-32 of the key as decimal text; rows without key or without count stay as
    they were. Fields may be null, empty or very long; rows that agree have equal
    leaves and places of their own; a group of one row is its leaf; an empty
    table gives no rows. Columns other than fields, key, group and count take no
    part, whatever their names. key and group may be of any type that can be ordered.
    """
    leaf = lambda **put: digest(*[field(put.get(c, F.col(c))) for c in fields])
    tampered = F.coalesce((F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(every)) == 0) & F.col(count).isNotNull(), F.lit(False))
    rows = docs.select(F.col(key).alias("id"), F.col(group).alias("t"), leaf().alias("h"), F.when(tampered, leaf(**{count: F.col(count) + 1})).alias("bad"))
    # the number spreads rows that agree in everything over ranges
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    placed = materialize(_places(rows, "t", ["id", "h", "_row"]).drop("_row"))
    discard(rows)
    passes = _forest(placed, ["id", "bad"], fanout, span)
    subroots = passes[-1].select(F.col("t").alias("g"), F.element_at("levels", -1)[0].alias("h"))
    one = materialize(_places(subroots.withColumn("t", F.lit(0)), "t", ["g"]))
    high = _forest(one, ["g"], fanout, span)
    root = high[-1].select(F.lit(0).alias("t"), F.lit(None).cast(_STEP).alias("proof"), F.element_at("levels", -1)[0].alias("root")).withColumn("proof", F.array().cast(_STEP))
    tops = _proofs(high, root, ["root"], fanout, span).select(F.col("x.g").alias("t"), "proof", F.col("x.h").alias("subroot"), "root")
    got = _proofs(passes, materialize(tops), ["subroot", "root"], fanout, span)
    got = got.select(F.col("x.id").alias(key), F.col("x.h").alias("leaf"), F.coalesce("x.bad", "x.h").alias("_used"), "subroot", "root", "proof")
    got = got.withColumn("proof_sha256", digest(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""))).withColumn("folded_root", folded(F.col("_used"), F.col("proof")))
    return got.select(key, "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
