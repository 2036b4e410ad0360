"""Communities of a weighted graph by modularity: local moving, aggregation and refinement, as joins over edge tables.

Modularity is the share of the edges' weight inside communities less what it
would be if edges fell at random: sum(in / 2m - resolution * (total / 2m) ** 2)
over communities, where total adds up their nodes' weighted degrees and m is the
weight of all edges. A level moves nodes to the neighbouring community that gains
most, by the communities' totals of the round before, and then makes each
community a node of the next level. When no level gains any more, single nodes
move once again between the final communities.

A round is three grouped joins over the edge table. A seeded hash picks the half
of the nodes that may move in it, as neighbours that move together would miss
each other; a level that ends lower than it began is tried with a quarter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .graph import components

#: A gain of modularity under this counts as none.
LEAST = 1e-7


def modularity(nodes: DataFrame, edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of labels (node, community) over nodes (node) and edges (src, dst, weight), each edge once; loops count twice in degrees."""
    both, degree = _graph(nodes, edges)
    return _score(both, degree, labels.select(F.col("node").alias("n"), F.col("community").alias("c")), resolution)


def _graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, w) of every edge in both directions, and (n, k, loop) of every node: its weighted degree, and twice the weight of its loops."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    both = e.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(e.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    both = stored(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "communities")
    loops = e.where("src = dst").groupBy(F.col("src").alias("n")).agg((2 * F.sum("w")).alias("loop"))
    return both, stored(_degrees(nodes.select(F.col("node").alias("n")), both, loops), "communities")


def _degrees(nodes: DataFrame, both: DataFrame, loops: DataFrame) -> DataFrame:
    k = both.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("_k"))
    d = nodes.join(k.hint("merge"), "n", "left").join(loops.hint("merge"), "n", "left").withColumn("loop", F.coalesce("loop", F.lit(0.0)))
    return d.select("n", (F.coalesce("_k", F.lit(0.0)) + F.col("loop")).alias("k"), "loop")


def _score(both: DataFrame, degree: DataFrame, label: DataFrame, resolution: float) -> float:
    m2 = degree.agg(F.sum("k")).first()[0] or 0.0
    if not m2:
        return 0.0
    ends = both.join(label.select(F.col("n").alias("a"), F.col("c").alias("_c")).hint("merge"), "a").join(label.select(F.col("n").alias("b"), F.col("c").alias("_d")).hint("merge"), "b")
    inside = ends.agg(F.coalesce(F.sum(F.when(F.col("_c") == F.col("_d"), F.col("w"))), F.lit(0.0)).alias("v"))
    totals = degree.join(label.hint("merge"), "n").groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s"))
    x = inside.crossJoin(totals).crossJoin(degree.agg(F.sum("loop").alias("l"))).first()
    return (x["v"] + x["l"]) / m2 - resolution * x["s"] / m2**2


def _round(both: DataFrame, degree: DataFrame, label: DataFrame, m2: float, resolution: float, pick) -> DataFrame:
    """label after one round, with gains: whether the node would gain by moving."""
    near = both.join(label.select(F.col("n").alias("b"), "c").hint("merge"), "b").select(F.col("a").alias("n"), "c", "w")
    totals = degree.join(label.hint("merge"), "n").groupBy("c").agg(F.sum("k").alias("t"))
    # a node's own community counts even if no neighbour is in it
    ways = near.unionByName(label.select("n", "c", F.lit(0.0).alias("w"))).groupBy("n", "c").agg(F.sum("w").alias("w"))
    own = label.join(degree.select("n", "k").hint("merge"), "n").select("n", F.col("c").alias("_c"), "k")
    stays = F.col("c") == F.col("_c")
    gain = F.col("w") - F.lit(resolution / m2) * F.col("k") * (F.col("t") - F.when(stays, F.col("k")).otherwise(0.0))
    # sums may differ in their last digits from run to run
    j = ways.join(own.hint("merge"), "n").join(totals.hint("merge"), "c").withColumn("g", F.round(gain, 9))
    best = j.groupBy("n").agg(F.max_by("c", F.struct("g", stays.cast("int"), F.xxhash64("c"), "c")).alias("to"), F.first("_c").alias("c"))
    gains = F.col("to") != F.col("c")
    return best.select("n", F.when(gains & pick(F.col("n")), F.col("to")).otherwise(F.col("c")).alias("c"), gains.alias("gains"))


def _settle(both: DataFrame, degree: DataFrame, label: DataFrame, m2: float, resolution: float, rounds: int, seed: int, parts: int) -> DataFrame:
    """Labels after rounds of local moving, or as soon as no node gains by it."""
    for r in range(rounds):
        pick = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), n), F.lit(parts)) == 0  # noqa: B023, E731
        label = stored(_round(both, degree, label.select("n", "c"), m2, resolution, pick), "communities")
        if label.where("gains").isEmpty():
            break
    return label.select("n", "c")


def _better(both, degree, label, score, m2, resolution, rounds, seed) -> tuple[DataFrame, float] | None:
    """Labels of a higher modularity than score, and theirs, if local moving finds any."""
    for parts in (2, 4):
        new = _settle(both, degree, label, m2, resolution, rounds * parts // 2, seed, parts)
        found = _score(both, degree, new, resolution)
        if found > score + LEAST:
            return new, found
        if found >= score - LEAST:
            return None
    return None


def find_communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42, levels: int = 12, rounds: int = 12) -> DataFrame:
    """(node, community) of nodes (node) and edges (src, dst, weight): a partition of high modularity, the same for the same seed.

    A community is named by its smallest node, hangs together, and keeps nodes
    that were contracted before whole. Nodes without edges are their own
    community; weights are positive, parallel edges add up. Null nodes raise.
    """
    first = both, degree = _graph(nodes, edges)
    m2 = degree.agg(F.sum("k")).first()[0] or 0.0
    final = stored(nodes.select(F.col("node").alias("n"), F.col("node").alias("c")), "communities")
    score = _score(both, degree, final, resolution)
    for level in range(levels if m2 else 0):
        # a level's nodes are named by the labels of the level before
        alone = degree.select("n", F.col("n").alias("c"))
        got = _better(both, degree, alone, score, m2, resolution, rounds, seed + level)
        if not got:
            break
        label, score = got
        final = stored(final.join(label.select(F.col("n").alias("c"), F.col("c").alias("_c")).hint("merge"), "c").select("n", F.col("_c").alias("c")), "communities")
        a, b = (label.select(F.col("n").alias(x), F.col("c").alias(f"_{x}")) for x in "ab")
        merged = stored(both.join(a.hint("merge"), "a").join(b.hint("merge"), "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")), "communities")
        inner = merged.where("a = b").select(F.col("a").alias("n"), "w").unionByName(degree.join(label.hint("merge"), "n").select(F.col("c").alias("n"), F.col("loop").alias("w")))
        both = merged.where("a <> b")
        degree = stored(_degrees(label.select(F.col("c").alias("n")).distinct(), both, inner.groupBy("n").agg(F.sum("w").alias("loop"))), "communities")
    if m2 and (got := _better(*first, final, score, m2, resolution, rounds, seed + levels)):
        final = got[0]
    # what does not hang together is told apart, and named by its smallest node
    a, b = (final.select(F.col("n").alias(x), F.col("c").alias(y)) for x, y in (("src", "_s"), ("dst", "_d")))
    inner = edges.select("src", "dst").join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("_s = _d").select("src", "dst")
    return components(nodes.select("node"), inner).select("node", F.col("component").alias("community"))
