"""Graphs as edge tables: components, contraction, communities and comparisons of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored
from .order import numbered


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable. Labels spread to neighbours and then to labels' labels, so rounds grow with the logarithm of a path's length."""
    both = stored(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct())
    label = stored(nodes.select(F.col(node).alias("n"), F.col(node).alias("c")))
    for _ in range(max_rounds):
        near = both.join(label.hint("merge"), both.b == label.n).groupBy("a").agg(F.min("c").alias("m"))
        low = label.join(near.hint("merge"), label.n == near.a, "left").select("n", F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = low.select(F.col("n").alias("_n"), F.col("c").alias("_c"))
        new = stored(low.join(jump.hint("merge"), low.c == jump._n, "left").select("n", F.coalesce("_c", "c").alias("c")))
        changed = new.join(label.withColumnRenamed("c", "was").hint("merge"), "n").where("c <> was").limit(1).count()
        discard(label)
        label = new
        if not changed:
            discard(both)
            return label.select(F.col("n").alias(node), F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def contract(edges: DataFrame, node_of: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) between the groups of node_of (node, component): parallel edges merge (greatest weight), loops go."""
    s, d = node_of.select(F.col("node").alias("src"), F.col("component").alias("_s")), node_of.select(F.col("node").alias("dst"), F.col("component").alias("_d"))
    e = edges.join(s.hint("merge"), "src").join(d.hint("merge"), "dst").where("_s <> _d")
    return e.select(F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst"), "weight").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def communities(nodes: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """(node, community) by modularity, see communities.py. It keeps hard links whole only if they were contracted before."""
    from .communities import find_communities

    return find_communities(nodes, edges, **how)


def leader_clusters(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, leader): greedy clusters, the node with most neighbours in the whole graph first (smallest on ties).

    In each round the nodes lead that no leader precedes among their neighbours
    and none that may still lead; their later neighbours can't lead any more, and
    follow the first of their leaders once no earlier one can come. So all leaders
    of a round are taken at once, as one node after the other would be. A round
    decides the first open node of each part at least; raises if max_rounds do
    not decide all.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct()
    rank = nodes.select(F.col("node").alias("n")).distinct().join(both.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("d")), "n", "left")
    order = F.struct((-F.coalesce("d", F.lit(0))).alias("d"), F.col("n").alias("n"))
    # l: the first leader among the neighbours before, as far as they are known
    open_ = stored(rank.select("n", order.alias("p")).withColumn("l", F.when(F.lit(False), F.col("p"))), "graph")
    # neighbours b before a that may still lead
    near = stored(both.join(open_.select(F.col("n").alias("a"), F.col("p").alias("pa")), "a").join(open_.select(F.col("n").alias("b"), F.col("p").alias("pb")), "b").where("pb < pa").select("a", "b", "pb"), "graph")
    done = None
    for _ in range(max_rounds):
        leads = stored(open_.where("l is null").select("n").join(near.select(F.col("a").alias("n")).distinct(), "n", "left_anti"), "graph")
        led = near.join(leads.withColumnRenamed("n", "b"), "b").groupBy(F.col("a").alias("n")).agg(F.min("pb").alias("_l"))
        rest = open_.join(leads, "n", "left_anti").join(led, "n", "left").select("n", "p", F.least("l", "_l").alias("l"))
        rest = stored(rest, "graph")
        near = stored(near.join(rest.where("l is null").select(F.col("n").alias("b")), "b", "left_semi"), "graph")
        first = near.groupBy(F.col("a").alias("n")).agg(F.min("pb").alias("w"))
        settled = F.col("l").isNotNull() & (F.col("w").isNull() | (F.col("l") < F.col("w")))
        rest = stored(rest.join(first, "n", "left").withColumn("done", settled), "graph")
        now = leads.select("n", F.col("n").alias("leader")).unionByName(rest.where("done").select("n", F.col("l.n").alias("leader")))
        done = now if done is None else done.unionByName(now)
        open_ = rest.where("not done").select("n", "p", "l")
        if open_.isEmpty():
            return done.select(F.col("n").alias("node"), "leader")
    raise RuntimeError(f"leader clusters did not settle in {max_rounds} rounds")


def crossing_edges(edges: DataFrame, bucket_of: DataFrame, bucket: str) -> DataFrame:
    """One row: edges, those between different buckets, and their share."""
    s, d = bucket_of.select(F.col("node").alias("src"), F.col(bucket).alias("_s")), bucket_of.select(F.col("node").alias("dst"), F.col(bucket).alias("_d"))
    j = edges.select("src", "dst").join(s.hint("merge"), "src").join(d.hint("merge"), "dst")
    return j.agg(F.count("*").alias("n_edges"), F.count_if(F.col("_s") != F.col("_d")).alias("n_crossing")).withColumn("share", F.coalesce(F.try_divide("n_crossing", "n_edges"), F.lit(0.0)))


def coassociation(df: DataFrame, key: str, voters: list[str]) -> DataFrame:
    """(i, j, agreements, votes, share) of pairs that some voter puts together; share of the voters that have both."""
    has = sum((F.when(F.col(v).isNotNull(), F.lit(1 << b)).otherwise(F.lit(0)) for b, v in enumerate(voters)), F.lit(0))
    long = df.select(F.col(key).alias("k"), has.alias("m"), F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).cast("string").alias("c")) for v in voters])).alias("x")).select("k", "m", "x.v", "x.c").where("c is not null")
    a, b = long.select("v", "c", F.col("k").alias("i"), F.col("m").alias("_a")), long.select("v", "c", F.col("k").alias("j"), F.col("m").alias("_b"))
    p = a.join(b, ["v", "c"]).where("i < j").groupBy("i", "j").agg(F.count("*").alias("agreements"), F.first(F.bit_count(F.col("_a").bitwiseAND(F.col("_b")))).cast("long").alias("votes"))
    return p.withColumn("share", F.col("agreements") / F.col("votes"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, ari) of two partitions over the rows that both have."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    two = lambda c: c * (c - 1) / 2
    cells = both.groupBy(a, b).count()
    x = cells.agg(F.sum(two(F.col("count"))).alias("s"), F.sum("count").alias("n"))
    ra = cells.groupBy(a).agg(F.sum("count").alias("c")).agg(F.sum(two(F.col("c"))).alias("sa"))
    rb = cells.groupBy(b).agg(F.sum("count").alias("c")).agg(F.sum(two(F.col("c"))).alias("sb"))
    t = x.crossJoin(ra).crossJoin(rb)
    expected = F.col("sa") * F.col("sb") / two(F.col("n"))
    return t.select("n", F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"))


def with_singletons(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(node, community): nodes that table lacks get numbers after the greatest one, in node order."""
    j = nodes.select("node").join(table.select("node", "community"), "node", "left")
    top = table.agg(F.coalesce(F.max("community"), F.lit(-1)).alias("_top"))
    fresh = numbered(j.where("community is null").select("node"), [F.col("node")], "_r").crossJoin(F.broadcast(top)).select("node", (F.col("_top") + F.col("_r") + 1).alias("community"))
    return j.where("community is not null").unionByName(fresh)


def edge_union(*edges: DataFrame) -> DataFrame:
    """(src, dst) of all edge tables, each pair once and with the smaller node first; weights are dropped."""
    out = None
    for e in edges:
        one = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst")
        out = one if out is None else out.union(one)
    return out.distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree) of a union graph; nodes without edges are kept with 0."""
    e = edge_union(edges)
    d = e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def average_linkage(pairs: DataFrame, nodes: DataFrame, n_clusters: int, most: int = 5000) -> DataFrame:
    """(node, cluster): average linkage on 1 - share of pairs (i, j, share), absent pairs at distance 1, until n_clusters are left.

    Runs on the driver over a matrix of at most most nodes squared; more raise.
    Clusters are numbered by their smallest node.
    """
    import numpy as np

    names = sorted(r[0] for r in nodes.select("node").limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} nodes; contract the graph first")
    at = {x: k for k, x in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for r in pairs.toLocalIterator():
        d[at[r["i"]], at[r["j"]]] = d[at[r["j"]], at[r["i"]]] = 1 - r["share"]
    np.fill_diagonal(d, np.inf)
    size, of = np.ones(len(names)), np.arange(len(names))
    for _ in range(max(0, len(names) - n_clusters)):
        a, b = sorted(divmod(int(d.argmin()), len(names)))
        merged = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[a], d[:, a], d[b], d[:, b] = merged, merged, np.inf, np.inf
        d[a, a] = np.inf
        size[a] += size[b]
        of[of == b] = a
    number = {c: k for k, c in enumerate(dict.fromkeys(of.tolist()))}
    rows = [(x, number[int(c)]) for x, c in zip(names, of)]
    return nodes.sparkSession.createDataFrame(rows, nodes.select(F.col("node"), F.lit(0).alias("cluster")).schema)
