"""Whole-cluster splits: bucket search, greedy prefixes, equal-width folds and their audits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import running


#: Clusters that one driver arranges; each is an entry of some bytes.
MOST_CLUSTERS = 2_000_000


class SplitError(ValueError):
    """Clusters cannot be split as asked."""


@dataclass
class BucketPlan:
    bucket_of: dict
    objective: float
    swaps: int


def assign_buckets(size: dict, special: dict, active: dict, targets: dict[str, float], weight_special: float = 8.0, weight_active: float = 0.0, tries: int = 40_000, seed: int = 42) -> BucketPlan:
    """Clusters to buckets: largest first to the bucket that lacks most rows, then seeded swaps that lower the objective.

    Objective: squared relative size errors, plus weighted squared deviations of
    each bucket's special and active rates from the overall ones. Runs on the
    driver over one entry a cluster, up to MOST_CLUSTERS of them; same input and
    seed give the same result.
    """
    if len(size) > MOST_CLUSTERS:
        raise SplitError(f"{len(size)} clusters are more than {MOST_CLUSTERS}; merge small ones first")
    if not size:
        raise SplitError("no clusters")
    if set(size) != set(special) or set(size) != set(active):
        raise SplitError("cluster keys differ")
    if any(not 0 <= special[c] <= size[c] or not 0 <= active[c] or size[c] <= 0 for c in size):
        raise SplitError("counts out of range")
    if abs(sum(targets.values()) - 1) > 1e-6 or any(t <= 0 for t in targets.values()):
        raise SplitError("targets must be positive and sum to 1")
    names, keys = list(targets), sorted(size, key=lambda c: (-size[c], str(c)))
    at, objective, done = _arrange(np.array([[size[c], special[c], active[c]] for c in keys], dtype=float), targets, weight_special, weight_active, tries, seed)
    return BucketPlan({c: names[b] for c, b in zip(keys, at)}, objective, done)


def _arrange(x: np.ndarray, targets: dict[str, float], weight_special: float = 8.0, weight_active: float = 0.0, tries: int = 40_000, seed: int = 42) -> tuple[np.ndarray, float, int]:
    """The place of each row's bucket, the objective and the swaps; x: size, special and active of each cluster, the largest first."""
    names, keys = list(targets), range(len(x))
    total = x.sum(axis=0)
    goal = np.array([targets[b] for b in names]) * total[0]
    rate = total[1:] / total[0]
    held = np.zeros((len(names), 3))
    at = np.empty(len(keys), int)
    for k, row in enumerate(x):
        b = int(np.argmin(held[:, 0] - goal))
        at[k] = b
        held[b] += row

    def cost(h, g):
        n = max(h[0], 1e-12)
        return ((h[0] - g) / g) ** 2 + weight_special * (h[1] / n - rate[0]) ** 2 + weight_active * (h[2] / n - rate[1]) ** 2

    costs = np.array([cost(held[b], goal[b]) for b in range(len(names))])
    r, done = np.random.default_rng(seed), 0
    picks = r.integers(0, len(keys), (tries, 2))
    for i, j in picks:
        p, q = at[i], at[j]
        if p == q:
            continue
        hp, hq = held[p] - x[i] + x[j], held[q] - x[j] + x[i]
        cp, cq = cost(hp, goal[p]), cost(hq, goal[q])
        if cp + cq < costs[p] + costs[q] - 1e-15:
            held[p], held[q], costs[p], costs[q] = hp, hq, cp, cq
            at[i], at[j] = q, p
            done += 1
    return at, float(costs.sum()), done


def cluster_rollup(df: DataFrame, cluster: str, special: str, active: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("size"), F.count_if(F.col(special)).alias("special"), F.count_if(F.col(active)).alias("active"))


def cluster_buckets(df: DataFrame, cluster: str, special: str, active: str, test: float = 0.2, folds: int = 5, **how) -> DataFrame:
    """(cluster, split, fold_id) of each cluster of df, as stratified_split() deals them. One small row a cluster goes to the driver, in arrays."""
    import pyarrow as pa

    table = cluster_rollup(df, cluster, special, active).limit(MOST_CLUSTERS + 1).toArrow()
    if len(table) > MOST_CLUSTERS:
        raise SplitError(f"more than {MOST_CLUSTERS} clusters; merge small ones first")
    if not len(table):
        raise SplitError("no clusters")
    x = np.stack([table.column(k).to_numpy() for k in (1, 2, 3)], axis=1).astype(float)
    text = np.array(list(map(str, table.column(0).to_pylist())))
    order = np.lexsort((text, -x[:, 0]))
    targets = {"test": test} | {f"fold_{i}": (1 - test) / folds for i in range(folds)}
    at = _arrange(x[order], targets, **how)[0]
    # bucket 0 is the test
    out = pa.table({cluster: table.column(0).take(pa.array(order)), "_b": pa.array(at, pa.int32())})
    places = df.sparkSession.createDataFrame(out, df.select(F.col(cluster), F.lit(0).alias("_b")).schema)
    return places.select(cluster, F.when(F.col("_b") == 0, "test").otherwise("train").alias("split"), F.when(F.col("_b") > 0, F.col("_b") - 1).alias("fold_id"))


def stratified_split(df: DataFrame, cluster: str, special: str, active: str, test: float = 0.2, folds: int = 5, **how) -> DataFrame:
    """df with bucket, split (train or test) and fold_id (null for test); clusters stay whole. One small row a cluster goes to the driver."""
    table = cluster_buckets(df, cluster, special, active, test, folds, **how).withColumnRenamed(cluster, "_c")
    table = table.withColumn("bucket", F.when(F.col("split") == "test", "test").otherwise(F.concat(F.lit("fold_"), F.col("fold_id").cast("string")))).select("_c", "bucket", "split", "fold_id")
    return df.join(table.hint("merge"), df[cluster].eqNullSafe(table._c), "left").drop("_c")


def bucket_stats(df: DataFrame, buckets: DataFrame, bucket: str, special: str) -> DataFrame:
    """Rows and special share of each bucket of the list, 0 for empty ones."""
    g = df.groupBy(bucket).agg(F.count("*").alias("n"), F.avg(F.col(special).cast("int")).alias("share"))
    return buckets.join(g, bucket, "left").select(bucket, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))


def audit(df: DataFrame, bucket: str, special: str, targets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per bucket its share, deviation from target, special rate, deviation from the overall rate, and whether both are within tolerance."""
    g = df.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(F.col(special).cast("int")).alias("_s"))
    every = Window.partitionBy()
    g = g.withColumn("share", F.col("n") / F.sum("n").over(every)).withColumn("rate", F.col("_s") / F.col("n")).withColumn("rate_off", F.col("rate") - F.sum("_s").over(every) / F.sum("n").over(every))
    j = g.join(targets, bucket, "left").withColumn("share_off", F.col("share") - F.col("target"))
    return j.select(bucket, "n", "share", "share_off", "rate", "rate_off", ((F.abs("share_off") <= tolerance) & (F.abs("rate_off") <= tolerance)).alias("balanced"))


def greedy_prefix(groups: DataFrame, order: list, size: str, share: float) -> DataFrame:
    """groups with chosen: whole groups in the given order until their sizes reach the share; the one that crosses it is in. groups: one row a group."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    total = groups.agg(F.sum(size).alias("_all"))
    return running(groups, order, F.col(size), "_before").crossJoin(F.broadcast(total)).withColumn("chosen", F.col("_before") < F.col("_all") * F.lit(share)).drop("_before", "_all")


def cumulative_bins(groups: DataFrame, order: list, size: str, n: int) -> DataFrame:
    """groups with bin 0 to n - 1: equal widths of the running total between its least and greatest value."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    c = running(groups, order, F.col(size), "_c", inclusive=True)
    ends = c.agg(F.min("_c").alias("_low"), F.max("_c").alias("_high"))
    at = F.ceil(F.coalesce(F.try_divide((F.col("_c") - F.col("_low")) * n, F.col("_high") - F.col("_low")), F.lit(0.0))) - 1
    return c.crossJoin(F.broadcast(ends)).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("int")).drop("_c", "_low", "_high")


def hash_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """df with held: a share of the keys by a seeded hash; the same keys in every run and on every cluster."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000))
    return df.withColumn("held", part < F.lit(int(share * 1_000_000)))


def leave_one_out(df: DataFrame, fold: str, n: int) -> DataFrame:
    """Each row once a round of n, with eval_group val in its own fold's round, else fit; all rounds in one plan."""
    return df.withColumn("val_fold_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("eval_group", F.when(F.col(fold) == F.col("val_fold_id"), "val").otherwise("fit"))


def homology_split(nodes: DataFrame, same: list, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((node, component, split), links): whole components in hash order until the test share is reached, the crossing one in.

    same: (table, columns) pairs; rows that agree in one of the columns are
    linked to the first of them and stay on one side. Components are counted, not
    rows, where the prefix is found.
    """
    from .graph import components
    from .similarity import first_links

    links = None
    for table, columns in same:
        one = first_links(table, key, columns).select(F.col("i").alias("src"), F.col("j").alias("dst"))
        links = one if links is None else links.unionByName(one)
    node_of = components(nodes, links)
    sizes = node_of.groupBy("component").agg(F.count("*").alias("n"))
    chosen = greedy_prefix(sizes, [F.md5(F.concat_ws(":", F.lit(seed), F.col("component").cast("string"))), F.col("component")], "n", share)
    split = node_of.join(chosen.select("component", "chosen"), "component").select("node", "component", F.when(F.col("chosen"), "test").otherwise("train").alias("split"))
    return split, links


def sensitivity(size: dict, special: dict, active: dict, targets: dict[str, float], weights: list[float], seeds: list[int], tries: int = 5000) -> list[dict]:
    """The objective and accepted swaps of a bucket search for each weight of the special rate and each seed."""
    out = []
    for w in weights:
        for s in seeds:
            plan = assign_buckets(size, special, active, targets, weight_special=w, tries=tries, seed=s)
            out.append({"weight": w, "seed": s, "objective": plan.objective, "swaps": plan.swaps})
    return out
