"""The whole split, from assay records to test and folds, without near duplicates across them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from . import graph as G
from .aggregates import distinct_or_conflict
from .communities import find_communities
from .identity import identity_graph
from .similarity import first_links
from .splits import SplitError, cluster_buckets, cluster_rollup
from .structures import fingerprint_links


@dataclass
class SplitPlan:
    """What near duplicates are, and how much goes where."""

    fingerprint: float = 0.8
    fingerprint_hard: float = 0.95
    radius: int = 2
    n_bits: int = 2048
    identity: float = 0.6
    identity_hard: float = 0.9
    test: float = 0.2
    folds: int = 5
    weight_special: float = 8.0
    weight_active: float = 0.0
    tries: int = 40_000
    seed: int = 42


class _Stages:
    """Tables of named stages in one folder; a stage whose table is there already is read instead of made."""

    def __init__(self, spark, folder: str, plan: SplitPlan):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        # tables of another plan are not those of this one
        text = json.dumps(asdict(plan), sort_keys=True)
        if self._is("plan"):
            if spark.read.text(f"{folder}/plan").first()[0] != text:
                raise SplitError(f"{folder} holds the stages of another plan")
        else:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/plan")

    def _is(self, name: str) -> bool:
        return self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/_SUCCESS"))

    def __call__(self, name: str, make) -> DataFrame:
        if not self._is(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


def build_split(records: DataFrame, plan: SplitPlan | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, facts) of assay records (peptide_id, sequence, smiles, special, active).

    rows: (peptide_id, community, split, fold_id, special) of every peptide.
    Peptides are near duplicates by the fingerprints of their structures or by
    the identity of their sequences. Those with equal structures or sequences, or
    beyond the hard thresholds, are one node; communities of the nodes stay
    whole, and are dealt to test and folds by numbers of records and the shares
    of special and active ones. Sequences with a placeholder and structures that
    can't be read give no edges. facts: (fact, value) with sizes, the largest
    community's share, and the edges of each kind that cross, of which hard links
    have none. A peptide whose records differ in sequence, structure or special
    raises, as does an empty table. Stages are tables in folder, from which a run
    that was stopped goes on.
    """
    plan, spark = plan or SplitPlan(), records.sparkSession
    stage = _Stages(spark, folder or new_path(spark, "split"), plan)
    same = ["sequence", "smiles", "special"]
    units = stage("units", lambda: distinct_or_conflict(records, "peptide_id", same, {"n_rows": F.count("*"), "n_active": F.count_if("active")}))
    facts = units.agg(F.count("*").alias("n"), F.count_if("conflict").alias("bad"), F.min(F.when(F.col("conflict"), F.col("peptide_id"))).alias("first")).first()
    if not facts["n"]:
        raise SplitError("no records")
    if facts["bad"]:
        raise SplitError(f"{facts['bad']} peptides have records that differ, the first of them {facts['first']}")
    edge = lambda d: d.select(F.col("i").alias("src"), F.col("j").alias("dst"), "similarity")

    def identities():
        links, classes = identity_graph(units, "peptide_id", "sequence", plan.identity)
        copies = classes.where("key <> first").select(F.col("first").alias("i"), F.col("key").alias("j"), F.lit(1.0).alias("similarity"))
        return edge(links.unionByName(copies))

    by_print = stage("fingerprint_edges", lambda: edge(fingerprint_links(units, "peptide_id", "smiles", plan.fingerprint, plan.radius, plan.n_bits)))
    by_identity = stage("identity_edges", identities)
    # a placeholder stands for different residues, so that it makes no sequences equal
    known = units.select("peptide_id", "smiles", F.when(~F.contains(F.upper("sequence"), F.lit("X")) & (F.length("sequence") > 0), F.upper("sequence")).alias("sequence"))
    equal = first_links(known, "peptide_id", ["smiles", "sequence"]).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    hard = stage("hard_links", lambda: G.edge_union(equal, by_print.where(F.col("similarity") >= plan.fingerprint_hard), by_identity.where(F.col("similarity") >= plan.identity_hard)))
    nodes = units.select(F.col("peptide_id").alias("node"))
    node_of = stage("nodes", lambda: G.components(nodes, hard))
    union = G.edge_union(by_print, by_identity).withColumn("weight", F.lit(1.0))
    contracted = stage("contracted", lambda: G.contract(union, node_of))
    found = stage("communities", lambda: find_communities(node_of.select(F.col("component").alias("node")).distinct(), contracted, seed=plan.seed))
    unit_of = units.join(node_of.withColumnRenamed("node", "peptide_id").hint("merge"), "peptide_id").join(found.withColumnRenamed("node", "component").hint("merge"), "component")

    def dealt():
        rows = records.select("peptide_id", "special", "active").join(unit_of.select("peptide_id", "community").hint("merge"), "peptide_id")
        return cluster_buckets(rows, "community", "special", "active", plan.test, plan.folds, weight_special=plan.weight_special, weight_active=plan.weight_active, tries=plan.tries, seed=plan.seed)

    places = stage("places", dealt)
    rows = unit_of.select("peptide_id", "community", "special", "n_rows", "n_active").join(places.hint("merge"), "community")
    table = stage("rows", lambda: rows)
    bucket = table.select(F.col("peptide_id").alias("node"), F.concat_ws("_", "split", F.col("fold_id").cast("string")).alias("bucket"))

    def crossings():
        out = table.agg(F.count("*").cast("double").alias("peptides"), F.sum("n_rows").cast("double").alias("records"), F.countDistinct("community").cast("double").alias("communities"))
        out = out.crossJoin(node_of.agg(F.countDistinct("component").cast("double").alias("hard_groups")))
        out = out.crossJoin(cluster_rollup(table, "community", "special", "special").agg((F.max("size") / F.sum("size")).alias("largest_share")))
        out = out.crossJoin(units.agg(F.count_if(F.contains(F.upper("sequence"), F.lit("X"))).cast("double").alias("with_placeholder")))
        for name, links in (("fingerprint", by_print), ("identity", by_identity), ("hard", hard)):
            out = out.crossJoin(G.crossing_edges(links, bucket, "bucket").select(F.col("n_edges").cast("double").alias(f"{name}_edges"), F.col("n_crossing").cast("double").alias(f"{name}_crossing")))
        shares = table.groupBy(F.concat_ws("_", "split", F.col("fold_id").cast("string")).alias("b")).agg(F.sum("n_rows").alias("r"), F.sum(F.when(F.col("special"), F.col("n_rows")).otherwise(0)).alias("s"), F.sum("n_active").alias("a"))
        long = out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).alias("value")) for c in out.columns])).alias("x")).select("x.*")
        per = shares.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{n}_of_"), "b").alias("fact"), v.cast("double").alias("value")) for n, v in (("records", F.col("r")), ("special_share", F.col("s") / F.col("r")), ("active_share", F.col("a") / F.col("r")))])).alias("x")).select("x.*")
        return long.unionByName(per)

    facts = stage("facts", crossings)
    return table.select("peptide_id", "community", "split", "fold_id", "special"), facts
