"""Queries of the dataset, split, model and evaluation operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import measurements as M
from ..functions import vectors as V
from ..functions.sequences import STRUCTURE_TOKEN
from ..operators import aggregates as A
from ..operators import features as X
from ..operators import graph as G
from ..operators import joins as J
from ..operators import metrics as E
from ..operators import splits as B
from ..operators import training as T
from ..operators import tokenizers as K
from ..operators.order import numbered
from .catalogue import query, r, t

_FITTED = """x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
s AS (SELECT i, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS d FROM x WHERE vec_id % 4 > 0 GROUP BY i)"""


def assembled(spark, sf):
    """Vectors as features, their label as organism, and whether they fit."""
    e = t(spark, sf, "embeddings")
    rows = e.select("vec_id", F.concat(F.lit("org"), (F.col("label") % 7).cast("string")).alias("organism"), F.when(F.col("label") % 2 == 0, "active").otherwise("inactive").alias("y"), (F.col("vec_id") % 4 > 0).alias("fit"))
    rows = rows.withColumn("organism", F.when(~F.col("fit") & (F.col("vec_id") % 8 == 0), F.lit("unseen")).otherwise(F.col("organism")))
    return T.assemble(rows, e.select("vec_id", F.col("embedding").alias("features")), "vec_id", "organism", "y", "active", F.col("fit"))


@query(f"""
WITH {_FITTED}, o AS (SELECT vec_id, CASE WHEN vec_id % 8 = 0 THEN 'unseen' ELSE 'org' || CAST(label % 7 AS VARCHAR) END AS organism, label FROM embeddings),
w AS (SELECT organism, row_number() OVER (ORDER BY organism) AS n FROM (SELECT DISTINCT organism FROM o WHERE vec_id % 4 > 0))
SELECT vec_id, coalesce(n, 0) AS organism_index, (o.label % 2 = 0)::INTEGER AS label_int, round(sum((v - m) / d), 6) AS total, round(max((v - m) / d), 6) AS top
FROM o LEFT JOIN w USING (organism) JOIN x USING (vec_id) JOIN s USING (i) GROUP BY ALL""")
def dataset_assembly(spark, sf):
    """Rows with features scaled and organisms numbered by what the fit rows hold."""
    d, _ = assembled(spark, sf)
    return d.select("vec_id", F.col("organism_index").cast("long").alias("organism_index"), "label_int", r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"), r(F.array_max("features")).alias("top"))


@query(f"""
WITH {_FITTED}, w AS (SELECT DISTINCT label % 7 AS o FROM embeddings WHERE vec_id % 4 > 0)
SELECT (SELECT count(*) FROM s)::INTEGER AS peptide_dim, (SELECT count(*) + 1 FROM w)::INTEGER AS organism_dim, 'vector' AS peptide_kind, 'index' AS organism_kind, (SELECT round(sum(m), 6) FROM s) AS mean, (SELECT round(sum(d), 6) FROM s) AS scale""")
def dataset_descriptor(spark, sf):
    """The one description of a dataset's dimensions and scaler."""
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x)).alias(c)
    return T.descriptor(assembled(spark, sf)[1], spark).select("peptide_dim", "organism_dim", "peptide_kind", "organism_kind", total("mean"), total("scale"))


@query(f"""WITH {_FITTED} SELECT vec_id, round(sum((v - m) / d), 6) AS total FROM x JOIN s USING (i) GROUP BY vec_id""")
def dataset_from_artifact(spark, sf):
    """All vectors scaled by a stored description instead of a fit."""
    import json

    facts = json.dumps(assembled(spark, sf)[1])
    e = t(spark, sf, "embeddings")
    d = T.from_artifacts(e.select("vec_id"), e.select("vec_id", F.col("embedding").alias("features")), "vec_id", facts)
    return d.select("vec_id", r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("""SELECT p_partkey, [p_size::DOUBLE, p_retailprice] AS features FROM part""")
def indexed_features(spark, sf):
    """Named columns of parts as one vector each."""
    return T.indexed_rows(t(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def attach_split(spark, sf):
    """Orders of some states with their side; one on both or none would raise."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    d = T.attach_split(T.with_labels(o, ["F", "P"], "o_orderstatus"), o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 3 = 0"), "o_orderkey")
    return d.select("o_orderkey", "split")


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey % 5)::INTEGER AS fold_id FROM lineitem WHERE l_orderkey % 7 > 0""")
def attach_folds(spark, sf):
    """Lineitems of train orders with their fold."""
    k = F.col("o_orderkey")
    s = t(spark, sf, "orders").select(k.alias("l_orderkey"), F.when(k % 7 == 0, "test").otherwise("train").alias("split"), F.when(k % 7 > 0, (k % 5).cast("int")).alias("fold_id"))
    return T.attach_folds(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), s, "l_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'test' WHEN o_orderkey % 3 = 0 THEN 'val' ELSE 'fit' END AS part FROM orders""")
def reassign_dropped(spark, sf):
    """Keys that a filter dropped go to the test part, whatever they had."""
    o = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "val").otherwise("fit").alias("part"))
    return J.moved_to(o, o.where("o_orderkey % 10 = 0"), "o_orderkey", "part", "test")


_HISTORY = "h AS (SELECT l_returnflag AS run, l_suppkey % 5 AS fold, CASE WHEN l_linenumber % 2 = 0 THEN 'fit' ELSE 'val' END AS side, avg(l_discount) AS v FROM lineitem GROUP BY ALL)"


def history(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("side", F.when(F.col("l_linenumber") % 2 == 0, "fit").otherwise("val"))
    return d.groupBy(F.col("l_returnflag").alias("run"), (F.col("l_suppkey") % 5).alias("fold"), "side").agg(F.avg("l_discount").alias("v"))


@query(f"""WITH {_HISTORY} SELECT a.run, a.fold, round(a.v - b.v, 9) AS gap FROM h a JOIN h b USING (run, fold) WHERE a.side = 'fit' AND b.side = 'val'""")
def fit_val_gap(spark, sf):
    """The fit side's value less the val side's, by run and fold."""
    return T.fit_gap(history(spark, sf), ["run", "fold"], "side", "v").withColumn("gap", r("gap", 9))


@query(f"""WITH {_HISTORY} SELECT fold, round(avg(v) FILTER (WHERE run = 'A'), 9) AS "A", round(avg(v) FILTER (WHERE run = 'N'), 9) AS "N", round(avg(v) FILTER (WHERE run = 'R'), 9) AS "R" FROM h GROUP BY fold""")
def pivot_means(spark, sf):
    """Mean values with one column a run."""
    return A.pivot_mean(history(spark, sf), "fold", "run", "v", ["A", "N", "R"]).select("fold", *[r(c, 9).alias(c) for c in "ANR"])


@query(f"""WITH {_HISTORY}, m AS (SELECT fold, run, avg(v) AS v FROM h GROUP BY ALL) SELECT fold, arg_max(run, v) AS run, round(max(v), 9) AS v FROM m GROUP BY fold""")
def pivot_argmax(spark, sf):
    """The run with the greatest mean in each fold."""
    return A.row_best(history(spark, sf), "fold", "run", "v").withColumn("v", r("v", 9))


@query(f"""WITH {_HISTORY}, m AS (SELECT run, fold, avg(v) AS v FROM h GROUP BY ALL) SELECT fold, round(avg(v), 9) AS difficulty, count(*) AS n FROM m GROUP BY fold""")
def fold_difficulty(spark, sf):
    """Each fold's mean over the runs' means."""
    m = history(spark, sf).groupBy("run", "fold").agg(F.avg("v").alias("v"))
    return m.groupBy("fold").agg(r(F.avg("v"), 9).alias("difficulty"), F.count("*").alias("n"))


@query("""
WITH m AS (SELECT l_returnflag AS run, round(avg(l_discount), 9) AS d, round(avg(l_tax), 9) AS x FROM lineitem GROUP BY 1)
SELECT 'd' AS metric, arg_max(run, d) AS run, max(d) AS value FROM m UNION ALL SELECT 'x', arg_min(run, x), min(x) FROM m""")
def best_runs(spark, sf):
    """The best run of each metric; for one of them less is better."""
    m = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(r(F.avg("l_discount"), 9).alias("d"), r(F.avg("l_tax"), 9).alias("x"))
    return T.best_runs(m, "run", ["d", "x"], smaller=("x",))


@query("""
SELECT fold, 'all' AS slice, NULL AS member, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, user_id % 5 AS fold FROM events) GROUP BY fold UNION ALL
SELECT fold, 'event_type', event_type, count(*), round(avg(value), 6) FROM (SELECT *, user_id % 5 AS fold FROM events) GROUP BY ALL""")
def snapshot_slices(spark, sf):
    """Means by fold, over all rows and by event type, in one pass."""
    d = t(spark, sf, "events").withColumn("fold", F.col("user_id") % 5)
    return T.snapshot_slices(d, "fold", ["event_type"], "value").withColumn("mean", r("mean"))


@query("""SELECT event_type, count(*) AS n, round(avg((value > 100)::INT), 6) AS share FROM events GROUP BY 1""")
def accuracy_by_slice(spark, sf):
    """The share of right rows in each slice."""
    return A.group_share(t(spark, sf, "events"), ["event_type"], F.col("value") > 100).withColumn("share", r("share"))


@query("""SELECT 0::BIGINT AS n, 0.0::DOUBLE AS share""")
def share_of_nothing(spark, sf):
    """The share of an empty table is 0."""
    return A.group_share(t(spark, sf, "events").where(F.lit(False)), [], F.col("value") > 100)


@query("""
WITH m AS (SELECT o_orderpriority AS p, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS e, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL),
x AS (SELECT *, max(v) OVER (PARTITION BY p ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m)
SELECT p, e, v, greatest(v, coalesce(b, v)) AS best_so_far, b IS NULL OR v > b AS improved FROM x""")
def best_so_far(spark, sf):
    """Monthly sales with the best month so far and whether it was beaten."""
    m = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("e")).agg(r(F.sum("o_totalprice"), 2).alias("v"))
    return A.running_best(m, ["p"], "e", "v")


@query("""WITH m AS (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS e FROM orders) SELECT e FROM m WHERE e % 5 = 0 OR e = (SELECT max(e) FROM m)""")
def every_fifth_epoch(spark, sf):
    """Every fifth month and the last one."""
    m = t(spark, sf, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("e")).distinct()
    return A.every_nth(m, "e", 5)


@query("""
WITH d AS (SELECT DISTINCT CASE WHEN p_size > 5 THEN p_type END AS v FROM part)
SELECT v, CASE WHEN v IS NULL THEN -1 ELSE (row_number() OVER (ORDER BY v NULLS LAST) - 1)::INTEGER END AS code FROM d""")
def dense_codes(spark, sf):
    """Types as numbers in order, missing ones as -1."""
    return A.dense_codes(t(spark, sf, "part").select(F.when(F.col("p_size") > 5, F.col("p_type")).alias("v")), "v")


@query("""
WITH k AS (SELECT DISTINCT o_custkey AS c FROM orders), h AS (SELECT c, row_number() OVER (ORDER BY md5('7:' || CAST(c AS VARCHAR)), c) AS n FROM k)
SELECT o_orderkey, n <= 50 AS chosen FROM orders JOIN h ON c = o_custkey""")
def random_mask(spark, sf):
    """Exactly fifty customers, picked by a seeded hash, and their orders."""
    return T.random_mask(t(spark, sf, "orders"), "o_custkey", 50, 7).select("o_orderkey", "chosen")


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY md5('3:' || CAST(s_suppkey AS VARCHAR)), s_suppkey) AS place FROM supplier""")
def seeded_shuffle(spark, sf):
    """Suppliers in a seeded order, with their places in it."""
    d = T.shuffled(t(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 3)
    order = [F.md5(F.concat_ws(":", F.lit(3), F.col("s_suppkey").cast("string"))), F.col("s_suppkey")]
    return numbered(d, order, "n").select("s_suppkey", (F.col("n") + 1).alias("place"))


@query("""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS k FROM documents) SELECT doc_id, k // 32 AS batch FROM d""")
def length_batches(spark, sf):
    """Documents in batches of like length."""
    return T.length_batches(t(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id", 32).select("doc_id", F.col("batch").alias("batch"))


@query("""
WITH m AS (SELECT n_nationkey AS k, n_regionkey AS a, CASE WHEN n_nationkey % 2 = 0 THEN 1 END AS b FROM nation), v AS (SELECT n_nationkey AS k, n_nationkey % 3 AS c FROM nation WHERE n_nationkey < 20)
SELECT k, a, b, c FROM m LEFT JOIN v USING (k)""")
def voter_merge(spark, sf):
    """A table of votes beside the nations, kept as a file between steps; a voter that has none is null."""
    from ..sources.scratch import stored

    k = F.col("n_nationkey")
    m = t(spark, sf, "nation").select(k.alias("k"), F.col("n_regionkey").alias("a"), F.when(k % 2 == 0, 1).alias("b"))
    return stored(m, "voters").join(t(spark, sf, "nation").where("n_nationkey < 20").select(k.alias("k"), (k % 3).alias("c")), "k", "left")


@query("""SELECT c_custkey, c_custkey % 5 AS fold FROM customer WHERE c_custkey % 2 = 0""")
def fold_merge(spark, sf):
    """Customers with a fold, those without left out."""
    c = t(spark, sf, "customer").select("c_custkey")
    return c.join(c.where("c_custkey % 2 = 0").withColumn("fold", F.col("c_custkey") % 5), "c_custkey")


@query("""SELECT count(*) FILTER (WHERE b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL) AS only_b, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS both
FROM (SELECT DISTINCT doc_id AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS b FROM labels) ON a = b""")
def artifact_agreement(spark, sf):
    """Keys of two tables: in one, the other or both."""
    return T.agreement(t(spark, sf, "documents"), t(spark, sf, "labels"), "doc_id")


@query("""SELECT event_id, [(event_type = 'click')::INT::DOUBLE, (event_type = 'view')::INT::DOUBLE, (event_type NOT IN ('click', 'view'))::INT::DOUBLE] AS x FROM events""")
def one_hot_events(spark, sf):
    """Event types as one slot each and one for all others."""
    return t(spark, sf, "events").select("event_id", V.one_hot(F.col("event_type"), ["click", "view"]).alias("x"))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(x, lambda v: v / sqrt(list_dot_product(x, x)))), 6) AS total, 1.0::DOUBLE AS length FROM e""")
def unit_vectors(spark, sf):
    """Vectors scaled to length 1."""
    u = t(spark, sf, "embeddings").select("vec_id", V.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("u"))
    return u.select("vec_id", r(F.aggregate("u", F.lit(0.0), lambda a, x: a + x)).alias("total"), r(V.norm(F.col("u"))).alias("length"))


@query("""SELECT g, n, coalesce(sum(n) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1)""")
def node_offsets(spark, sf):
    """Graphs laid end to end: how many nodes stand before each."""
    return X.node_offsets(t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n")), "g", "n")


_EDGES = "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey UNION SELECT least(p_partkey, p_size), greatest(p_partkey, p_size) FROM part WHERE p_partkey <> p_size"


@query(f"""WITH e AS ({_EDGES}), d AS (SELECT n, count(*) AS k FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n) SELECT p_partkey AS node, coalesce(k, 0) AS degree FROM part LEFT JOIN d ON n = p_partkey""")
def union_graph_degrees(spark, sf):
    """Degrees of all parts in the union of two graphs, isolated ones with 0."""
    a = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    b = t(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.col("p_size").cast("long").alias("dst"))
    return G.degrees(t(spark, sf, "part").select(F.col("p_partkey").alias("node")), G.edge_union(a, b))


@query("""
SELECT c_nationkey AS cluster, count(*) AS size, count(*) FILTER (WHERE c_acctbal < 0) AS special, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS active FROM customer GROUP BY 1""")
def cluster_weights(spark, sf):
    """Rows, special and active rows of each cluster."""
    c = t(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster"), (F.col("c_acctbal") < 0).alias("special"), (F.col("c_mktsegment") == "BUILDING").alias("active"))
    return B.cluster_rollup(c, "cluster", "special", "active")


@query("""
WITH b AS (SELECT DISTINCT n_nationkey % 4 AS bucket FROM nation UNION ALL SELECT 9), g AS (SELECT c_custkey % 4 AS bucket, count(*) AS n, avg((c_acctbal < 0)::INT) AS share FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n, round(coalesce(share, 0), 6) AS share FROM b LEFT JOIN g USING (bucket)""")
def bucket_statistics(spark, sf):
    """Rows and special share of listed buckets, 0 for those without rows."""
    c = t(spark, sf, "customer").where("c_custkey % 4 < 3").select((F.col("c_custkey") % 4).cast("int").alias("bucket"), (F.col("c_acctbal") < 0).alias("special"))
    listed = t(spark, sf, "nation").select((F.col("n_nationkey") % 4).alias("bucket")).distinct().union(spark.createDataFrame([(9,)], "bucket int"))
    return B.bucket_stats(c, listed, "bucket", "special").withColumn("share", r("share"))


@query("""SELECT 'auto' AS mode, round((count(*) FILTER (WHERE quality = 0)) / (count(*) FILTER (WHERE quality = 1)), 9) AS weight FROM labels UNION ALL SELECT 'fixed', 2.5 UNION ALL SELECT 'none', NULL""")
def class_weights(spark, sf):
    """The weight of positives by mode."""
    y = t(spark, sf, "labels")
    rows = [(m, E.class_weight(y, "quality", m, 2.5)) for m in ("auto", "fixed", "none")]
    return spark.createDataFrame(rows, "mode string, weight double").withColumn("weight", r("weight", 9))


@query("""
WITH d AS (SELECT source AS run, (n_chars >= 2000) AS q, least(1.0, n_chars / 4000.0) AS s FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT run, round(avg((s >= 0.5)::INT) FILTER (WHERE q), 6) AS recall_in, round(avg((s >= 0.5)::INT) FILTER (WHERE NOT q), 6) AS recall_out, count(*) FILTER (WHERE q) AS n_in, count(*) FILTER (WHERE NOT q) AS n_out FROM d GROUP BY run""")
def slice_recall_by_run(spark, sf):
    """Recall within and outside a slice, one row a run."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select(F.col("source").alias("run"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("s"), "quality", (F.col("n_chars") >= 2000).alias("q"))
    return E.slice_recall(d, ["run"], "s", "quality", "q").select("run", r("recall_in").alias("recall_in"), r("recall_out").alias("recall_out"), "n_in", "n_out")


@query("""
WITH d AS (SELECT lang, toxic AS flag, quality AS y, least(1.0, n_chars / 4000.0) AS s FROM documents JOIN labels USING (doc_id))
SELECT lang, flag, count(*) AS n, round(avg(((s >= 0.5)::INT = y)::INT), 6) AS accuracy, CASE WHEN sum(y) = 0 OR sum(y) = count(*) THEN 'single_class' ELSE 'ok' END AS status FROM d GROUP BY ALL""")
def metrics_by_two_keys(spark, sf):
    """Metrics by language and flag; groups of one class are marked."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select("lang", F.col("toxic").alias("flag"), "quality", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("s"))
    return E.binary_metrics(d, ["lang", "flag"], "s", "quality").select("lang", "flag", "n", r("accuracy").alias("accuracy"), "status")


@query("""SELECT * FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority, o_orderstatus) AS place FROM orders GROUP BY o_orderpriority, o_orderstatus) WHERE place <= 7""")
def head_sample(spark, sf):
    """The first seven groups of a composite order, for a report."""
    g = t(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col("n").desc(), "o_orderpriority", "o_orderstatus")
    return g.orderBy(F.col("n").desc(), "o_orderpriority", "o_orderstatus").limit(7).withColumn("place", F.row_number().over(w).cast("long"))


@query("""SELECT 'clusters_in_one_bucket' AS rule, true AS holds UNION ALL SELECT 'rows_covered', true UNION ALL SELECT 'folds_of_train_only', true UNION ALL SELECT 'shares_within_a_twentieth', true""")
def bucket_split_rules(spark, sf):
    """What a bucket split promises: whole clusters, all rows, folds for train rows alone, shares near their targets."""
    from .catalogue import QUERIES

    s = QUERIES["bucket_split"](spark, sf)
    n = t(spark, sf, "embeddings").count()
    bucket = F.concat_ws("-", "split", F.coalesce("fold_id", F.lit(-1)).cast("string"))
    g = s.groupBy("cluster").agg(F.countDistinct(bucket).alias("k")).agg((F.max("k") == 1).alias("holds"))
    shares = s.groupBy(bucket.alias("b"), "split").agg((F.count("*") / n).alias("x")).agg(F.max(F.abs(F.col("x") - F.when(F.col("split") == "test", 0.2).otherwise(0.16))).alias("m")).select((F.col("m") <= 0.05).alias("holds"))
    rules = {"clusters_in_one_bucket": g, "rows_covered": s.agg((F.count("*") == n).alias("holds")), "folds_of_train_only": s.agg(F.every((F.col("split") == "test") == F.col("fold_id").isNull()).alias("holds")), "shares_within_a_twentieth": shares}
    out = None
    for name, d in rules.items():
        one = d.select(F.lit(name).alias("rule"), "holds")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT 'rows' AS rule, (SELECT count(*) FROM embeddings) * 3 AS n UNION ALL SELECT 'val_rows', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'probabilities_in_range', (SELECT count(*) FROM embeddings) * 3
UNION ALL SELECT 'folds_that_tell_their_fit_rows_apart', 3 UNION ALL SELECT 'folds_with_a_model_of_their_own', 3""")
def cross_validation(spark, sf):
    """Three folds of a weighted model of vector and organism: every row once a round, once as val, with a probability."""
    d, _ = assembled(spark, sf)
    cv = T.cross_validate(d.select("vec_id", "features", "organism_index", "label_int", (F.col("vec_id") % 3).cast("int").alias("fold_id")), 3, organism="organism_index", maxIter=5)
    g = cv.agg(F.count("*").alias("rows"), F.count_if(F.col("eval_group") == "val").alias("val_rows"), F.count_if(F.col("probability").between(0, 1)).alias("probabilities_in_range"))
    mean = lambda y: F.avg(F.when((F.col("label_int") == y) & (F.col("eval_group") == "fit"), F.col("probability")))
    per = cv.groupBy("val_fold_id").agg((mean(1) - mean(0)).alias("apart"), F.round(F.sum("probability"), 6).alias("sum"))
    g = g.crossJoin(per.agg(F.count_if(F.col("apart") > 0.05).alias("folds_that_tell_their_fit_rows_apart"), F.countDistinct("sum").alias("folds_with_a_model_of_their_own")))
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in g.columns])).alias("x")).select("x.*")


@query()
def kmeans_clusters(spark, sf):
    """Vectors in the number of clusters that has the greatest silhouette of three."""
    return T.kmeans_sweep(t(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", [4, 8, 12], sample=0.5)[0].select("vec_id", "cluster")


@query("""
WITH v AS (SELECT n_nationkey AS node, n_regionkey AS c FROM nation), m AS (SELECT c, min(node) AS least FROM v GROUP BY c)
SELECT node, (SELECT count(*) FROM m y WHERE y.least < m.least)::INTEGER AS cluster FROM v JOIN m USING (c)""")
def consensus_clusters(spark, sf):
    """Average linkage on how often voters agree; two votes for the regions and one for parity give back the regions."""
    k = F.col("n_nationkey")
    d = t(spark, sf, "nation").select(k.alias("k"), F.col("n_regionkey").alias("a"), F.col("n_regionkey").alias("b"), (k % 2).alias("c"))
    return G.average_linkage(G.coassociation(d, "k", ["a", "b", "c"]).select("i", "j", "share"), t(spark, sf, "nation").select(k.alias("node")), 5)


@query("""
WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, n_rows, n_groups, round(share, 6) AS share FROM (SELECT source, sum(n)::BIGINT AS n_rows, count(*) AS n_groups, max(n) / sum(n) AS share FROM g GROUP BY 1)""")
def homology_groups(spark, sf):
    """Rows, groups and the largest group's share of each source: what a split by groups has to keep together."""
    g = t(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return g.groupBy("source").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), r(F.max("n") / F.sum("n")).alias("share"))


@query("""
WITH u AS (SELECT upper(text) AS u, count(*) AS n FROM documents GROUP BY 1)
SELECT 'crossing_links' AS rule, 0::BIGINT AS n UNION ALL SELECT 'rows', count(*) FROM documents UNION ALL SELECT 'test_under_a_third', 1 UNION ALL SELECT 'links', sum(n - 1)::BIGINT FROM u WHERE u IS NOT NULL
UNION ALL SELECT 'groups', (sum(CASE WHEN u IS NULL THEN n ELSE 1 END))::BIGINT FROM u UNION ALL SELECT 'largest_group', max(n) FROM u WHERE u IS NOT NULL""")
def homology_split(spark, sf):
    """Documents split so that equal texts stay on one side: links, groups, links that cross, and whether the test part is near its share."""
    d = t(spark, sf, "documents").select("doc_id", F.sha2(F.upper("text"), 256).alias("upper"))
    s, links = B.homology_split(d.select(F.col("doc_id").alias("node")), [(d, ["upper"])], "doc_id", 0.2)
    sizes = s.groupBy("component").agg(F.count("*").alias("k"))
    j = links.join(s.select(F.col("node").alias("src"), F.col("split").alias("_a")), "src").join(s.select(F.col("node").alias("dst"), F.col("split").alias("_b")), "dst")
    rules = {"crossing_links": j.agg(F.count_if(F.col("_a") != F.col("_b")).alias("n")), "rows": s.agg(F.count("*").alias("n")), "test_under_a_third": s.agg((F.avg((F.col("split") == "test").cast("int")).between(0.1, 0.33)).cast("long").alias("n"))}
    rules |= {"links": links.agg(F.count("*").alias("n")), "groups": sizes.agg(F.count("*").alias("n")), "largest_group": sizes.agg(F.max("k").alias("n"))}
    out = None
    for name, x in rules.items():
        one = x.select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH n AS (SELECT p_partkey AS id, 1 + p_size % 6 AS n FROM part) SELECT id, round(n * 162.141 + 18.015, 3)::DOUBLE AS weight, (11 * n + 1)::INTEGER AS heavy_atoms, n::INTEGER AS rings, (8 * n + 1 - 3 * n)::INTEGER AS hetero_atoms FROM n""")
def glucose_weights(spark, sf):
    """Chains of one to six glucose units: weight, atoms and rings; single units in one of two spellings."""
    n = 1 + F.col("p_size") % 6
    chain = F.concat(F.repeat(F.lit("OC1C(O)C(O)C(C(CO)O1)"), n.cast("int")), F.lit("O"))
    s = F.when((n == 1) & (F.col("p_partkey") % 2 == 0), "OCC1OC(O)C(O)C(O)C1O").otherwise(chain)
    d = X.descriptors(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), s.alias("smiles")), "smiles")
    return d.select("id", F.round("descriptors.weight", 3).alias("weight"), *[F.col(f"descriptors.{c}").alias(c) for c in ("heavy_atoms", "rings", "hetero_atoms")])


@query("""
WITH l AS (SELECT l_partkey AS k, l_quantity / (l_linenumber + 1) AS v FROM lineitem) SELECT count(*) AS n, count(*) FILTER (WHERE abs(v - round(v, 2)) <= 1e-3 * greatest(abs(v), abs(round(v, 2)))) AS near FROM l""")
def tolerance_check(spark, sf):
    """How many values a rounding leaves within a thousandth."""
    v = F.col("l_quantity") / (F.col("l_linenumber") + 1)
    return t(spark, sf, "lineitem").agg(F.count("*").alias("n"), F.count_if(M.close(v, F.round(v, 2), 1e-3)).alias("near"))


_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "b", "o", "br", "n", ">", "/", "c"]


@query(rf"""
WITH x AS (SELECT page_id, regexp_extract_all(html, '{STRUCTURE_TOKEN}') AS w FROM pages),
j AS (SELECT page_id, replace(chr(31) || array_to_string(w, chr(31) || chr(31)) || chr(31), chr(31) || 'n' || chr(31) || chr(31) || 'o' || chr(31), chr(31) || 'no' || chr(31)) AS s FROM x),
k AS (SELECT page_id, list_filter(string_split(s, chr(31)), lambda v: v <> '') AS w FROM j)
SELECT page_id, len(w) AS n, len(list_filter(w, lambda v: v = 'no')) AS merged,
  array_to_string(list_concat([2], list_transform(w, lambda v: coalesce(list_position(['b', 'o', 'br', 'n', '>', '/', 'c'], v) + 4, 1)), [3]), ' ') AS numbers FROM k""")
def structure_numbers(spark, sf):
    """Pages' structure tokens with one merged pair, as numbers of a vocabulary between start and end."""
    d = K.tokenize(t(spark, sf, "pages").select("page_id", "html"), "html", K.Tokenizer({x: i for i, x in enumerate(_TOKENS)}, [("n", "o")]))
    merged = F.size(F.filter("tokens", lambda x: x == "no")).cast("long")
    return d.select("page_id", F.size("tokens").cast("long").alias("n"), merged.alias("merged"), F.array_join(F.transform("numbers", lambda x: x.cast("string")), " ").alias("numbers"))
