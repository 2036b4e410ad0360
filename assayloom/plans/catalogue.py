"""Named queries over the driver's tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measurements as M
from ..functions import sequences as S
from ..functions import vectors as V
from ..operators import aggregates as A
from ..operators import checks as C
from ..operators import features as X
from ..operators import graph as G
from ..operators import joins as J
from ..operators import metrics as E
from ..operators import similarity as P
from ..operators import splits as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, n: int = 6):
    return F.round(c, n)


@query("""
WITH b AS (SELECT l_partkey, l_suppkey, l_quantity AS x FROM lineitem WHERE l_quantity <> 0),
p AS (SELECT l_partkey, l_suppkey, x FROM b UNION ALL SELECT l_partkey, l_suppkey, x FROM b),
q AS (SELECT l_partkey, l_suppkey, count(*) AS n_points, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM p GROUP BY ALL),
k AS (SELECT p.*, q.n_points FROM p JOIN q USING (l_partkey, l_suppkey) WHERE n_points < 4 OR x BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo))
SELECT l_partkey, l_suppkey, round(avg(x), 6) AS mean, any_value(n_points) AS n_points, count(*) AS n_used,
       any_value(n_points) // 2 AS n_rows
FROM k GROUP BY l_partkey, l_suppkey""")
def robust_mean_by_pair(spark, sf):
    """Outlier-robust mean of the quantity per part and supplier; an exact value weighs two points."""
    d = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("low"), F.col("l_quantity").alias("high"))
    return A.robust_mean(d, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", r("mean").alias("mean"), "n_points", "n_used", "n_rows")


@query("""
WITH p AS (
  SELECT l_returnflag, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_quantity END AS low, CASE WHEN l_linenumber % 3 = 1 THEN 'inf'::DOUBLE ELSE l_quantity END AS high FROM lineitem),
x AS (SELECT l_returnflag, l_suppkey, low AS x FROM p WHERE low <> 0 UNION ALL SELECT l_returnflag, l_suppkey, high FROM p WHERE NOT isinf(high)),
q AS (SELECT l_returnflag, l_suppkey, count(*) AS n_points, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM x GROUP BY ALL),
k AS (SELECT x.*, n_points FROM x JOIN q USING (l_returnflag, l_suppkey) WHERE n_points < 4 OR x BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo))
SELECT l_returnflag, l_suppkey, round(avg(x), 6) AS mean, any_value(n_points) AS n_points, count(*) AS n_used FROM k GROUP BY l_returnflag, l_suppkey""")
def robust_mean_censored(spark, sf):
    """The same with open bounds, which weigh one point."""
    low = F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(F.col("l_quantity"))
    high = F.when(F.col("l_linenumber") % 3 == 1, float("inf")).otherwise(F.col("l_quantity"))
    d = t(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", low.alias("low"), high.alias("high"))
    return A.robust_mean(d, ["l_returnflag", "l_suppkey"]).select("l_returnflag", "l_suppkey", r("mean").alias("mean"), "n_points", "n_used")


_TEXT_SQL = """CASE l_linenumber WHEN 1 THEN '>' || q WHEN 2 THEN '<' || q WHEN 3 THEN q || '-' || (q + 5) WHEN 4 THEN q || ' ± 2' WHEN 5 THEN 'up to ' || q WHEN 6 THEN 'NA' ELSE '~' || q END"""


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
x AS (SELECT *, {_TEXT_SQL} AS raw FROM d),
b AS (SELECT *, CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN 0 WHEN 3 THEN q WHEN 4 THEN greatest(0, q - 2) WHEN 5 THEN 0 WHEN 6 THEN NULL ELSE q END::DOUBLE AS low,
        CASE l_linenumber WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN q WHEN 3 THEN q + 5 WHEN 4 THEN q + 2 WHEN 5 THEN q WHEN 6 THEN NULL ELSE q END::DOUBLE AS high FROM x)
SELECT raw, CASE WHEN isinf(high) THEN -1 ELSE high END AS high, low, CASE WHEN low IS NULL THEN 'missing' WHEN isinf(high) OR low = 0 THEN 'censored' WHEN low = high THEN 'exact' ELSE 'ranged' END AS kind, count(*) AS n
FROM b GROUP BY ALL""")
def parse_measurements(spark, sf):
    """Free-text measurements to bounds and censoring kinds, by distinct text."""
    q = F.col("l_quantity").cast("bigint")
    n = F.col("l_linenumber")
    raw = F.when(n == 1, F.concat(F.lit(">"), q)).when(n == 2, F.concat(F.lit("<"), q)).when(n == 3, F.concat(q, F.lit("-"), q + 5)).when(n == 4, F.concat(q, F.lit(" ± 2"))).when(n == 5, F.concat(F.lit("up to "), q)).when(n == 6, F.lit("NA")).otherwise(F.concat(F.lit("~"), q))
    d = t(spark, sf, "lineitem").select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).withColumn("b", M.parse_bounds(F.col("raw")))
    low, high = F.col("b.low"), F.col("b.high")
    return d.select("raw", low.alias("low"), F.when(high == float("inf"), -1.0).otherwise(high).alias("high"), M.censoring(low, high).alias("kind"), "n")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(printf('%.3g', l_extendedprice * 1000 / (l_quantity + 300)) AS DOUBLE) AS micromolar
FROM lineitem""")
def unit_convert_significant(spark, sf):
    """µg/mL to µM by a weight, to three significant digits."""
    v = M.micromolar(F.col("l_extendedprice"), F.lit("µg/ml"), F.col("l_quantity") + 300)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", M.significant(v).alias("micromolar"))


@query("""
SELECT coalesce(CASE WHEN o_orderstatus <> 'F' THEN 'status_' || o_orderstatus WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.08 THEN 'discount' WHEN l_quantity < 5 THEN 'small' END, 'kept') AS reason, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def exclusion_funnel(spark, sf):
    """Rows by the first rule that excludes them."""
    j = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rule = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("status_"), "o_orderstatus")).otherwise(M.first_failure((F.col("l_returnflag") == "R", "returned"), (F.col("l_discount") > 0.08, "discount"), (F.col("l_quantity") < 5, "small")))
    return A.funnel(j, rule)


@query("""
SELECT doc_id, coalesce(CASE WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN source = 'src0' THEN 'source' WHEN n_chars < 300 THEN 'short' WHEN n_chars > 4000 THEN 'long' END, 'included') AS reason FROM documents""")
def first_failure_reason(spark, sf):
    """Ordered rule chain over documents."""
    rule = M.first_failure((~F.col("lang").isin("en", "de"), "language"), (F.col("source") == "src0", "source"), (F.col("n_chars") < 300, "short"), (F.col("n_chars") > 4000, "long"), passed="included")
    return t(spark, sf, "documents").select("doc_id", rule.alias("reason"))


@query("""
SELECT side, count(*) AS n FROM (
  SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side
  FROM (SELECT DISTINCT doc_id AS k FROM documents WHERE n_chars > 1000) a FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) b ON a.k = b.k) GROUP BY side""")
def full_outer_buckets(spark, sf):
    """Long documents against labelled ones: in both, left only, right only."""
    return J.three_way(t(spark, sf, "documents").where("n_chars > 1000").select("doc_id"), t(spark, sf, "labels").select("doc_id"), "doc_id").groupBy("side").agg(F.count("*").alias("n"))


@query("""
WITH g AS (SELECT l_partkey, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM lineitem GROUP BY l_partkey),
x AS (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 20.0 + l_partkey % 5 END AS a, 30.0 AS i FROM g)
SELECT l_partkey, CASE WHEN a IS NULL THEN 'unlabeled' WHEN high <= a THEN 'active' WHEN low >= i THEN 'inactive' ELSE 'uncertain' END AS label FROM x""")
def label_interval(spark, sf):
    """Activity labels of intervals against two breakpoints."""
    g = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    a = F.when(F.col("l_partkey") % 7 != 0, 20.0 + F.col("l_partkey") % 5)
    return g.select("l_partkey", M.label(F.lit("censored"), F.lit(None).cast("double"), a, F.lit(30.0), F.col("low"), F.col("high"))["label"].alias("label"))


_LEVELS = [("cold widget", "species", 1.0), ("small widget", "species", 2.0), ("small", "genus", 3.0), ("red", "genus", 4.0), ("large", "genus", None)]


@query("""
WITH th(match_key, level, value) AS (VALUES ('cold widget', 'species', 1.0::DOUBLE), ('small widget', 'species', 2.0), ('small', 'genus', 3.0), ('red', 'genus', 4.0))
SELECT p_partkey, p_name, coalesce(s.value, g.value) AS value, CASE WHEN s.value IS NOT NULL THEN 'species' WHEN g.value IS NOT NULL THEN 'genus' ELSE 'none' END AS matched
FROM part LEFT JOIN th s ON s.level = 'species' AND s.match_key = p_name LEFT JOIN th g ON g.level = 'genus' AND g.match_key = split_part(trim(p_name), ' ', 1)""")
def hierarchical_lookup(spark, sf):
    """Values by exact name, else by first word, else none; blank rows of the table are invisible."""
    table = spark.createDataFrame(_LEVELS, "match_key string, level string, value double")
    return J.by_level(t(spark, sf, "part").select("p_partkey", "p_name"), table, F.col("p_name"), S.genus(F.col("p_name")), ["value"])


@query("""SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def lookup_or_fail_join(spark, sf):
    """Lineitems with their order; one without would raise."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return J.lookup(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"], "orders of lineitems")


@query("""
WITH f AS (SELECT l_orderkey, count(*) AS n, min(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CASE WHEN n = 1 THEN 'matched' WHEN coalesce(n, 0) = 0 THEN 'zero_matches' ELSE 'many_matches' END AS status, CASE WHEN n = 1 THEN q ELSE -1 END AS q
FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN f ON l_orderkey = o_orderkey""")
def exactly_one_match(spark, sf):
    """Orders with exactly one returned line."""
    found = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("q"))
    return J.matches(t(spark, sf, "orders"), found, ["o_orderkey"], ["q"], {"q": F.lit(-1.0)})


@query("""
SELECT part, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (
  SELECT doc_id, 'labelled' AS part FROM documents SEMI JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 'unlabelled' FROM documents ANTI JOIN labels USING (doc_id)
  UNION ALL SELECT doc_id, 'either_long_or_toxic' FROM (SELECT doc_id FROM documents WHERE n_chars > 5000 UNION SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT doc_id, 'long_and_toxic' FROM (SELECT doc_id FROM documents WHERE n_chars > 2000 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY part""")
def semi_anti_partition(spark, sf):
    """Semi, anti, union and intersection of id sets."""
    d, y = t(spark, sf, "documents"), t(spark, sf, "labels")
    toxic = y.where("toxic = 1").select("doc_id")
    parts = {
        "labelled": d.join(y, "doc_id", "left_semi"), "unlabelled": d.join(y, "doc_id", "left_anti"),
        "either_long_or_toxic": d.where("n_chars > 5000").select("doc_id").union(toxic).distinct(), "long_and_toxic": d.where("n_chars > 2000").select("doc_id").intersect(toxic),
    }
    out = None
    for name, p in parts.items():
        one = p.select(F.lit(name).alias("part"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""
WITH k AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 999, 'RETIRED'),
c AS (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(n, 0) AS n, CASE WHEN k.n_nationkey IS NULL THEN 'new' WHEN c.n IS NULL THEN 'stale' ELSE 'kept' END AS change FROM k FULL JOIN c USING (n_nationkey)""")
def upsert_keep_stale(spark, sf):
    """A curated table refreshed with new counts."""
    kept = t(spark, sf, "nation").where("n_nationkey % 3 <> 0").select("n_nationkey", "n_name").union(spark.createDataFrame([(999, "RETIRED")], "n_nationkey int, n_name string"))
    counts = t(spark, sf, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return J.refresh(kept, counts, ["n_nationkey"], ["n_name"])


@query("""
SELECT o_custkey, min(o_orderpriority) AS o_orderpriority, count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, min(o_orderpriority) < max(o_orderpriority) AS conflict FROM orders GROUP BY o_custkey""")
def dedup_conflict(spark, sf):
    """One row a customer, with whether its orders' priorities disagree."""
    return A.distinct_or_conflict(t(spark, sf, "orders"), "o_custkey", ["o_orderpriority"], {"n_rows": F.count("*"), "n_final": F.count_if(F.col("o_orderstatus") == "F")})


@query("""
SELECT DISTINCT i, j FROM (
  SELECT min(doc_id) OVER (PARTITION BY text) AS i, doc_id AS j FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT min(doc_id) OVER (PARTITION BY upper(text)) AS i, doc_id AS j FROM documents WHERE text IS NOT NULL) WHERE i <> j""")
def dup_links_first_seen(spark, sf):
    """Each later document with the first one of equal text or equal upper-cased text, over the texts' whole length."""
    d = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text"), F.sha2(F.upper("text"), 256).alias("upper"))
    return P.first_links(d, "doc_id", ["text", "upper"])


@query("""
SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1""")
def first_rows_by_key(spark, sf):
    """The longest document of each source and language."""
    return J.first_rows(t(spark, sf, "documents"), ["source", "lang"], [-F.col("n_chars"), F.col("doc_id")]).select("doc_id", "text", "lang")


_DNA = "regexp_replace(translate(text, 'eitnrsEITNRS', 'ACGTACACGTAC'), '[^A-Z]', '', 'g')"


def _dna():
    return F.regexp_replace(F.translate("text", "eitnrsEITNRS", "ACGTACACGTAC"), "[^A-Z]", "")


@query(f"""
WITH d AS (SELECT source, {_DNA} AS s FROM documents),
ks AS (SELECT unnest([1, 2, 3]) AS k),
p AS (SELECT source, k, s, unnest(generate_series(1, length(s) - k + 1)) AS i FROM d, ks),
w AS (SELECT source, k, s[i:i + k - 1] AS kmer FROM p),
c AS (SELECT source, k, kmer, count(*) AS n FROM w WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY ALL)
SELECT source, k, kmer, n, round(n / sqrt(sum(n::DOUBLE * n) OVER (PARTITION BY source, k)), 6) AS value FROM c""")
def kmer_composition(spark, sf):
    """Overlapping k-mers of the texts' letters in a four-letter alphabet, scaled per k."""
    s = _dna()
    return X.kmer_counts(t(spark, sf, "documents").select("source", s.alias("s")), "source", "s", (1, 2, 3)).select("source", "k", "kmer", "n", r("value").alias("value"))


@query(f"""SELECT doc_id, length(s) AS n, length(s) BETWEEN 1200 AND 1700 AS full_length, reverse(translate(s, 'ACGT', 'TGCA')) AS other FROM (SELECT doc_id, {_DNA} AS s FROM documents)""")
def reverse_complement(spark, sf):
    """The other strand of each whole text's letters, and whether their number is that of a full gene."""
    d = t(spark, sf, "documents").select("doc_id", _dna().alias("s"))
    n = F.length("s").cast("bigint")
    return d.select("doc_id", n.alias("n"), n.between(1200, 1700).alias("full_length"), S.reverse_complement(F.col("s")).alias("other"))


@query("""
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
f AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE vec_id % 5 <> 0 GROUP BY i)
SELECT vec_id, round(sum((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 6) AS total, round(max((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 6) AS top FROM e JOIN f USING (i) GROUP BY vec_id""")
def standardize_fit_apply(spark, sf):
    """Scaling fitted on a part of the vectors and applied to all."""
    e = t(spark, sf, "embeddings")
    stats = A.scaler_arrays(A.scaler(e.where("vec_id % 5 <> 0"), "embedding"))
    z = e.crossJoin(F.broadcast(stats)).select("vec_id", V.standardized(F.col("embedding"), F.col("mean"), F.col("scale")).alias("z"))
    return z.select("vec_id", r(F.aggregate("z", F.lit(0.0), lambda a, x: a + x)).alias("total"), r(F.array_max("z")).alias("top"))


@query("""
WITH v AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS index FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error'))
SELECT e.event_type, coalesce(index, 0) AS index, count(*) AS n FROM events e LEFT JOIN v USING (event_type) GROUP BY ALL""")
def vocab_encode(spark, sf):
    """Event types as numbers of a vocabulary that lacks one of them."""
    e = t(spark, sf, "events")
    vocab = X.vocabulary(e.where("event_type <> 'error'"), "event_type")
    return X.encode(e, vocab, "event_type").groupBy("event_type", F.col("index").cast("bigint").alias("index")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def json_struct_explode(spark, sf):
    """Fields of a JSON column, null-safe."""
    e = t(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("""
SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def similarity_pairs_cosine(spark, sf):
    """Similar vectors within a label."""
    return P.cosine_pairs(t(spark, sf, "embeddings"), "vec_id", "embedding", "label", 0.3).select("i", "j", r("similarity").alias("similarity"))


@query(r"""
WITH w AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS s FROM benchmark),
s AS (SELECT s, min(item_id) AS item_id FROM w WHERE len(s) > 0 GROUP BY s)
SELECT a.item_id AS i, b.item_id AS j, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity
FROM s a JOIN s b ON a.item_id < b.item_id WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.2
UNION ALL SELECT s.item_id, w.item_id, 1.0 FROM s JOIN w ON s.s = w.s AND w.item_id <> s.item_id""")
def shingle_jaccard_pairs(spark, sf):
    """Benchmark items by the Jaccard similarity of their words, with a prefix filter."""
    d = t(spark, sf, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    return P.set_pairs(d, "item_id", "w", 0.2).select("i", "j", r("similarity").alias("similarity"))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS k, len(s) AS n FROM g GROUP BY s),
x AS (SELECT k, n, unnest(s) AS t FROM c),
p AS (SELECT a.k AS i, b.k AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM x a JOIN x b ON a.t = b.t AND a.k < b.k GROUP BY a.k, b.k)
SELECT i, j, round(o / (n + m - o), 6) AS similarity FROM p WHERE o / (n + m - o) >= 0.8 UNION ALL SELECT c.k, g.doc_id, 1.0 FROM c JOIN g ON c.s = g.s AND g.doc_id <> c.k""")
def shingle_jaccard_documents(spark, sf):
    """All pairs of documents by the Jaccard similarity of their shingles of three words, 0.8 or more; a shorter text is one shingle."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    three = lambda w: F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, k: F.concat_ws(" ", x, w[k + 1], w[k + 2]))
    # a lambda's argument is evaluated once; a column would be split into words again for every shingle, as for a filter
    shingles = lambda w: F.when(F.size(w) > 2, three(w)).when(F.size(w) > 0, F.array(F.array_join(w, " ")))
    d = t(spark, sf, "documents").select("doc_id", F.transform(F.array(words), shingles)[0].alias("s"))
    return P.set_pairs(d, "doc_id", "s", 0.8).select("i", "j", r("similarity").alias("similarity"))


@query("""
SELECT i, j, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 5""")
def knn_topk(spark, sf):
    """Each vector's five nearest of its label."""
    return P.nearest(t(spark, sf, "embeddings"), "vec_id", "embedding", "label", 5).select("i", "j", r("similarity").alias("similarity"), "rank")


@query("""
SELECT label, count(*) AS n, count(*) FILTER (WHERE s >= 0.35) AS near FROM (
  SELECT a.label, a.vec_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 5 <> 0 WHERE a.vec_id % 5 = 0 GROUP BY ALL) GROUP BY label""")
def max_sim_share(spark, sf):
    """Per label, how many held-out vectors are near one of the others."""
    e = t(spark, sf, "embeddings")
    s = P.greatest_similarity(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), "vec_id", "embedding", "label")
    return s.join(e.select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("similarity") >= 0.35).alias("near"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b FROM documents a JOIN documents b ON upper(a.text) = upper(b.text) AND a.doc_id <> b.doc_id),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(n, l) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, least(c.l, u.b) FROM c JOIN u ON u.a = c.n WHERE c.l < u.b)
SELECT n AS node, min(l) AS component FROM c GROUP BY n""")
def components_contract(spark, sf):
    """Connected components of all documents under links to the first one of equal upper-cased text; documents without links are their own."""
    d = t(spark, sf, "documents").select("doc_id", F.sha2(F.upper("text"), 256).alias("upper"))
    links = P.first_links(d, "doc_id", ["upper"]).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return G.components(d.select(F.col("doc_id").alias("node")), links)


@query("""
WITH d AS (SELECT doc_id, length(text) AS n, upper(text) AS u, source || '|' || lang AS s FROM documents),
g AS (SELECT *, CASE WHEN u IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY u) END AS c, min(doc_id) OVER (PARTITION BY s) AS head FROM d),
e AS (SELECT least(a.c, b.c) AS src, greatest(a.c, b.c) AS dst, max(least(a.n, b.n) / greatest(a.n, b.n, 1)) AS weight FROM g a JOIN g b ON a.head = b.doc_id WHERE a.c <> b.c AND a.s IS NOT NULL GROUP BY ALL),
v AS (SELECT c, count(*) AS n_nodes FROM g GROUP BY 1)
SELECT c AS component, n_nodes, dst AS other, round(weight, 6) AS weight FROM v LEFT JOIN e ON src = c""")
def contracted_documents(spark, sf):
    """All documents with copies contracted: each component, its size and its edges to later ones; null without one.

    Edges lead to the first document of equal source and language, weighted by the ratio of lengths.
    """
    d = t(spark, sf, "documents").select("doc_id", F.length("text").alias("n"), F.sha2(F.upper("text"), 256).alias("upper"), F.concat_ws("|", "source", "lang").alias("start"))
    links = P.first_links(d, "doc_id", ["upper"]).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    node_of = G.components(d.select(F.col("doc_id").alias("node")), links)
    i, j = d.select(F.col("doc_id").alias("i"), F.col("n").alias("_a")), d.select(F.col("doc_id").alias("j"), F.col("n").alias("_b"))
    near = P.first_links(d, "doc_id", ["start"]).join(i, "i").join(j, "j")
    edges = near.select(F.col("i").alias("src"), F.col("j").alias("dst"), (F.least("_a", "_b") / F.greatest("_a", "_b", F.lit(1))).alias("weight"))
    sizes = node_of.groupBy("component").agg(F.count("*").alias("n_nodes"))
    e = G.contract(edges, node_of).select(F.col("src").alias("component"), F.col("dst").alias("other"), r("weight").alias("weight"))
    return sizes.join(e, "component", "left").select("component", "n_nodes", "other", "weight")


@query()
def bucket_split(spark, sf):
    """Whole labels of vectors dealt to test and five folds, with the leakage count (0) beside each row."""
    e = t(spark, sf, "embeddings").withColumn("cluster", F.concat_ws("-", "label", F.floor(F.col("vec_id") / 10).cast("string")))
    s = B.stratified_split(e.withColumn("special", F.col("vec_id") % 4 == 0).withColumn("active", F.col("vec_id") % 3 == 0), "cluster", "special", "active", weight_special=30.0, weight_active=30.0, tries=20_000)
    return s.select("vec_id", "cluster", "split", "fold_id")


@query("""
WITH d AS (SELECT o_custkey, o_orderpriority, CAST(o_orderkey % 3 AS VARCHAR) AS bucket FROM orders)
SELECT 'o_custkey' AS key_name, count(*) AS leaking FROM (SELECT o_custkey FROM d GROUP BY 1 HAVING count(DISTINCT bucket) > 1)
UNION ALL SELECT 'o_orderpriority', count(*) FROM (SELECT o_orderpriority FROM d GROUP BY 1 HAVING count(DISTINCT bucket) > 1)""")
def leakage_audit(spark, sf):
    """Keys that are in more than one bucket."""
    return C.leakage(t(spark, sf, "orders").withColumn("bucket", F.col("o_orderkey") % 3), ["o_custkey", "o_orderpriority"], "bucket")


@query("""
SELECT s_nationkey, n, coalesce(sum(n) OVER (ORDER BY s_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.4 * sum(n) OVER () AS chosen
FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)""")
def greedy_prefix_split(spark, sf):
    """Whole nations until two fifths of the suppliers are reached."""
    return B.greedy_prefix(t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")), ["s_nationkey"], "n", 0.4)


@query("""
WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY c_nationkey) AS c FROM g),
b AS (SELECT *, min(c) OVER () AS lo, max(c) OVER () AS hi FROM c)
SELECT c_nationkey, n, CAST(greatest(0, least(4, ceil(coalesce((c - lo) * 5 / nullif(hi - lo, 0), 0)) - 1)) AS INTEGER) AS bin FROM b""")
def cumsum_bins(spark, sf):
    """Nations in five equal widths of the running number of customers."""
    return B.cumulative_bins(t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), ["c_nationkey"], "n", 5)


@query("""
WITH v AS (SELECT n_nationkey AS k, n_regionkey AS a, n_nationkey % 4 AS b, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 2 END AS c FROM nation)
SELECT x.k AS i, y.k AS j, (coalesce((x.a = y.a)::INT, 0) + coalesce((x.b = y.b)::INT, 0) + coalesce((x.c = y.c)::INT, 0))::BIGINT AS agreements, (2 + (x.c IS NOT NULL AND y.c IS NOT NULL)::INT)::BIGINT AS votes,
  round((coalesce((x.a = y.a)::INT, 0) + coalesce((x.b = y.b)::INT, 0) + coalesce((x.c = y.c)::INT, 0)) / (2 + (x.c IS NOT NULL AND y.c IS NOT NULL)::INT), 6) AS share
FROM v x JOIN v y ON x.k < y.k WHERE coalesce((x.a = y.a)::INT, 0) + coalesce((x.b = y.b)::INT, 0) + coalesce((x.c = y.c)::INT, 0) > 0""")
def coassociation(spark, sf):
    """How often three partitions of the nations put two of them together."""
    k = F.col("n_nationkey")
    d = t(spark, sf, "nation").select(k.alias("k"), F.col("n_regionkey").alias("a"), (k % 4).alias("b"), F.when(k % 3 > 0, k % 2).alias("c"))
    return G.coassociation(d, "k", ["a", "b", "c"]).withColumn("share", r("share"))


@query("""
WITH d AS (SELECT lang AS a, quality AS b FROM documents JOIN labels USING (doc_id)), c AS (SELECT a, b, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), ra AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT n::BIGINT AS n, round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM x, ra, rb""")
def adjusted_rand(spark, sf):
    """Agreement of languages and quality labels beyond chance."""
    d = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return G.adjusted_rand(d, "lang", "quality").select("n", r("ari").alias("ari"))


_METRICS = """
WITH d AS (SELECT {key} AS g, least(1.0, n_chars / 4000.0)::DOUBLE AS s, toxic AS y FROM documents JOIN labels USING (doc_id)),
k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0 AS rk FROM d),
m AS (SELECT g, count(*) AS n, sum(y) AS p, count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp, sum(rk) FILTER (WHERE y = 1) AS rs FROM k GROUP BY g)
SELECT g, n, round((tp + n - p - fp) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(p, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(tp + fp + p, 0), 0), 6) AS f1, CASE WHEN p > 0 AND p < n THEN round((rs - p * (p + 1) / 2.0) / (p * (n - p)), 6) END AS auroc, CASE WHEN p > 0 AND p < n THEN 'ok' ELSE 'single_class' END AS status FROM m"""


@query(_METRICS.format(key="source"))
def binary_metrics_by_group(spark, sf):
    """Metrics of a length score for toxic documents by source; groups of one class have no AUROC."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select(F.col("source").alias("g"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("s"), "toxic")
    m = E.binary_metrics(d, ["g"], "s", "toxic")
    return m.select("g", "n", *[r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auroc")], "status")


@query("""
SELECT round(avg((s >= 0.5)::INT) FILTER (WHERE q), 6) AS recall_in, round(avg((s >= 0.5)::INT) FILTER (WHERE NOT q), 6) AS recall_out, round(avg((s >= 0.5)::INT) FILTER (WHERE q) - avg((s >= 0.5)::INT) FILTER (WHERE NOT q), 6) AS delta,
  count(*) FILTER (WHERE q) AS n_in, count(*) FILTER (WHERE NOT q) AS n_out
FROM (SELECT least(1.0, n_chars / 4000.0) AS s, lang = 'en' AS q FROM documents JOIN labels USING (doc_id) WHERE quality = 1)""")
def slice_recall(spark, sf):
    """Recall within and outside a slice."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("s"), "quality", (F.col("lang") == "en").alias("q"))
    return E.slice_recall(d, [], "s", "quality", "q").select(*[r(c).alias(c) for c in ("recall_in", "recall_out", "delta")], "n_in", "n_out")


@query("""SELECT event_type, user_id % 5 AS fold, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std FROM events GROUP BY ALL""")
def cv_mean_std(spark, sf):
    """Mean and sample deviation by event type and fold."""
    return A.mean_std(t(spark, sf, "events").withColumn("fold", F.col("user_id") % 5), ["event_type", "fold"], ["value"]).select("event_type", "fold", r("value_mean").alias("value_mean"), r("value_std").alias("value_std"))


@query("""
WITH m AS (SELECT o_orderpriority AS p, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS e, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL)
SELECT p, arg_max(e, (v, -e)) AS best_at, max(v) AS best, arg_max(v, e) AS last FROM m GROUP BY p""")
def best_epoch(spark, sf):
    """The month of greatest sales by priority, the first one on ties, and the last month's value."""
    m = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("e")).agg(r(F.sum("o_totalprice"), 2).alias("v"))
    return A.best_at(m, ["p"], "e", "v")


@query("""SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F", count(*) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def pivot_crosstab(spark, sf):
    """Counts of return flags by line status."""
    return A.crosstab(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS all_rows, CAST(grouping(l_linestatus) AS INTEGER) AS all_columns FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def coverage_totals(spark, sf):
    """The same counts with all totals."""
    return A.coverage_totals(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("""SELECT CAST(least(14, floor(p * 15)) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (WHERE c) AS n_correct FROM (SELECT 1 / (1 + exp(-(value - 100) / 50)) AS p, user_id % 2 = 0 AS c FROM events) GROUP BY 1""")
def confidence_hist(spark, sf):
    """Probabilities in fifteen bins, with how many are right."""
    d = t(spark, sf, "events").select(V.probability((F.col("value") - 100) / 50).alias("p"), (F.col("user_id") % 2 == 0).alias("c"))
    return E.confidence_histogram(d, "p", "c")


@query("""
WITH m AS (SELECT l_returnflag AS run, CAST(month(l_shipdate) AS INTEGER) AS fold, avg(l_discount) AS v FROM lineitem GROUP BY ALL)
SELECT count(*) AS n, round(avg(a.v - b.v), 9) AS mean_delta, count(*) FILTER (WHERE a.v > b.v) AS won FROM m a JOIN m b USING (fold) WHERE a.run = 'A' AND b.run = 'N'""")
def paired_fold_delta(spark, sf):
    """Two flags' discounts compared month by month."""
    m = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.month("l_shipdate").alias("fold")).agg(F.avg("l_discount").alias("v"))
    return E.paired_delta(m, "run", "A", "N", "fold", "v").select("n", r("mean_delta", 9).alias("mean_delta"), "won")


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_quantity <= 0) AS low, count(*) FILTER (WHERE isinf(l_quantity)) AS inf, count(*) FILTER (WHERE l_quantity IS NULL) AS nul FROM lineitem GROUP BY ALL)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated, sum(low)::BIGINT AS l_quantity_low, sum(inf)::BIGINT AS l_quantity_inf, sum(nul)::BIGINT AS l_quantity_null FROM k""")
def qa_keys(spark, sf):
    """Repeated keys, non-positive, infinite and missing values in one pass."""
    return C.key_summary(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity"])


@query("""
WITH p AS (SELECT doc_id, quality AS part FROM labels), i AS (SELECT DISTINCT doc_id FROM documents), g AS (SELECT doc_id, count(DISTINCT part) AS n FROM p GROUP BY 1)
SELECT count(*) FILTER (WHERE n > 1) AS in_several, count(*) FILTER (WHERE n IS NULL) AS uncovered, count(*) FILTER (WHERE i.doc_id IS NULL) AS orphans FROM i FULL JOIN g USING (doc_id)""")
def qa_split_cover(spark, sf):
    """Whether the labels' parts are disjoint and cover all documents."""
    return C.disjoint_cover(t(spark, sf, "documents"), t(spark, sf, "labels"), "doc_id", "quality")


@query("""
WITH a AS (SELECT lang AS k, count(*) AS n FROM documents GROUP BY 1), b(k, n) AS (VALUES ('en', 1), ('xx', 5))
SELECT k, coalesce(a.n, 0) AS found, coalesce(b.n, 0)::BIGINT AS expected, CASE WHEN b.n IS NULL THEN 'unexpected' WHEN a.n IS NULL THEN 'absent' WHEN a.n = b.n THEN 'match' ELSE 'mismatch' END AS status FROM a FULL JOIN b USING (k)""")
def qa_expected_counts(spark, sf):
    """Found against expected counts."""
    found = t(spark, sf, "documents").groupBy(F.col("lang").alias("k")).agg(F.count("*").alias("n"))
    return C.expected_counts(found, spark.createDataFrame([("en", 1), ("xx", 5)], "k string, n long"), "k").na.fill(0, ["found", "expected"])


@query(f"""SELECT page_id, len(x) AS n, coalesce(list_aggregate(x, 'string_agg', ' '), '') AS tokens FROM (SELECT page_id, regexp_extract_all(html, '{S.STRUCTURE_TOKEN}', 1) AS x FROM pages)""")
def tokenize_structures(spark, sf):
    """All structure tokens of each page, in order."""
    x = S.structure_tokens(F.col("html"))
    return t(spark, sf, "pages").select("page_id", x.alias("x")).select("page_id", F.size("x").cast("bigint").alias("n"), F.array_join("x", " ").alias("tokens"))


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10""")
def topk_counts(spark, sf):
    """The ten users with most events."""
    return A.top_counts(t(spark, sf, "events"), "user_id", 10)


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)
SELECT source, lang, n, round(share, 6) AS share FROM (
  SELECT *, n / sum(n) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c) WHERE k = 1""")
def majority_value(spark, sf):
    """Each source's most frequent language."""
    return A.majority(t(spark, sf, "documents"), ["source"], "lang").select("source", "lang", "n", r("share").alias("share"))


@query("""
SELECT count(*) AS n_clusters, min(n) AS least, median(n)::DOUBLE AS median, max(n) AS greatest, round(avg(n), 6) AS mean, max(n) > 0.5 * sum(n) AS imbalanced FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def cluster_sizes(spark, sf):
    """Sizes of customers' groups of orders."""
    return A.size_summary(t(spark, sf, "orders"), "o_custkey").withColumn("mean", r("mean"))


@query("""
WITH v AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey::BIGINT END AS c FROM nation), x AS (SELECT max(c) AS top FROM v)
SELECT node, c AS community FROM v WHERE c IS NOT NULL UNION ALL SELECT node, top + row_number() OVER (ORDER BY node) FROM v, x WHERE c IS NULL""")
def singleton_communities(spark, sf):
    """Nodes without community get numbers of their own."""
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").cast("bigint").alias("community"))
    return G.with_singletons(n.select("node"), n.where("node % 4 > 0"))


@query("""
WITH n AS (SELECT c_custkey AS node, c_nationkey % 3 AS bucket FROM customer), e AS (SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer)
SELECT count(*) AS n_edges, count(*) FILTER (WHERE a.bucket <> b.bucket) AS n_crossing, round(count(*) FILTER (WHERE a.bucket <> b.bucket) / count(*), 6) AS share FROM e JOIN n a ON src = a.node JOIN n b ON dst = b.node""")
def edges_across(spark, sf):
    """Edges between different buckets."""
    c = t(spark, sf, "customer")
    nodes = c.select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 3).alias("bucket"))
    return G.crossing_edges(c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst")), nodes, "bucket").withColumn("share", r("share"))


@query("""
SELECT val_fold_id, eval_group, count(*) AS n, round(avg(value), 6) AS mean FROM (
  SELECT e.value, CAST(f AS INTEGER) AS val_fold_id, CASE WHEN user_id % 5 = f THEN 'val' ELSE 'fit' END AS eval_group FROM events e, range(5) r(f)) GROUP BY ALL""")
def leave_one_fold_out(spark, sf):
    """All rounds of a five-fold partition in one plan."""
    d = B.leave_one_out(t(spark, sf, "events").select("value", (F.col("user_id") % 5).alias("fold")), "fold", 5)
    return d.groupBy("val_fold_id", "eval_group").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("""
WITH g AS (SELECT o_orderstatus AS bucket, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS s FROM orders GROUP BY 1),
x AS (SELECT *, n / sum(n) OVER () AS share, s / n AS rate, sum(s) OVER () / sum(n) OVER () AS every FROM g)
SELECT bucket, n, round(share, 6) AS share, round(share - 0.4, 6) AS share_off, round(rate, 6) AS rate, round(rate - every, 6) AS rate_off, abs(share - 0.4) <= 0.1 AND abs(rate - every) <= 0.1 AS balanced FROM x""")
def balance_audit(spark, sf):
    """Shares and rates of buckets against targets."""
    o = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("bucket"), (F.col("o_orderkey") % 4 == 0).alias("special"))
    a = B.audit(o, "bucket", "special", o.select("bucket").distinct().withColumn("target", F.lit(0.4)), 0.1)
    return a.select("bucket", "n", *[r(c).alias(c) for c in ("share", "share_off", "rate", "rate_off")], "balanced")


from . import curation, modelling, peptides  # noqa: E402, F401  these register more queries
