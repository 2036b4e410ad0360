"""Queries of sequence identity, generated structures, communities, splits and graph models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import features as X
from ..operators import identity as I
from ..operators import records as R
from ..operators import similarity as P
from ..operators import structures as S
from .catalogue import query, r, t

# heads of part names of 1 to 11 letters, with a placeholder here and there
_HEADS = "SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 5 THEN 'X' ELSE '' END || substr(upper(replace(p_name, ' ', '')), 1, 1 + p_partkey % 11) AS s FROM part"


def name_heads(spark, sf):
    head = F.substr(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit(1), (1 + F.col("p_partkey") % 11).cast("int"))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.when(F.col("p_partkey") % 97 == 5, "X").otherwise(""), head).alias("s"))


# An alignment of two sequences is one number: twice its score by 2^40, equal letters by 2^20, its length; gaps cost 5 and then 1.
_WORST, _GAP, _MORE = "(-4611686018427387904)", str(10 << 40), str(2 << 40)
IDENTITY_SQL = f"""
h AS ({_HEADS}),
c AS (SELECT s, min(k) AS first FROM h WHERE s <> '' AND NOT contains(s, 'X') GROUP BY s),
p AS (SELECT a.first AS i, b.first AS j, a.s AS x, b.s AS y FROM c a JOIN c b ON a.first < b.first WHERE least(length(a.s), length(b.s)) >= 0.6 * greatest(length(a.s), length(b.s))),
v AS (
  SELECT i, j, x, y, 0 AS n, list_prepend(0::BIGINT, list_transform(range(1, length(y) + 1), lambda q: {_WORST}::BIGINT)) AS d, list_transform(range(0, length(y) + 1), lambda q: {_WORST}::BIGINT) AS u,
         list_prepend({_WORST}::BIGINT, list_transform(range(1, length(y) + 1), lambda q: (-{_GAP} - {_MORE} * (q - 1) + q)::BIGINT)) AS l
  FROM p
  UNION ALL
  SELECT i, j, x, y, n, d, u, list_prepend({_WORST}::BIGINT, list_transform(range(1, length(y) + 1), lambda q: (list_max(list_transform(range(0, q), lambda k: greatest(d[k + 1], u[k + 1]) - {_GAP} + ({_MORE} - 1) * k)) - ({_MORE} - 1) * (q - 1) + 1)::BIGINT)) AS l
  FROM (
    SELECT i, j, x, y, n + 1 AS n,
      list_prepend({_WORST}::BIGINT, list_transform(range(1, length(y) + 1), lambda q: (greatest(d[q], u[q], l[q]) + CASE WHEN x[n + 1] = y[q] THEN {(2 << 40) + (1 << 20) + 1} ELSE 1 END)::BIGINT)) AS d,
      list_prepend((-{_GAP} - {_MORE} * n + n + 1)::BIGINT, list_transform(range(1, length(y) + 1), lambda q: (greatest(greatest(d[q + 1], l[q + 1]) - {_GAP}, u[q + 1] - {_MORE}) + 1)::BIGINT)) AS u
    FROM v WHERE n < length(x))),
e AS (SELECT i, j, greatest(d[length(y) + 1], u[length(y) + 1], l[length(y) + 1]) AS b FROM v WHERE n = length(x)),
w AS (SELECT i, j, ((b >> 20) & 1048575) / (b & 1048575) AS similarity FROM e),
links AS (SELECT i, j, similarity FROM w WHERE similarity >= 0.6 UNION ALL SELECT first, k, 1.0 FROM h JOIN c USING (s) WHERE k <> first)"""


@query(f"WITH RECURSIVE {IDENTITY_SQL} SELECT i, j, round(similarity, 6) AS similarity FROM links")
def identity_pairs(spark, sf):
    """Heads of part names whose best alignment is 60 % equal, copies of one head by their first part."""
    return P.identity_pairs(name_heads(spark, sf), "k", "s", 0.6).select("i", "j", r("similarity").alias("similarity"))


# Peptides of 3 to 14 residues whose letters come from a digest of the part's key; every fourth is closed to a ring, every
# fifth starts and ends with a bridged cysteine, and termini are changed here and there.
_LETTERS, _OTHERS = "ACDEFGHIKLMNPQRS", "TVWYrkOBsfPGGLKA"


def peptides(spark, sf):
    """(id, letters, n, c, constraint, one, two) of every part."""
    k = F.col("p_partkey")
    hexes = F.substr(F.md5(k.cast("string")), F.lit(1), (3 + F.col("p_size") % 12).cast("int"))
    letters = F.when(k % 2 == 0, F.translate(hexes, "0123456789abcdef", _LETTERS)).otherwise(F.translate(hexes, "0123456789abcdef", _OTHERS))
    ring, bridge = k % 4 == 0, (k % 5 == 0) & (k % 4 != 0)
    letters = F.when(bridge, F.concat(F.lit("C"), letters, F.lit("c"))).otherwise(letters)
    # the table may be one short file: all cores make its structures
    parts = t(spark, sf, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism * 4, "p_partkey")
    d = parts.select(k.alias("id"), letters.alias("letters"), F.when((k % 3 == 0) & ~ring, "ACT").alias("n"), F.when((k % 7 == 0) & ~ring, "AMD").alias("c"), F.when(ring, "HT").when(bridge, "SS").alias("constraint"))
    return d.withColumn("one", F.lit(1)).withColumn("two", F.length("letters")).withColumn("smiles", S.peptide_structure(*map(F.col, ("letters", "n", "c", "constraint", "one", "two"))))


# what a residue adds: carbon, hydrogen, nitrogen, oxygen and sulfur atoms, and rings
_RESIDUES = """f(a, c, h, n, o, s, g) AS (VALUES ('A', 3, 5, 1, 1, 0, 0), ('R', 6, 12, 4, 1, 0, 0), ('N', 4, 6, 2, 2, 0, 0), ('D', 4, 5, 1, 3, 0, 0), ('C', 3, 5, 1, 1, 1, 0), ('E', 5, 7, 1, 3, 0, 0), ('Q', 5, 8, 2, 2, 0, 0),
 ('G', 2, 3, 1, 1, 0, 0), ('H', 6, 7, 3, 1, 0, 1), ('I', 6, 11, 1, 1, 0, 0), ('L', 6, 11, 1, 1, 0, 0), ('K', 6, 12, 2, 1, 0, 0), ('M', 5, 9, 1, 1, 1, 0), ('F', 9, 9, 1, 1, 0, 1), ('P', 5, 7, 1, 1, 0, 1), ('S', 3, 5, 1, 2, 0, 0),
 ('T', 4, 7, 1, 2, 0, 0), ('W', 11, 10, 2, 1, 0, 2), ('Y', 9, 9, 1, 2, 0, 1), ('V', 5, 9, 1, 1, 0, 0), ('O', 5, 10, 2, 1, 0, 0), ('B', 4, 8, 2, 1, 0, 0))"""
PEPTIDE_SQL = f"""
q AS (
  SELECT p_partkey AS id, p_partkey % 4 = 0 AS ring, p_partkey % 5 = 0 AND p_partkey % 4 <> 0 AS bridge, p_partkey % 3 = 0 AND p_partkey % 4 <> 0 AS act, p_partkey % 7 = 0 AND p_partkey % 4 <> 0 AS amd,
         translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 3 + p_size % 12), '0123456789abcdef', CASE WHEN p_partkey % 2 = 0 THEN '{_LETTERS}' ELSE '{_OTHERS}' END) AS w
  FROM part),
l AS (SELECT * REPLACE (CASE WHEN bridge THEN 'C' || w || 'c' ELSE w END AS w) FROM q),
{_RESIDUES},
b AS (
  SELECT id, sum(c) + 2 * any_value(act)::INT AS c, sum(h) + 2 * (NOT any_value(ring))::INT - 2 * any_value(bridge)::INT + 2 * any_value(act)::INT + any_value(amd)::INT AS h, sum(n) + any_value(amd)::INT AS n,
         sum(o) + (NOT any_value(ring))::INT + any_value(act)::INT - any_value(amd)::INT AS o, sum(s) AS s, sum(g) + (any_value(ring) OR any_value(bridge))::INT AS g
  FROM (SELECT *, unnest(string_split(w, '')) AS x FROM l) JOIN f ON upper(x) = f.a GROUP BY id),
m AS (SELECT *, 12.011 * c + 1.008 * h + 14.007 * n + 15.999 * o + 32.06 * s AS weight FROM b)"""


@query(f"""WITH {PEPTIDE_SQL}
SELECT id, round(weight, 3)::DOUBLE AS weight, (c + n + o + s)::INTEGER AS heavy_atoms, g::INTEGER AS rings, (n + o + s)::INTEGER AS hetero_atoms FROM m""")
def generated_structures(spark, sf):
    """Structures of peptides, linear, closed and bridged: weight, atoms and rings as their residues add up, read back from the text."""
    d = X.descriptors(peptides(spark, sf), "smiles")
    return d.select("id", r("descriptors.weight", 3).alias("weight"), *[F.col(f"descriptors.{c}").alias(c) for c in ("heavy_atoms", "rings", "hetero_atoms")])


@query(f"""WITH {PEPTIDE_SQL}
SELECT id, id % 11 <> 3 AS parses, CASE WHEN id % 11 <> 3 THEN id % 6 <> 1 END AS weight_ok, CASE WHEN id % 11 <> 3 THEN true END AS stable FROM m""")
def structure_integrity(spark, sf):
    """Structures against recorded weights, some of which are wrong, and whether their canonical texts read back as themselves; some texts are broken."""
    adds = {a: 12.011 * c + 1.008 * h + 14.007 * n + 15.999 * o + 32.06 * s for a, c, h, n, o, s, _ in _residue_rows()}
    table = F.create_map(*[F.lit(x) for kv in adds.items() for x in kv])
    sums = F.aggregate(F.filter(F.split(F.upper("letters"), ""), lambda x: x != ""), F.lit(0.0), lambda a, x: a + F.element_at(table, x))
    water = F.when(F.col("constraint") == "HT", 0.0).otherwise(18.015) - F.when(F.col("constraint") == "SS", 2.016).otherwise(0.0)
    ends = F.when(F.col("n").isNotNull(), 42.037).otherwise(0.0) - F.when(F.col("c").isNotNull(), 0.984).otherwise(0.0)
    k = F.col("id")
    d = peptides(spark, sf).withColumn("recorded", sums + water + ends + F.when(k % 6 == 1, 0.01).otherwise(0.0)).withColumn("smiles", F.when(k % 11 == 3, F.concat("smiles", F.lit("("))).otherwise(F.col("smiles")))
    return S.with_integrity(d, "smiles", "recorded").select("id", "parses", "weight_ok", "stable")


def _residue_rows():
    import ast

    return ast.literal_eval("[" + _RESIDUES.split("VALUES", 1)[1].rsplit(")", 1)[0] + "]")


@query("""
WITH l AS (SELECT p_partkey AS id, translate(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 3 + p_size % 3), '0123456789abcdef', 'AGSAGSaGsAGSaaGs') AS w FROM part),
m AS (SELECT id, list_min(list_transform(range(0, length(w)), lambda i: w[i + 1:] || w[:i])) AS least FROM l)
SELECT id, min(id) OVER (PARTITION BY least) AS class, count(*) OVER (PARTITION BY least) AS n FROM m""")
def structure_classes(spark, sf):
    """Rings of three to five residues by their canonical texts: those that start elsewhere are one structure, mirrored residues are not."""
    hexes = F.substr(F.md5(F.col("p_partkey").cast("string")), F.lit(1), (3 + F.col("p_size") % 3).cast("int"))
    none = F.lit(None).cast("string")
    ring = S.peptide_structure(F.translate(hexes, "0123456789abcdef", "AGSAGSaGsAGSaaGs"), none, none, F.lit("HT"), F.lit(0), F.lit(0))
    d = S.with_canonical(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), ring.alias("smiles")), "smiles")
    sizes = d.groupBy("canonical").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    return d.join(sizes, "canonical").select("id", "class", "n")


@query()
def fingerprint_links(spark, sf):
    """Peptides whose circular fingerprints are 90 % alike."""
    return S.fingerprint_links(peptides(spark, sf), "id", "smiles", 0.9).select("i", "j", r("similarity").alias("similarity"))


def _records(spark, sf):
    """Assays of parts: the name's head as sequence, no structure, one record a line item."""
    items = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_returnflag") == "R").alias("active"))
    heads = name_heads(spark, sf)
    sizes = t(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 4 == 0).alias("special"))
    return items.join(heads.hint("merge"), "k").join(sizes.hint("merge"), "k").select(F.col("k").alias("peptide_id"), F.col("s").alias("sequence"), F.lit(None).cast("string").alias("smiles"), "special", "active")


@query(f"""
WITH RECURSIVE {IDENTITY_SQL.replace(_HEADS, _HEADS + " WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")},
hard AS (SELECT i AS a, j AS b FROM links WHERE similarity >= 0.9 UNION SELECT j, i FROM links WHERE similarity >= 0.9),
g(x, y) AS (SELECT k, k FROM h UNION SELECT g.x, hard.b FROM g JOIN hard ON hard.a = g.y),
groups AS (SELECT x AS k, min(y) AS component FROM g GROUP BY x)
SELECT 'peptides' AS fact, count(*)::DOUBLE AS value FROM h UNION ALL SELECT 'records', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT 'hard_groups', count(DISTINCT component) FROM groups
UNION ALL SELECT 'hard_edges', count(*) / 2 FROM hard UNION ALL SELECT 'identity_edges', count(*) FROM links UNION ALL SELECT 'fingerprint_edges', 0 UNION ALL SELECT 'hard_crossing', 0 UNION ALL SELECT 'with_placeholder', count(*) FILTER (WHERE contains(s, 'X')) FROM h
UNION ALL SELECT 'whole_groups', count(DISTINCT component) FROM groups UNION ALL SELECT 'buckets', 6""")
def peptide_split(spark, sf):
    """The whole split over parts by their names: what it counts, hard links that cross, and groups of hard links that are in one bucket."""
    from ..operators import graph as G
    from ..operators.peptide_split import SplitPlan, build_split

    records = _records(spark, sf)
    rows, facts = build_split(records, SplitPlan(tries=5000))
    units = records.select("peptide_id", "sequence").distinct()
    links, classes = I.identity_graph(units, "peptide_id", "sequence", 0.9)
    hard = links.select(F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(classes.where("key <> first").select(F.col("first").alias("src"), F.col("key").alias("dst")))
    parts = G.components(units.select(F.col("peptide_id").alias("node")), hard)
    bucket = rows.select(F.col("peptide_id").alias("node"), F.concat_ws("_", "split", F.col("fold_id").cast("string")).alias("bucket"))
    whole = parts.join(bucket.hint("merge"), "node").groupBy("component").agg(F.countDistinct("bucket").alias("n")).agg(F.count_if(F.col("n") == 1).cast("double").alias("value")).select(F.lit("whole_groups").alias("fact"), "value")
    used = bucket.agg(F.countDistinct("bucket").cast("double").alias("value")).select(F.lit("buckets").alias("fact"), "value")
    kept = facts.where(F.col("fact").isin("peptides", "records", "hard_groups", "hard_edges", "identity_edges", "fingerprint_edges", "hard_crossing", "with_placeholder"))
    return kept.unionByName(whole).unionByName(used)


_WEIGHTS = {
    "embed": [[0.5, -0.3], [-0.25, 0.2]], "embed_b": [0.1, 0.05],
    "layers": [{"edge": [[0.2, -0.1], [0.4, 0.3]], "edge_b": [0.0, 0.1], "in": [[0.6, -0.2], [0.1, 0.5]], "in_b": [0.05, -0.05], "out": [[0.3, 0.7], [-0.4, 0.2]], "out_b": [0.0, 0.02], "scale": [1.0, 0.5], "shift": [0.0, 0.25], "eps": 0.1}],
}


@query("""
WITH x AS (SELECT c_custkey AS id, c_nationkey AS graph, c_acctbal / 10000 AS a, c_custkey % 3 AS b FROM customer),
h AS (SELECT id, graph, 0.5 * a - 0.25 * b + 0.1 AS p, -0.3 * a + 0.2 * b + 0.05 AS q FROM x),
c AS (SELECT id AS u, lead(id) OVER (PARTITION BY graph ORDER BY id) AS w FROM x),
e AS (SELECT u AS src, w AS dst, 1.0 AS k, u % 2 AS l FROM c WHERE w IS NOT NULL UNION ALL SELECT w, u, 1.0, u % 2 FROM c WHERE w IS NOT NULL),
m AS (SELECT dst, sum(greatest(p + 0.2 * k + 0.4 * l, 0)) AS p, sum(greatest(q - 0.1 * k + 0.3 * l + 0.1, 0)) AS q FROM e JOIN h ON src = id GROUP BY dst),
s AS (SELECT id, graph, h.p AS hp, h.q AS hq, 1.1 * h.p + coalesce(m.p, 0) AS p, 1.1 * h.q + coalesce(m.q, 0) AS q FROM h LEFT JOIN m ON dst = id),
i AS (SELECT *, greatest(0.6 * p + 0.1 * q + 0.05, 0) AS f, greatest(-0.2 * p + 0.5 * q - 0.05, 0) AS g FROM s),
o AS (SELECT id, graph, hp + 0.3 * f - 0.4 * g AS f, hq + 0.7 * f + 0.2 * g + 0.02 AS g FROM i),
n AS (SELECT graph, (f - (f + g) / 2) / sqrt(((f - g) / 2) * ((f - g) / 2) + 1e-5) AS f, 0.5 * (g - (f + g) / 2) / sqrt(((f - g) / 2) * ((f - g) / 2) + 1e-5) + 0.25 AS g FROM o)
SELECT graph, round(avg(f), 6) AS mean_f, round(avg(g), 6) AS mean_g, round(max(f), 6) AS max_f, round(max(g), 6) AS max_g, round(sum(f) / 100, 6) AS sum_f, round(sum(g) / 100, 6) AS sum_g FROM n GROUP BY graph""")
def graph_encodings(spark, sf):
    """One round of messages between customers that follow each other in their nation, and the nations' pooled states."""
    from pyspark.sql import Window

    from ..operators.networks import encode_graphs

    c = t(spark, sf, "customer")
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("graph"), F.array(F.col("c_acctbal") / 10000, (F.col("c_custkey") % 3).cast("double")).alias("x"))
    chain = c.select(F.col("c_custkey").alias("u"), F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("w")).where("w is not null").withColumn("e", F.array(F.lit(1.0), (F.col("u") % 2).cast("double")))
    edges = chain.select(F.col("u").alias("src"), F.col("w").alias("dst"), "e").unionByName(chain.select(F.col("w").alias("src"), F.col("u").alias("dst"), "e"))
    names = ("mean_f", "mean_g", "max_f", "max_g", "sum_f", "sum_g")
    return encode_graphs(nodes, edges, _WEIGHTS).select("graph", *[r(F.col("pooled")[k]).alias(n) for k, n in enumerate(names)])


@query(f"""WITH {PEPTIDE_SQL}, s AS (SELECT id, (c + n + o + s) AS n_nodes, (c + n + o + s) - 1 + g AS bonds FROM m)
SELECT id, n_nodes::BIGINT AS n_nodes, (2 * bonds)::BIGINT AS n_edges, coalesce(sum(n_nodes) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "first" FROM s""")
def structure_batch(spark, sf):
    """The peptides' structures as one batch of graphs: atoms, bonds both ways, and where each graph starts."""
    from ..operators.networks import graph_batch

    nodes, edges = graph_batch(peptides(spark, sf), "id", "smiles")
    per = nodes.groupBy(F.col("graph").alias("id")).agg(F.count("*").alias("n_nodes"), F.min("id").alias("first"), F.max("id").alias("_last"))
    own = edges.groupBy(F.col("graph").alias("id")).agg(F.count("*").alias("n_edges"), F.min(F.least("src", "dst")).alias("_low"), F.max(F.greatest("src", "dst")).alias("_high"))
    # numbers without gaps, and bonds between atoms of one graph
    whole = (F.col("_last") - F.col("first") + 1 == F.col("n_nodes")) & (F.col("_low") >= F.col("first")) & (F.col("_high") <= F.col("_last"))
    return per.join(own, "id").where(whole).select("id", "n_nodes", "first", "n_edges")


@query("""
WITH RECURSIVE x AS (SELECT c_acctbal / 5000 AS a, (c_custkey % 7) / 7 AS b, c_nationkey / 25 AS c, (c_mktsegment = 'BUILDING')::INT AS y, c_custkey % 5 = 0 AS v FROM customer),
w AS (
  SELECT 0 AS epoch, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, 0.0::DOUBLE AS r, 0.0::DOUBLE AS s
  UNION ALL
  SELECT epoch + 1, any_value(p) - 0.5 * avg(d * a), any_value(q) - 0.5 * avg(d * b), any_value(r) - 0.5 * avg(d * c), any_value(s) - 0.5 * avg(d)
  FROM (SELECT *, (CASE WHEN y = 1 THEN 2 ELSE 1 END) * (1 / (1 + exp(-(p * a + q * b + r * c + s))) - y) AS d FROM w, x WHERE NOT v AND epoch < 5) GROUP BY epoch),
l AS (SELECT epoch, v, y, p * a + q * b + r * c + s AS z FROM w, x)
SELECT epoch, round(avg((CASE WHEN y = 1 THEN 2 ELSE 1 END) * (ln(1 + exp(z)) - z * y)) FILTER (WHERE NOT v), 6) AS fit_loss, round(avg((CASE WHEN y = 1 THEN 2 ELSE 1 END) * (ln(1 + exp(z)) - z * y)) FILTER (WHERE v), 6) AS val_loss,
       round(avg(((z > 0) = (y = 1))::INT) FILTER (WHERE v), 6) AS val_accuracy FROM l GROUP BY epoch""")
def training_history(spark, sf):
    """Six epochs of a weighted linear model of customers, by gradient descent over all rows."""
    from ..operators.networks import fit_epochs

    k = F.col("c_custkey")
    d = t(spark, sf, "customer").select(F.array(F.col("c_acctbal") / 5000, (k % 7) / 7, F.col("c_nationkey") / 25).alias("x"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), (k % 5 == 0).alias("v"))
    history, _ = fit_epochs(d, "x", "y", "v", epochs=6, rate=0.5, adam=False, patience=9, weight=2.0)
    return history.select("epoch", *[r(c).alias(c) for c in ("fit_loss", "val_loss", "val_accuracy")])


@query(f"""WITH {PEPTIDE_SQL} SELECT id, (c + n + o + s)::INTEGER AS n_nodes, (2 * (c + n + o + s - 1 + g))::INTEGER AS n_edges, 36 AS node_dim, 11 AS edge_dim, c::INTEGER AS carbons, n::INTEGER AS nitrogens, o::INTEGER AS oxygens, s::INTEGER AS sulfurs FROM m""")
def structure_graphs(spark, sf):
    """The peptides' graphs: atoms by element, bonds both ways, and the lengths of their vectors."""
    d = peptides(spark, sf).select("id", X.structure_codes(F.col("smiles")).alias("g"))
    slot = lambda k: F.size(F.filter("g.nodes", lambda v: F.getbit(v, F.lit(k)) == 1))
    elements = [slot(X.ELEMENTS.index(x)).alias(name) for x, name in (("C", "carbons"), ("N", "nitrogens"), ("O", "oxygens"), ("S", "sulfurs"))]
    return d.select("id", F.size("g.nodes").alias("n_nodes"), F.size("g.edges").alias("n_edges"), F.size(X.slots(F.col("g.nodes")[0], X.NODE_DIM)).alias("node_dim"), F.size(X.slots(F.col("g.bonds")[0], X.EDGE_DIM)).alias("edge_dim"), *elements)


@query("""
WITH g AS (SELECT o_orderstatus AS s, count(*) AS total, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS l FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ROLLUP (o_orderstatus))
SELECT s AS o_orderstatus, (s IS NULL)::INTEGER AS all_rows, u AS "1-URGENT", l AS "5-LOW", total, round(100 * u / total, 6) AS "share_1-URGENT", round(100 * l / total, 6) AS "share_5-LOW" FROM g""")
def crosstab_totals(spark, sf):
    """Urgent and low orders by status, with totals and shares."""
    c = A.crosstab_totals(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"])
    return c.select(*[r(F.col(f"`{x}`")).alias(x) if x.startswith("share") else F.col(f"`{x}`") for x in c.columns])


@query("""SELECT o_custkey, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1""")
def customer_deviations(spark, sf):
    """Mean and sample deviation of each customer's orders, null for a single one."""
    return A.mean_std(t(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"], single=None).select("o_custkey", r("o_totalprice_mean").alias("mean"), r("o_totalprice_std", 4).alias("std"))


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND (l_orderkey, l_suppkey) IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""")
def wanted_pairs(spark, sf):
    """Line items of finished orders whose order and supplier have a returned one."""
    items = t(spark, sf, "lineitem")
    ids = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.wanted_activities(items.select("l_orderkey", "l_linenumber", "l_suppkey"), ids, items.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")
