"""Queries of the curation operators: records, species, thresholds, residues and files, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measurements as M
from ..functions import sequences as S
from ..operators import aggregates as A
from ..operators import checks as C
from ..operators import joins as J
from ..operators import records as R
from ..operators import residues as Z
from ..operators import taxa as X
from ..sources import readers as D
from ..sources.scratch import new_path
from .catalogue import query, r, t

_named = lambda c: F.struct(c.alias("name"))


def parts_as_records(spark, sf):
    """Every part as a raw record whose activities are its lineitems."""
    p, l = t(spark, sf, "part"), t(spark, sf, "lineitem")  # noqa: E741
    k = F.col("l_linenumber")
    activity = F.struct(
        _named(F.when(F.col("l_returnflag") == "N", "MIC").when(F.col("l_returnflag") == "R", "MIC50")).alias("activityMeasureGroup"), _named(F.concat_ws(" ", F.lit("Genus"), (F.col("l_suppkey") % 7).cast("string"))).alias("targetSpecies"),
        _named(F.when(k % 3 == 0, "µM").when(k % 3 == 1, "µg/ml").otherwise("%")).alias("unit"), F.concat(F.when(k == 1, ">").when(k == 2, "<").otherwise(""), F.col("l_quantity").cast("long")).alias("concentration"),
    )
    acts = l.groupBy(F.col("l_partkey").alias("id")).agg(F.collect_list(activity).alias("targetActivities"))
    n = F.col("p_partkey")
    bond = F.struct(_named(F.when(n % 5 == 0, "DSB").when(n % 5 == 1, "XYZ")).alias("type"), _named(F.when(n % 5 == 0, "CST").otherwise("LAC")).alias("cycleType"), _named(F.lit("SSB")).alias("chainParticipating"), F.lit(1).alias("position1"), F.lit(4).alias("position2"))
    return p.join(acts, n == acts.id, "left").select(
        n.alias("id"), F.upper("p_name").alias("sequence"), F.when(n % 4 > 0, _named(F.when(n % 4 == 1, "Dimer").otherwise("Monomer"))).alias("complexity"), _named(F.lit("Ribosomal")).alias("synthesisType"),
        F.when(n % 3 > 0, _named(F.when(n % 3 == 1, "ACT").otherwise("FOR"))).alias("nTerminus"), F.when(n % 6 == 0, _named(F.lit("AMD"))).alias("cTerminus"), F.array(_named(F.col("p_brand")), _named(F.lit("any"))).alias("targetGroups"), F.lit(None).cast("array<struct<name: string>>").alias("targetObjects"),
        F.when(n % 2 == 0, F.array(F.struct((n % 9).cast("int").alias("position"), _named(F.lit("D-ORN")).alias("modificationType")), F.struct(F.lit(None).cast("int").alias("position"), _named(F.lit("DAB")).alias("modificationType")))).alias("unusualAminoAcids"),
        F.when(n % 5 < 2, F.array(bond, bond)).alias("intrachainBonds"), F.when(n % 7 > 0, F.array(F.struct(F.when(n % 7 > 3, F.concat(F.lit("C"), n.cast("string"))).otherwise("").alias("smiles")))).alias("smiles"), "targetActivities",
    )


_ACTIVITY = """a AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'N' THEN 'MIC' WHEN 'R' THEN 'MIC50' END AS measure, 'Genus ' || CAST(l_suppkey % 7 AS VARCHAR) AS species,
  CASE l_linenumber % 3 WHEN 0 THEN 'µM' WHEN 1 THEN 'µg/ml' ELSE '%' END AS unit, (CASE l_linenumber WHEN 1 THEN '>' WHEN 2 THEN '<' ELSE '' END) || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS concentration, l_quantity, l_linenumber FROM lineitem)"""


@query("""
WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey AS peptide_id, upper(p_name) AS sequence, length(p_name) AS sequence_length, CASE p_partkey % 3 WHEN 1 THEN 'ACT' WHEN 2 THEN 'FOR' END AS nterminus, CASE WHEN p_partkey % 6 = 0 THEN 'AMD' END AS cterminus,
  'Ribosomal' AS synthesis_type, CASE WHEN p_partkey % 4 = 1 THEN 'Dimer' WHEN p_partkey % 4 > 1 THEN 'Monomer' END AS complexity, p_brand || '|any' AS target_groups, '' AS target_objects,
  CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n_unusual_aa, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 9 AS VARCHAR) || ':D-ORN' ELSE '' END AS unusual_aa_detail,
  p_partkey % 2 = 0 OR contains(upper(p_name), 'X') AS has_noncanonical, p_partkey % 2 = 0 AS has_d_residue, CASE WHEN p_partkey % 5 < 2 THEN 2 ELSE 0 END AS n_intrachain_bonds,
  CASE p_partkey % 5 WHEN 0 THEN 'DSB' WHEN 1 THEN 'XYZ' ELSE '' END AS bond_types, CASE p_partkey % 5 WHEN 0 THEN 'CST' WHEN 1 THEN 'LAC' ELSE '' END AS bond_cycletypes,
  p_partkey % 7 > 3 AS has_native_smiles, CASE WHEN p_partkey % 7 > 3 THEN 1 ELSE 0 END AS n_native_smiles, CASE WHEN p_partkey % 7 > 3 THEN 'C' || CAST(p_partkey AS VARCHAR) ELSE '' END AS smiles_native, coalesce(n, 0) AS n_target_activities
FROM part LEFT JOIN n ON l_partkey = p_partkey""")
def record_flatten(spark, sf):
    """Nested records as one wide row each."""
    return R.flatten(parts_as_records(spark, sf))


@query(f"""WITH {_ACTIVITY} SELECT id, measure, species, unit, concentration, count(*) AS n FROM a GROUP BY ALL""")
def record_activities(spark, sf):
    """All activities of the records, counted by all of their fields."""
    return R.activities(parts_as_records(spark, sf)).groupBy("id", "measure", "species", "unit", "concentration").agg(F.count("*").alias("n"))


@query(f"""
WITH {_ACTIVITY}, d AS (SELECT *, CASE WHEN species IN ('Genus 0', 'Genus 1') THEN 'Fungus' WHEN species = 'Genus 2' THEN 'Unknown' ELSE 'Bacteria' END AS domain FROM a)
SELECT coalesce(CASE WHEN measure IS DISTINCT FROM 'MIC' THEN 'measure:' || coalesce(measure, 'none') WHEN domain <> 'Bacteria' THEN 'domain:' || domain WHEN unit NOT IN ('µM', 'µg/ml') THEN 'unit:' || unit END, 'kept') AS reason, count(*) AS n FROM d GROUP BY 1""")
def activity_exclusions(spark, sf):
    """Activities by the first filter that takes them out: measure, domain of the species, unit."""
    a = R.activities(parts_as_records(spark, sf))
    domain = F.when(F.col("species").isin("Genus 0", "Genus 1"), "Fungus").when(F.col("species") == "Genus 2", "Unknown").otherwise("Bacteria")
    return A.funnel(a, R.exclusion(F.col("measure"), domain, F.col("unit")))


@query("""
SELECT l_orderkey, l_returnflag AS organism, min(l_quantity) AS "mic_min_uM", max(l_quantity) AS "mic_max_uM", round(avg(l_quantity), 6) AS "mic_value_uM" FROM lineitem GROUP BY ALL""")
def map_targets(spark, sf):
    """A map from return flags to bounds and mean, exploded to one row a key."""
    g = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array(F.min("l_quantity"), F.max("l_quantity"), r(F.avg("l_quantity"))).alias("v"))
    m = g.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "v"))).alias("targets"))
    return R.targets(m, "targets", ["l_orderkey"])


@query("""
SELECT p_partkey AS peptide_id, CASE WHEN p_size > 25 THEN 'baseline' ELSE 'recovered' END AS source, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'none' WHEN p_partkey % 3 = 1 THEN 'DSB' END, 'none') = 'none' AS linear FROM part""")
def final_schema(spark, sf):
    """Source and linearity of every part."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("peptide_id"), "p_size", F.when(F.col("p_partkey") % 3 == 0, "none").when(F.col("p_partkey") % 3 == 1, "DSB").alias("bond_type"))
    return R.final_rows(p, p.where("p_size > 25")).select("peptide_id", "source", "linear")


@query("""
WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN 'Dimer' WHEN p_partkey % 4 > 1 THEN 'Monomer' END AS cx, CASE p_partkey % 3 WHEN 1 THEN 'ACT' WHEN 2 THEN 'FOR' END AS nt, upper(p_name) AS s,
  CASE p_partkey % 5 WHEN 0 THEN 'DSB' WHEN 1 THEN 'XYZ' ELSE '' END AS bt, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 9 AS VARCHAR) || ':D-ORN' ELSE '' END AS noted, p_partkey % 7 > 3 AS native FROM part),
x AS (SELECT *, CASE WHEN cx IS DISTINCT FROM 'Monomer' THEN 'a' WHEN nt = 'FOR' THEN 'b' WHEN contains(s, 'X') AND NOT native THEN 'd' WHEN bt = 'XYZ' THEN 'e' END AS fails FROM f),
b AS (SELECT p_partkey AS id FROM part WHERE p_size <= 10 UNION ALL SELECT -n_nationkey - 1 FROM nation)
SELECT coalesce(x.id, b.id) AS peptide_id,
  CASE WHEN x.id IS NULL THEN 'c_only_in_baseline' WHEN b.id IS NOT NULL THEN 'in_both' WHEN fails = 'a' THEN 'b1_excluded_non_monomer' WHEN fails = 'b' THEN 'b2_excluded_unsupported_terminus' WHEN fails = 'd' THEN 'b3_excluded_residue_no_smiles' WHEN fails = 'e' THEN 'b4_excluded_nonstandard_bond' ELSE 'b5_excluded_unexplained' END AS bucket,
  CASE WHEN x.id IS NULL OR b.id IS NOT NULL THEN '' WHEN fails = 'a' THEN 'complexity=' || coalesce(cx, 'none') WHEN fails = 'b' THEN 'nterminus=' || nt WHEN fails = 'd' THEN 'codes=' || noted WHEN fails = 'e' THEN 'bonds=' || bt ELSE 'not explained' END AS reason
FROM x FULL JOIN b ON x.id = b.id""")
def recovery_buckets(spark, sf):
    """Every record against the baseline: in both, why it is left out, or only there."""
    f = R.flatten(parts_as_records(spark, sf))
    baseline = t(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("peptide_id")).union(t(spark, sf, "nation").select((-F.col("n_nationkey") - 1).cast("long")))
    fails = S.baseline_check(F.col("complexity"), F.col("nterminus"), F.col("cterminus"), F.col("sequence"), F.col("n_native_smiles"), F.when(F.col("bond_types") == "", F.array().cast("array<string>")).otherwise(F.split("bond_types", r"\|")))
    return R.baseline_buckets(f, baseline, fails)


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 3 THEN 'C' || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 2 = 0 THEN 'G' || CAST(p_partkey AS VARCHAR) END AS smiles,
  CASE WHEN p_partkey % 7 > 3 THEN 'native' WHEN p_partkey % 2 = 0 THEN 'generated(SS)' END AS source, CASE WHEN p_partkey % 7 > 3 OR p_partkey % 2 = 0 THEN '' ELSE 'several bonds' END AS reason FROM part""")
def structure_resolution(spark, sf):
    """The native structure, else a generated one, else the reason why there is none."""
    d = parts_as_records(spark, sf).select("id", R.native_structures(F.col("smiles")).alias("native"))
    made = F.when(F.col("id") % 2 == 0, F.concat(F.lit("G"), F.col("id").cast("string")))
    return d.select("id", R.resolved_structure(F.col("native"), made, F.lit("SS"), F.lit("several bonds")).alias("x")).select("id", "x.*")


@query("""
WITH x AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 1 THEN 'ACT' WHEN 2 THEN 'FOR' END AS nt, CASE WHEN p_partkey % 6 = 0 THEN 'AMD' END AS ct, p_partkey % 11 = 0 AS bad, (p_partkey % 5)::INT AS nb, p_partkey % 2 AS kind, p_partkey % 7 > 1 AS fit FROM part)
SELECT coalesce(CASE WHEN nt = 'FOR' THEN 'unsupported n-terminus' WHEN bad THEN 'unresolved residues' WHEN nb > 1 THEN 'several bonds' WHEN nb = 1 AND id % 13 = 0 THEN 'bond not generated'
  WHEN nb = 1 AND kind = 0 AND (nt = 'ACT' OR ct = 'AMD') THEN 'ring bond beside a changed terminus' WHEN nb = 1 AND kind = 1 AND NOT fit THEN 'bond ends cannot form it' END, 'generated') AS reason, count(*) AS n FROM x GROUP BY 1""")
def structure_refusals(spark, sf):
    """Why structures cannot be generated, by the first rule that says so."""
    n = F.col("p_partkey")
    bond = S.bond_class(F.when(n % 13 == 0, "LAN").when(n % 2 == 0, "NCB").otherwise("CST"), F.lit("SSB"))
    why = R.refusal(F.when(n % 11 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), F.when(n % 3 == 1, "ACT").when(n % 3 == 2, "FOR"), F.when(n % 6 == 0, "AMD"), (n % 5).cast("int"), bond, n % 7 > 1)
    return t(spark, sf, "part").select(F.coalesce(why, F.lit("generated")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
SELECT entity, value, count(*) AS n FROM (
  SELECT 'bond' AS entity, CASE p_partkey % 5 WHEN 0 THEN 'DSB' WHEN 1 THEN 'XYZ' END AS value FROM part UNION ALL
  SELECT 'complexity', CASE WHEN p_partkey % 4 = 1 THEN 'Dimer' WHEN p_partkey % 4 > 1 THEN 'Monomer' END FROM part UNION ALL
  SELECT 'code', CASE WHEN p_partkey % 2 = 0 THEN 'D-ORN' END FROM part) WHERE value IS NOT NULL GROUP BY ALL""")
def entity_rollups(spark, sf):
    """How often each bond type, complexity and residue code stands in the records."""
    d = parts_as_records(spark, sf).withColumn("noted", R.annotations(F.col("unusualAminoAcids")))
    some = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    return R.entity_counts(d, {"bond": R.names_of(F.col("intrachainBonds"), "type"), "complexity": some(F.col("complexity.name")), "code": F.transform("noted", lambda p: p["name"])})


_LINEAGE = [(1, None, "root"), (2, 1, "Bacteria"), (3, 2, "Firmicutes"), (4, 3, "cold"), (5, 3, "small"), (6, 1, "Eukaryota"), (7, 6, "Fungi"), (8, 7, "red"), (9, 6, "Metazoa"), (10, 9, "large"), (11, 1, "Viruses"), (12, 11, "shiny"), (13, 6, "algae"), (14, 4, "cold widget"), (15, 1, "Archaea")]


@query("""
WITH RECURSIVE p(taxon, parent, name) AS (VALUES (1, NULL, 'root'), (2, 1, 'Bacteria'), (3, 2, 'Firmicutes'), (4, 3, 'cold'), (5, 3, 'small'), (6, 1, 'Eukaryota'), (7, 6, 'Fungi'), (8, 7, 'red'), (9, 6, 'Metazoa'), (10, 9, 'large'), (11, 1, 'Viruses'), (12, 11, 'shiny'), (13, 6, 'algae'), (14, 4, 'cold widget'), (15, 1, 'Archaea')),
u(taxon, here) AS (SELECT taxon, taxon FROM p UNION ALL SELECT u.taxon, p.parent FROM u JOIN p ON p.taxon = u.here WHERE p.parent IS NOT NULL),
l AS (SELECT u.taxon, list(p.name) AS names FROM u JOIN p ON p.taxon = u.here GROUP BY 1),
s AS (SELECT DISTINCT p_name AS species, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS binomial FROM part)
SELECT species, binomial, CASE WHEN names IS NULL THEN 'Unknown' WHEN list_contains(names, 'Bacteria') THEN 'Bacteria' WHEN list_contains(names, 'Archaea') THEN 'Archaea' WHEN list_contains(names, 'Viruses') THEN 'Virus' WHEN list_contains(names, 'Fungi') THEN 'Fungus' WHEN list_contains(names, 'Metazoa') THEN 'Animal' ELSE 'Other' END AS domain,
  coalesce(b.taxon, g.taxon) AS taxon
FROM s LEFT JOIN p g ON g.name = string_split(binomial, ' ')[1] LEFT JOIN l ON l.taxon = g.taxon LEFT JOIN p b ON b.name = binomial""")
def species_dimension(spark, sf):
    """Domain, taxon and binomial of every part's name, from a table of parents."""
    p = spark.createDataFrame(_LINEAGE, "taxon int, parent int, name string")
    return X.species_dimension(t(spark, sf, "part").select(F.col("p_name").alias("species")), X.lineage_names(p), p.select("name", "taxon"))


_TABLE = [("cold widget", "species", "16", "32"), ("small", "genus", "8", "64"), ("red", "genus", "", ""), ("large widget", "species", " 4 ", "4"), ("shiny", "genus", "1e1", "20.5")]
_TABLE_SQL = "h(match_key, level, active, inactive) AS (VALUES ('cold widget', 'species', 16.0::DOUBLE, 32.0::DOUBLE), ('small', 'genus', 8, 64), ('large widget', 'species', 4, 4), ('shiny', 'genus', 10, 20.5))"


def thresholds(spark):
    return X.load_thresholds(spark.createDataFrame(_TABLE, "match_key string, level string, active_threshold_uM string, inactive_threshold_uM string"))


@query("""
WITH x AS (
  SELECT p_partkey AS id, 'k' || CAST(p_partkey - (p_partkey % 30 = 11)::INT AS VARCHAR) AS k, CASE p_partkey // 2 % 5 WHEN 0 THEN 'family' WHEN 1 THEN 'genus' ELSE 'species' END AS level,
         CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS a, CASE p_size % 4 WHEN 0 THEN '' ELSE CAST(p_size + p_partkey % 7 - 2 AS VARCHAR) END AS i
  FROM part),
f AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k, level) > 1 THEN 'duplicate' WHEN level = 'family' THEN 'unknown_level' WHEN (a = '') <> (i = '') THEN 'partial_fill' WHEN a LIKE 'x%' THEN 'not_a_number' WHEN TRY_CAST(a AS DOUBLE) > TRY_CAST(i AS DOUBLE) THEN 'reversed' END AS fault FROM x)
SELECT id, fault FROM f""")
def threshold_faults(spark, sf):
    """What is wrong with the rows of a threshold table that is made from parts: doubled keys, unknown levels, gaps, text and reversed breakpoints."""
    k, n = F.col("p_partkey"), F.col("p_size")
    level = F.floor(k / 2) % 5
    rows = t(spark, sf, "part").select(
        k.alias("id"), F.concat(F.lit("k"), (k - (k % 30 == 11).cast("int")).cast("string")).alias("match_key"), F.when(level == 0, "family").when(level == 1, "genus").otherwise("species").alias("level"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(F.lit("x"), n.cast("string"))).otherwise(n.cast("string")).alias("active_threshold_uM"), F.when(n % 4 == 0, "").otherwise((n + k % 7 - 2).cast("string")).alias("inactive_threshold_uM"),
    )
    return X.threshold_faults(rows).select("id", "fault")


_LABELS_SQL = f"""{_TABLE_SQL},
o AS (SELECT l_orderkey, l_linenumber, p_name AS organism, l_quantity AS v, l_linenumber % 3 = 0 AS censored FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT o.*, coalesce(s.active, g.active) AS active, coalesce(s.inactive, g.inactive) AS inactive, CASE WHEN s.active IS NOT NULL THEN 'species' WHEN g.active IS NOT NULL THEN 'genus' ELSE 'none' END AS matched
  FROM o LEFT JOIN h s ON s.level = 'species' AND s.match_key = organism LEFT JOIN h g ON g.level = 'genus' AND g.match_key = split_part(organism, ' ', 1)),
y AS (SELECT *, CASE WHEN active IS NULL THEN 'unlabeled' WHEN (CASE WHEN censored THEN v + 10 ELSE v END) <= active THEN 'active' WHEN (CASE WHEN censored THEN v / 2 ELSE v END) >= inactive THEN 'inactive' ELSE 'uncertain' END AS label FROM m)"""


def labelled(spark, sf):
    """Lineitems as measurements with thresholds and labels."""
    d = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_name").alias("organism"), F.col("l_quantity").alias("value"), F.when(F.col("l_linenumber") % 3 == 0, "censored").otherwise("exact").alias("mic_type"), (F.col("l_quantity") / 2).alias("low"), (F.col("l_quantity") + 10).alias("high"))
    d = X.with_thresholds(d, thresholds(spark))
    return d.withColumn("label", M.label(F.col("mic_type"), F.col("value"), F.col("active"), F.col("inactive"), F.col("low"), F.col("high"))["label"])


@query(f"""WITH {_LABELS_SQL} SELECT l_orderkey, l_linenumber, matched, label FROM y""")
def threshold_labels(spark, sf):
    """Every measurement's label by the thresholds of its species, else its genus."""
    return labelled(spark, sf).select("l_orderkey", "l_linenumber", "matched", "label")


@query(f"""WITH {_LABELS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber = 7) AS level_mismatches, count(*) FILTER (WHERE l_linenumber = 6 AND label <> 'active') AS label_mismatches FROM y""")
def label_recheck(spark, sf):
    """How many labels and match levels differ from an independent second labelling, some of them planted."""
    d = labelled(spark, sf).select("organism", "mic_type", "value", "low", "high", F.when(F.col("l_linenumber") == 7, "other").otherwise(F.col("matched")).alias("matched"), F.when(F.col("l_linenumber") == 6, "active").otherwise(F.col("label")).alias("label"))
    return X.label_mismatches(d, thresholds(spark))


@query(f"""WITH {_LABELS_SQL} SELECT matched, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM y GROUP BY ALL""")
def label_distribution(spark, sf):
    """Coverage of the thresholds and distribution of labels."""
    from pyspark.sql import Window

    g = labelled(spark, sf).groupBy("matched", "label").agg(F.count("*").alias("n"))
    return g.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("""
WITH o AS (SELECT p_name AS organism, l_suppkey AS taxon FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'species' AS level, organism AS match_key, min(taxon) AS taxon, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'genus', split_part(organism, ' ', 1), min(taxon), count(*) FROM o GROUP BY 2""")
def threshold_template(spark, sf):
    """Species and genera with their rows and smallest taxon: what a threshold table is to cover."""
    d = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("organism"), F.col("l_suppkey").alias("taxon"))
    return X.template(d)


@query(f"""
WITH {_TABLE_SQL}
SELECT p_name AS organism, count(*) AS n FROM part ANTI JOIN h ON level = 'species' AND match_key = p_name GROUP BY 1 ORDER BY n DESC, organism LIMIT 20""")
def threshold_punch_list(spark, sf):
    """The twenty most frequent names that have no thresholds of their own."""
    return X.unfilled(t(spark, sf, "part").select(F.col("p_name").alias("organism")), thresholds(spark))


@query(f"""
WITH {_TABLE_SQL}
SELECT match_key, level, active, inactive FROM h WHERE (level = 'species' AND match_key IN (SELECT p_name FROM part)) OR (level = 'genus' AND match_key IN (SELECT split_part(p_name, ' ', 1) FROM part))""")
def thresholds_in_use(spark, sf):
    """The thresholds that some part's name matches."""
    return X.thresholds_in_use(thresholds(spark), t(spark, sf, "part").select(F.col("p_name").alias("organism")))


@query("""
WITH m AS (SELECT l_orderkey AS id, l_returnflag AS organism, CASE l_linestatus WHEN 'O' THEN 'exact' ELSE 'censored' END AS censor, 0.0::DOUBLE AS low, l_quantity AS high FROM lineitem),
w AS (SELECT DISTINCT o_orderkey AS id, 'R' AS organism FROM orders), g AS (SELECT id, organism, count(*) AS n, min(high) AS high FROM m WHERE censor <> 'exact' GROUP BY ALL)
SELECT id, organism, CASE WHEN n = 1 THEN 'recovered' WHEN n IS NULL THEN 'zero_matches' ELSE 'multi_matches' END AS status, CASE WHEN n = 1 THEN 'censored' ELSE '' END AS censor_type, 0.0::DOUBLE AS low, CASE WHEN n = 1 THEN high ELSE 1e9 END AS high FROM w LEFT JOIN g USING (id, organism)""")
def censor_recovery(spark, sf):
    """Bounds of every order's returned measurement, if exactly one is open."""
    m = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("organism"), F.when(F.col("l_linestatus") == "O", "exact").otherwise("censored").alias("censor"), F.lit(0.0).alias("low"), F.col("l_quantity").alias("high"))
    w = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("R").alias("organism"))
    d = X.recovered_bounds(w, m, ["id", "organism"])
    return d.withColumn("high", F.when(F.col("high") == float("inf"), 1e9).otherwise(F.col("high")))


_CODES = [("ORN", "O"), ("DAB", "B"), ("ABA", "A"), ("NVA", "V"), ("DUP", "D"), ("DUP", "E")]


@query("""
WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'D-Orn' WHEN 1 THEN ' dab ' WHEN 2 THEN 'Abu' WHEN 3 THEN 'NVAL' WHEN 4 THEN 'Dup' WHEN 5 THEN 'zzz' ELSE 'd-ABA' END AS code FROM part),
x AS (SELECT *, upper(regexp_replace(trim(code), '^[Dd]-', '')) AS base, regexp_matches(trim(code), '^[Dd]-') AS is_d FROM c)
SELECT id, base, is_d, CASE base WHEN 'ORN' THEN 'O' WHEN 'DAB' THEN 'B' WHEN 'ABU' THEN 'A' WHEN 'ABA' THEN 'A' WHEN 'NVAL' THEN 'V' END AS letter, CASE base WHEN 'DUP' THEN 'ambiguous code DUP' WHEN 'ZZZ' THEN 'unknown code ZZZ' ELSE '' END AS reason FROM x""")
def residue_codes(spark, sf):
    """Residue codes by a code table with synonyms; unknown and ambiguous ones are told, not guessed."""
    n = F.col("p_partkey") % 7
    c = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(n == 0, "D-Orn").when(n == 1, " dab ").when(n == 2, "Abu").when(n == 3, "NVAL").when(n == 4, "Dup").when(n == 5, "zzz").otherwise("d-ABA").alias("code"))
    return Z.resolve_codes(c, spark.createDataFrame(_CODES, "code string, letter string")).drop("code")


@query("""
WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ACXK' WHEN 1 THEN 'AC1K' WHEN 2 THEN 'ACDK' ELSE 'XXAK' END AS s, p_partkey % 3 AS u FROM part)
SELECT id, CASE WHEN id % 4 = 2 THEN CASE u WHEN 0 THEN 'ACOK' WHEN 1 THEN 'ACoK' END WHEN id % 4 = 0 THEN CASE u WHEN 0 THEN 'ACOK' WHEN 1 THEN 'ACoK' END WHEN id % 4 = 1 THEN CASE u WHEN 0 THEN 'ACOK' WHEN 1 THEN 'ACoK' END END AS letters,
  CASE WHEN id % 4 = 3 THEN 'position 1: unresolved residue X|position 2: unresolved residue X' || CASE WHEN u = 2 THEN '|position 3: unknown code QQQ' ELSE '' END WHEN u = 2 THEN 'position 3: unknown code QQQ' ELSE '' END AS reasons FROM p""")
def residue_letters(spark, sf):
    """Each sequence's letters with annotated positions resolved, or all reasons why not."""
    n = F.col("p_partkey")
    seq = F.when(n % 4 == 0, "ACXK").when(n % 4 == 1, "AC1K").when(n % 4 == 2, "ACDK").otherwise("XXAK")
    noted = F.array(F.struct(F.lit(3).alias("pos"), F.when(n % 3 == 0, "ORN").when(n % 3 == 1, "D-ORN").otherwise("QQQ").alias("name")))
    d = Z.resolve_letters(t(spark, sf, "part").select(n.alias("id"), seq.alias("sequence"), noted.alias("noted")), spark.createDataFrame(_CODES, "code string, letter string"), S.CANONICAL + "Oo")
    return d.select("id", "letters", F.array_join("reasons", "|").alias("reasons"))


_SEQ = "CASE p_partkey % 8 WHEN 0 THEN 'ACDE' WHEN 1 THEN 'AcDE' WHEN 2 THEN 'AXDE' WHEN 3 THEN 'AODE' WHEN 4 THEN 'Ab1E' WHEN 5 THEN ' ACD' WHEN 6 THEN '' ELSE 'xxYZ' END"


def _seq():
    n = F.col("p_partkey") % 8
    return F.when(n == 0, "ACDE").when(n == 1, "AcDE").when(n == 2, "AXDE").when(n == 3, "AODE").when(n == 4, "Ab1E").when(n == 5, " ACD").when(n == 6, "").otherwise("xxYZ")


@query(f"""
WITH s AS (SELECT p_partkey AS id, {_SEQ} AS s, p_partkey % 8 AS k, p_partkey % 5 = 0 AS a FROM part)
SELECT id, contains(upper(s), 'X') AS placeholder, CASE WHEN NOT contains(upper(s), 'X') THEN upper(s) END AS comparable, regexp_matches(s, '[a-z]') AS lowercase, a OR regexp_matches(s, '[a-z]') OR contains(upper(s), 'X') AS noncanonical,
  a OR regexp_matches(s, '[a-z]') AS d_residue, NOT regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]*') AS outside, s <> trim(s) AS padded,
  CASE k WHEN 0 THEN 'canonical' WHEN 1 THEN 'D-canonical-residue' WHEN 2 THEN 'other_unresolved(has_smiles)' WHEN 3 THEN 'ornithine' WHEN 4 THEN 'dab+other_char:1' WHEN 5 THEN 'other_char: ' WHEN 6 THEN 'canonical' ELSE 'D-canonical-residue+other_char:Z' END AS kinds FROM s""")
def residue_flags(spark, sf):
    """Placeholder, case, alphabet and kinds of residues of sequences of all sorts."""
    d = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), _seq().alias("s"), (F.col("p_partkey") % 5 == 0).alias("a"))
    names, s = F.when(F.col("a"), F.array(F.lit("d-Ala"))).otherwise(F.array(F.lit("Ala"))), F.col("s")
    return d.select("id", S.has_placeholder(s).alias("placeholder"), S.comparable(s).alias("comparable"), S.has_lowercase(s).alias("lowercase"), S.noncanonical(s, F.when(F.col("a"), F.array(F.lit("x")))).alias("noncanonical"), S.d_residue(s, names).alias("d_residue"), S.outside_alphabet(s).alias("outside"), S.padded(s).alias("padded"), S.residue_kinds(s).alias("kinds"))


@query("""
WITH b AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'CST' WHEN 1 THEN 'NCB' WHEN 2 THEN 'DKP' WHEN 3 THEN 'LAN' WHEN 4 THEN 'QQQ' WHEN 5 THEN NULL ELSE 'LAC' END AS c, CASE p_partkey % 3 WHEN 0 THEN 'SSB' WHEN 1 THEN 'SMB' ELSE 'MMB' END AS h FROM part),
x AS (SELECT *, CASE WHEN c = 'CST' THEN 'SS' WHEN c IN ('NCB', 'DKP') THEN 'HT' WHEN c = 'LAC' AND h = 'SSB' THEN 'SCSC' WHEN c = 'LAC' AND h = 'SMB' THEN 'SCNT_OR_SCCT' END AS con FROM b)
SELECT con AS "constraint", con IS NOT NULL AS convertible, CASE WHEN con IS NOT NULL THEN '' WHEN c = 'LAC' THEN 'lactam with chain MMB' WHEN c = 'LAN' THEN 'no generator for cycle type LAN' ELSE 'unknown cycle type ' || coalesce(c, 'none') END AS reason, count(*) AS n FROM x GROUP BY ALL""")
def bond_classes(spark, sf):
    """What intrachain bonds become, by cycle type and chain."""
    k, h = F.col("p_partkey") % 9, F.col("p_partkey") % 3
    cycle = F.when(k == 0, "CST").when(k == 1, "NCB").when(k == 2, "DKP").when(k == 3, "LAN").when(k == 4, "QQQ").when(k > 5, "LAC")
    d = t(spark, sf, "part").select(S.bond_class(cycle, F.when(h == 0, "SSB").when(h == 1, "SMB").otherwise("MMB")).alias("b"))
    return d.select("b.*").groupBy("constraint", "convertible", "reason").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS id, 'O' || substr(upper(p_name), 2) AS common, CASE WHEN p_partkey % 2 = 0 THEN 'CC(=O)' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'CCN' ELSE 'CCO' END AS ends, split_part(trim(p_name), ' ', 1) AS genus, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS binomial,
  trim(split_part(split_part(p_name || ': note (x)', ':', 1), '(', 1)) AS reason, sha256(p_name) AS digest FROM part""")
def sequence_functions(spark, sf):
    """Substituted residues, termini, species names, reason groups and digests."""
    n, name = F.col("p_partkey"), F.col("p_name")
    noted = F.array(F.struct(F.lit(1).alias("pos"), F.lit("ORN").alias("name")), F.struct(F.lit(2).alias("pos"), F.lit("other").alias("name")))
    return t(spark, sf, "part").select(
        n.alias("id"), S.common_sequence(F.upper(name), noted).alias("common"), S.with_termini(F.lit("CCO"), F.when(n % 2 == 0, "ACT"), F.when(n % 3 == 0, "AMD")).alias("ends"), S.genus(name).alias("genus"), S.binomial(name).alias("binomial"),
        S.reason_group(F.concat(name, F.lit(": note (x)"))).alias("reason"), S.sequence_id(name).alias("digest"),
    )


@query("""
WITH r AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'rdkit_vocab_cv' WHEN 1 THEN 'molgraph_kmer_cv' WHEN 2 THEN 'rdkit_none_cv' ELSE 'baseline' END AS run FROM supplier)
SELECT id, CASE id % 4 WHEN 0 THEN 'RDKit × vocab' WHEN 1 THEN 'MolGraph × k-mer' ELSE run END AS label, CASE WHEN id % 4 < 3 THEN split_part(run, '_', 1) END AS peptide, CASE WHEN id % 4 < 3 THEN split_part(run, '_', 2) END AS organism FROM r""")
def run_labels(spark, sf):
    """Names of runs as labels and parts."""
    k = F.col("s_suppkey") % 4
    run = F.when(k == 0, "rdkit_vocab_cv").when(k == 1, "molgraph_kmer_cv").when(k == 2, "rdkit_none_cv").otherwise("baseline")
    d = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), S.pretty_label(run).alias("label"), S.run_parts(run).alias("p"))
    return d.select("id", "label", "p.peptide", "p.organism")


@query("""
WITH s AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN ' ACD' WHEN 1 THEN 'ACD' END AS a, CASE p_partkey % 5 WHEN 0 THEN 'ACD ' WHEN 1 THEN NULL ELSE 'ACD' END AS b FROM part)
SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'missing_from_one_or_both_sources' WHEN b <> trim(b) THEN 'final_dataset_unexpectedly_dirty' WHEN a <> trim(a) THEN 'as_expected' ELSE 'source_copy_unexpectedly_cleaned' END AS state, count(*) AS n FROM s GROUP BY 1""")
def whitespace_states(spark, sf):
    """How padded sequences came through, in five states."""
    n = F.col("p_partkey")
    state = S.whitespace_state(F.when(n % 3 == 0, " ACD").when(n % 3 == 1, "ACD"), F.when(n % 5 == 0, "ACD ").when(n % 5 != 1, "ACD"))
    return t(spark, sf, "part").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(f"""
WITH {_ACTIVITY}, k AS (SELECT p_partkey AS id FROM part WHERE p_size > 40), d AS (SELECT 'Genus ' || CAST(g AS VARCHAR) AS species, CASE WHEN g < 4 THEN 'Bacteria' ELSE 'Fungus' END AS domain FROM range(6) r(g))
SELECT id, domain, unit, count(*) AS n FROM a SEMI JOIN k USING (id) LEFT JOIN d USING (species) GROUP BY ALL""")
def activity_index(spark, sf):
    """Activities of some records with their species' domain; a species that the dimension lacks has none."""
    ids = t(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("id"))
    dim = spark.createDataFrame([(f"Genus {g}", "Bacteria" if g < 4 else "Fungus", g, f"Genus {g}") for g in range(6)], "species string, domain string, taxon int, binomial string")
    return R.activity_index(parts_as_records(spark, sf), ids, dim).groupBy("id", "domain", "unit").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT l_orderkey AS id, l_partkey AS part, count(*) AS n, min(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
w AS (SELECT l_orderkey AS id, l_partkey AS part, l_quantity AS q FROM lineitem),
x AS (SELECT w.q * 1000 / (w.part + 100) AS a, (o.q + CASE WHEN w.part % 10 = 0 THEN 1 ELSE 0 END) * 1000 / (w.part + 100) AS b FROM w JOIN o USING (id, part) WHERE o.n = 1)
SELECT count(*) AS traced, count(*) FILTER (WHERE abs(a - b) > 0.01 * greatest(abs(a), abs(b))) AS mismatches FROM x""")
def unit_recheck(spark, sf):
    """Values recomputed from the only raw measurement of each pair, against a tolerance of one in a hundred."""
    l = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), "l_returnflag", "l_quantity")  # noqa: E741
    raw = l.where("l_returnflag <> 'R'").select("id", "part", F.col("l_quantity").alias("raw"))
    j = J.single_source(l.select("id", "part", "l_quantity"), raw, ["id", "part"])
    weight = F.col("part") + 100
    a = M.to_micromolar(F.col("l_quantity"), weight)
    b = M.to_micromolar(F.col("raw") + F.when(F.col("part") % 10 == 0, 1).otherwise(0), weight)
    return j.agg(F.count("*").alias("traced"), F.count_if(~M.close(a, b, 0.01)).alias("mismatches"))


@query("""
WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN ' 12 ' WHEN 1 THEN '1.5' WHEN 2 THEN '1e3' WHEN 3 THEN '-2' WHEN 4 THEN 'abc' ELSE '' END AS s FROM orders)
SELECT id, id % 6 < 2 AS plain, CAST(CASE id % 6 WHEN 0 THEN 12.0 WHEN 1 THEN 1.5 WHEN 2 THEN 1000.0 WHEN 3 THEN -2.0 END AS DOUBLE) AS number, format('{:,}', id * 1001) AS shown FROM x""")
def text_numbers(spark, sf):
    """Texts as numbers where they are some, and numbers with commas."""
    k = F.col("o_orderkey") % 6
    s = F.when(k == 0, " 12 ").when(k == 1, "1.5").when(k == 2, "1e3").when(k == 3, "-2").when(k == 4, "abc").otherwise("")
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), M.plain_number(s).alias("plain"), M.coerced(s).alias("number"), M.thousands(F.col("o_orderkey") * 1001).alias("shown"))


@query("""
WITH b AS (SELECT l_partkey, l_suppkey, l_shipdate, CASE l_linenumber % 4 WHEN 0 THEN 0.0 ELSE l_quantity END AS low, CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity + 3 ELSE l_quantity END AS high FROM lineitem),
p AS (SELECT l_partkey, l_suppkey, low AS x FROM b WHERE low <> 0 UNION ALL SELECT l_partkey, l_suppkey, high FROM b),
q AS (SELECT l_partkey, l_suppkey, count(*) AS n_points, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM p GROUP BY ALL),
k AS (SELECT p.l_partkey, p.l_suppkey, count(*) AS n_used, avg(x) AS m FROM p JOIN q USING (l_partkey, l_suppkey) WHERE n_points < 4 OR x BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo) GROUP BY ALL),
g AS (SELECT l_partkey, l_suppkey, count(*) AS n_rows, count(*) FILTER (WHERE low <> 0 AND low = high) AS e, min(l_shipdate) AS l_shipdate FROM b GROUP BY ALL)
SELECT l_partkey, l_suppkey, CAST(printf('%.3g', m) AS DOUBLE) AS mean, n_points, n_used, n_rows, CASE WHEN n_rows >= 2 THEN 'averaged' WHEN e > 0 THEN 'exact' ELSE 'censored' END AS kind, l_shipdate FROM k JOIN q USING (l_partkey, l_suppkey) JOIN g USING (l_partkey, l_suppkey)""")
def robust_mean_kinds(spark, sf):
    """Robust means of three digits with the kind of measurement and the smallest date."""
    k = F.col("l_linenumber") % 4
    d = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", F.when(k == 0, 0.0).otherwise(F.col("l_quantity")).alias("low"), F.when(k == 1, F.col("l_quantity") + 3).otherwise(F.col("l_quantity")).alias("high"))
    return A.robust_mean(d, ["l_partkey", "l_suppkey"], digits=3, first=["l_shipdate"])


# files: written to the shared folder, then read


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, '') AS c_mktsegment FROM customer""")
def csv_round_trip(spark, sf):
    """Customers written as CSV and read again with a schema."""
    d, path = t(spark, sf, "customer"), new_path(spark, "files")
    D.write_csv(d, path, d.columns)
    return D.csv(spark, path, d.schema)


@query("""SELECT run, count(*) AS n, sum(x)::BIGINT AS x FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS run, n_nationkey AS x FROM nation) GROUP BY 1""")
def csv_runs(spark, sf):
    """Tables of two runs, gzipped, read as one; a missing optional table adds nothing."""
    d, path = t(spark, sf, "nation").select(F.col("n_nationkey").alias("x"), "n_name"), new_path(spark, "files")
    for k, name in enumerate(("even", "odd")):
        D.write_csv(d.where(F.col("x") % 2 == k), f"{path}/{name}.csv", ["x", "n_name"], compress=True)
    more = D.csv(spark, f"{path}/none.csv", "x int, n_name string", optional=True).withColumn("run", F.lit("none"))
    return D.run_tables(spark, path, ["even", "odd"], "x int, n_name string").unionByName(more).groupBy("run").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@query("""SELECT n_nationkey AS id, n_name || '-3' AS name FROM nation""")
def jsonl_last_record(spark, sf):
    """Three versions of each record as JSON lines, of which the last counts."""
    d, path = t(spark, sf, "nation"), new_path(spark, "files")
    v = d.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(F.col("n_nationkey").cast("long").alias("id"), F.concat_ws("-", "n_name", "v").alias("name"), "v")
    v.coalesce(1).sortWithinPartitions("v").drop("v").write.json(path)
    return D.records(spark, path, "id long, name string", "id")


@query("""SELECT DISTINCT n_nationkey AS id FROM nation""")
def jsonl_fetched_ids(spark, sf):
    """Ids of a file of records that ends in the middle of a line."""
    path = new_path(spark, "files")
    ids = t(spark, sf, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"))).alias("value"))
    ids.union(ids).union(spark.createDataFrame([('{"id": 9',), ("",)], "value string")).write.text(path)
    return D.fetched_ids(spark, path).select(F.col("id").cast("int").alias("id"))


@query("""SELECT r_regionkey AS id, r_name AS name FROM region""")
def json_document(spark, sf):
    """A small table as one JSON document, read again."""
    path = new_path(spark, "files")
    D.write_text(spark, path, D.artifact(t(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), "regions"))
    return D.document(spark, path, "method string, rows array<struct<id: int, name: string>>").where("method = 'regions'").select(F.explode("rows").alias("x")).select("x.*")


@query("""SELECT 's' || CAST(s_suppkey AS VARCHAR) AS record, 's' || CAST(s_suppkey AS VARCHAR) || ' ' || s_name AS header, upper(regexp_replace(s_name, '\\s', '', 'g')) AS sequence FROM supplier WHERE s_name <> ''""")
def fasta_records(spark, sf):
    """Suppliers' names as sequences over several lines of a FASTA file; a record without sequence has no row."""
    d, path = t(spark, sf, "supplier"), new_path(spark, "files")
    body = F.concat(F.lit(">s"), F.col("s_suppkey").cast("string"), F.lit(" "), F.col("s_name"), F.lit("\n"), F.lower(F.substr("s_name", F.lit(1), F.lit(3))), F.lit("\n\n "), F.substr("s_name", F.lit(4)), F.lit("\n"))
    d.select(body.alias("value")).union(spark.createDataFrame([(">none\n",)], "value string")).write.text(path)
    return D.fasta(spark, path, keep_empty=False).select("record", "header", "sequence")


_GENOME = "repeat('ACGTTGCAAC', 400)"


@query(f"""
WITH f AS (SELECT s_suppkey AS k, 'c' || CAST(s_suppkey AS VARCHAR) AS record, CAST(s_suppkey % 50 AS INT) + 1 AS start, s_suppkey % 2 = 0 AS minus FROM supplier)
SELECT record, start, CASE WHEN minus THEN reverse(translate(substr({_GENOME}, start, 1300), 'ACGT', 'TGCA')) ELSE substr({_GENOME}, start, 1300) END AS sequence FROM f""")
def gff_longest_gene(spark, sf):
    """The longest full-length 16S gene of each supplier's contig, from a GFF file with other and short features."""
    d, path = t(spark, sf, "supplier"), new_path(spark, "files")
    k = F.col("s_suppkey")
    line = lambda kind, start, end, strand, product: F.concat_ws("\t", F.concat(F.lit("c"), k.cast("string")), F.lit("src"), F.lit(kind), start.cast("string"), end.cast("string"), F.lit("."), strand, F.lit("."), F.lit(f"ID=x;product={product}"))
    strand, start = F.when(k % 2 == 0, "-").otherwise("+"), k % 50 + 1
    rows = [line("rRNA", start, start + 1299, strand, "16S ribosomal RNA"), line("rRNA", start, start + 1249, strand, "16S ribosomal RNA, partial"), line("rRNA", start, start + 99, strand, "5S ribosomal RNA"), line("rRNA", start, start + 1899, strand, "16S ribosomal RNA"), line("gene", start, start + 1399, strand, "16S ribosomal RNA"), F.lit("# comment"), F.lit("short\tline")]
    d.select(F.explode(F.array(*rows)).alias("value")).write.text(path)
    from ..operators.features import longest_gene

    f = D.gff(spark, path).withColumn("file", F.col("record"))
    records = d.select(F.concat(F.lit("c"), k.cast("string")).alias("record"), F.expr("repeat('ACGTTGCAAC', 400)").alias("sequence")).withColumn("file", F.col("record"))
    return longest_gene(records, f).select("record", "start", "sequence")


@query("""SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS index FROM (SELECT DISTINCT event_type AS token FROM events)""")
def vocabulary_lines(spark, sf):
    """A vocabulary file whose line numbers are the ids."""
    path = new_path(spark, "files")
    # one line an event type
    lines = [x[0] for x in t(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]
    D.write_text(spark, path, "\n".join(lines) + "\n")
    return D.vocabulary_file(spark, path)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN c_custkey % 6 > 0 THEN (c_custkey % 6 - 1)::INTEGER END AS fold_id, CASE WHEN c_custkey % 6 = 0 THEN 'test' ELSE 'fold_' || CAST(c_custkey % 6 - 1 AS VARCHAR) END AS bucket FROM customer""")
def split_file(spark, sf):
    """A split file whose folds are written in several ways, and the bucket's name."""
    d, path = t(spark, sf, "customer"), new_path(spark, "files")
    k = F.col("c_custkey") % 6
    fold = F.when(k == 0, "").when(k == 1, "0").otherwise(F.concat((k - 1).cast("string"), F.lit(".0")))
    D.write_csv(d.select("c_custkey", F.when(k == 0, "test").otherwise("train").alias("split"), fold.alias("fold_id")), path, ["c_custkey", "split", "fold_id"])
    s = D.csv(spark, path, "c_custkey long, split string, fold_id string").withColumn("fold_id", M.fold_number(F.col("fold_id")))
    return s.withColumn("bucket", F.when(F.col("split") == "test", "test").otherwise(F.concat_ws("_", F.lit("fold"), F.col("fold_id").cast("string"))))


@query("""SELECT event_id, user_id % 2 = 0 AS has_flag, user_id, value FROM events""")
def tracker_reload(spark, sf):
    """A table that came back as texts, cast again."""
    d, path = t(spark, sf, "events"), new_path(spark, "files")
    D.write_csv(d.select(F.col("event_id").cast("string"), F.when(F.col("user_id") % 2 == 0, "True").otherwise("False").alias("has_flag"), F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("user_id"), F.col("value").cast("string")), path, ["event_id", "has_flag", "user_id", "value"])
    return M.recast(D.csv(spark, path, "event_id string, has_flag string, user_id string, value string"), bools=["has_flag"], ints=["event_id", "user_id"], doubles=["value"])


def offline_service():
    """A stand-in for a service: every third id is unknown."""
    return lambda i: (400, "") if i % 3 == 0 else (200, f'{{"id": {i}}}')


@query("""
SELECT (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey > 50)::BIGINT AS fetched, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 50)::BIGINT AS not_found, 0::BIGINT AS failed, (SELECT count(*) FROM customer WHERE c_custkey <= 50)::BIGINT AS skipped""")
def resumable_crawl(spark, sf):
    """A second crawl over all customers, after one that had got through the first fifty."""
    ids, path = t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), new_path(spark, "files")
    # the first run writes its records as a side effect; one row is read
    D.crawl(ids.where("id <= 50"), offline_service(), path).first()
    return D.crawl(ids, offline_service(), path)


@query("""SELECT id, status, payload FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'not_found' ELSE 'ok' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN '{"id": ' || CAST(c_custkey AS VARCHAR) || '}' END AS payload FROM customer WHERE c_nationkey > 3)""")
def fetch_missing(spark, sf):
    """One request for each customer that is not there yet."""
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return D.fetch_missing(c, c.where("c_nationkey <= 3"), offline_service())


@query("""SELECT n_regionkey AS taxon, min_by(n_name, n_nationkey) FILTER (WHERE n_nationkey % 2 = 0) AS accession FROM nation GROUP BY 1""")
def first_accession(spark, sf):
    """The first report of each key that has an accession."""
    n = t(spark, sf, "nation").select(F.col("n_regionkey").alias("taxon"), F.col("n_nationkey").alias("place"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("accession"))
    return D.first_accession(n)


@query("""SELECT vec_id, label, embedding FROM embeddings""")
def matrix_round_trip(spark, sf):
    """A matrix as a table of float arrays, written and read."""
    path = new_path(spark, "files")
    t(spark, sf, "embeddings").select("vec_id", "label", "embedding").write.parquet(path)
    return spark.read.parquet(path)


@query("""SELECT event_type AS run, count(*) AS n FROM events GROUP BY 1""")
def run_provenance(spark, sf):
    """Rows of each run as a JSON document, and that document as a table."""
    import json

    facts = json.loads(D.provenance(t(spark, sf, "events"), "event_type"))
    return spark.createDataFrame([(x, facts["rows_per_run"][x]) for x in facts["runs"]], "run string, n long")


@query("""
SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 1""")
def add_missing_rows(spark, sf):
    """Rows added for keys that a table lacks, its own kept."""
    o = t(spark, sf, "orders")
    own = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return J.add_missing(own, o.where("o_orderkey % 4 < 2").select("o_orderkey"), ["o_orderkey"])


@query("""
WITH m AS (SELECT o_orderstatus AS section, max(o_totalprice) AS top, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) AS urgent FROM orders GROUP BY 1),
s AS (SELECT section, CASE WHEN top > (SELECT quantile_disc(o_totalprice, 0.999) FROM orders) THEN 'FAIL' WHEN urgent > (SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) FROM orders) THEN 'FLAGGED' ELSE 'PASS' END AS status FROM m)
SELECT section, status FROM s UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'FLAGGED') THEN 'FLAGGED' ELSE 'PASS' END FROM s""")
def report_sections(spark, sf):
    """A report with a section for each order status: too dear an order fails it, more urgent ones than elsewhere flag it, and neither stops the others."""
    o = t(spark, sf, "orders")
    urgent = lambda d: d.agg(F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double"))).first()[0]
    dear = o.agg(F.expr("percentile_disc(0.999) WITHIN GROUP (ORDER BY o_totalprice)")).first()[0]
    usual = urgent(o)

    def section(status):
        own = o.where(F.col("o_orderstatus") == status)

        def run(s):
            C.require(own, F.col("o_totalprice") <= dear, "prices")
            if urgent(own) > usual:
                s.flag("many urgent orders")

        return run

    names = [x[0] for x in o.select("o_orderstatus").distinct().orderBy("o_orderstatus").limit(100).collect()]
    done = C.run_sections({x: section(x) for x in names})
    return spark.createDataFrame([*((s.title, s.status) for s in done), ("overall", C.overall(done))], "section string, status string")
