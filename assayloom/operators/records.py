"""Raw records as nested tables: flattening, explosion, the baseline comparison and structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.measurements import first_failure

_NAMED = "struct<name: string>"
#: What a raw record holds; a reader's schema.
RECORD = f"""id long, sequence string, complexity {_NAMED}, synthesisType {_NAMED}, nTerminus {_NAMED}, cTerminus {_NAMED}, targetGroups array<{_NAMED}>, targetObjects array<{_NAMED}>,
 unusualAminoAcids array<struct<position: int, modificationType: {_NAMED}>>, intrachainBonds array<struct<type: {_NAMED}, cycleType: {_NAMED}, chainParticipating: {_NAMED}, position1: int, position2: int>>,
 smiles array<struct<smiles: string>>, targetActivities array<struct<activityMeasureGroup: {_NAMED}, targetSpecies: {_NAMED}, unit: {_NAMED}, concentration: string>>"""


def _array(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("array()"))


def annotations(unusual: Column) -> Column:
    """array<struct<pos, name>> of complete annotations: both position and name known."""
    pairs = F.transform(unusual, lambda u: F.struct(u["position"].alias("pos"), u["modificationType"]["name"].alias("name")))
    return F.coalesce(F.filter(pairs, lambda p: p["pos"].isNotNull() & p["name"].isNotNull()), F.array().cast("array<struct<pos:int,name:string>>"))


def names_of(items: Column, field: str) -> Column:
    """Sorted distinct names under a field of structs; null ones are left out."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda b: b[field]["name"]), lambda n: n.isNotNull()))), F.array().cast("array<string>"))


def native_structures(smiles: Column) -> Column:
    """Non-empty structure texts, in order."""
    return F.coalesce(F.filter(F.transform(smiles, lambda s: s["smiles"]), lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))


def flatten(records: DataFrame) -> DataFrame:
    """One wide row a record; names under null structs are null, lists are joined by |."""
    noted, seq = annotations(F.col("unusualAminoAcids")), F.coalesce("sequence", F.lit(""))
    joined = lambda a: F.array_join(a, "|")
    groups = lambda c: joined(F.coalesce(F.transform(c, lambda g: g["name"]), F.array().cast("array<string>")))
    native = native_structures(F.col("smiles"))
    return records.select(
        F.col("id").alias("peptide_id"), "sequence", F.length("sequence").alias("sequence_length"), F.col("nTerminus.name").alias("nterminus"), F.col("cTerminus.name").alias("cterminus"),
        F.col("synthesisType.name").alias("synthesis_type"), F.col("complexity.name").alias("complexity"), groups("targetGroups").alias("target_groups"), groups("targetObjects").alias("target_objects"),
        F.size(noted).alias("n_unusual_aa"), joined(F.transform(noted, lambda p: F.concat_ws(":", p["pos"].cast("string"), p["name"]))).alias("unusual_aa_detail"),
        S.noncanonical(seq, noted).alias("has_noncanonical"), S.d_residue(seq, F.transform(noted, lambda p: p["name"])).alias("has_d_residue"),
        F.coalesce(F.size("intrachainBonds"), F.lit(0)).alias("n_intrachain_bonds"), joined(names_of(F.col("intrachainBonds"), "type")).alias("bond_types"), joined(names_of(F.col("intrachainBonds"), "cycleType")).alias("bond_cycletypes"),
        (F.size(native) > 0).alias("has_native_smiles"), F.size(native).alias("n_native_smiles"), joined(native).alias("smiles_native"), F.coalesce(F.size("targetActivities"), F.lit(0)).alias("n_target_activities"),
    )


def activities(records: DataFrame) -> DataFrame:
    """(id, measure, species, unit, concentration): one row an activity; records without any have none."""
    a = F.col("a")
    return records.select("id", F.explode("targetActivities").alias("a")).select("id", a["activityMeasureGroup"]["name"].alias("measure"), a["targetSpecies"]["name"].alias("species"), a["unit"]["name"].alias("unit"), a["concentration"].alias("concentration"))


def targets(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep, organism, mic_min_uM, mic_max_uM, mic_value_uM) of a map from organisms to (least, greatest, mean)."""
    return df.select(*keep, F.explode(column).alias("organism", "v")).select(*keep, "organism", F.col("v")[0].alias("mic_min_uM"), F.col("v")[1].alias("mic_max_uM"), F.col("v")[2].alias("mic_value_uM"))


def exclusion(measure: Column, domain: Column, unit: Column, wanted: str = "MIC", units: tuple[str, ...] = ("µM", "µg/ml")) -> Column:
    """Why an activity is not used: its measure, its species' domain or its unit, in that order; null if it is."""
    because = lambda kind, c: F.concat_ws(":", F.lit(kind), F.coalesce(c, F.lit("none")))
    return F.when(~measure.eqNullSafe(wanted), because("measure", measure)).when(~domain.eqNullSafe("Bacteria"), because("domain", domain)).when(~F.coalesce(unit.isin(*units), F.lit(False)), because("unit", unit))


#: Buckets of the comparison with the baseline, by the reason why a record is not in it.
_BUCKETS = {
    "non_monomer_complexity": "b1_excluded_non_monomer",
    "unsupported_nterminus": "b2_excluded_unsupported_terminus",
    "unsupported_cterminus": "b2_excluded_unsupported_terminus",
    "unresolved_residue_no_native_smiles": "b3_excluded_residue_no_smiles",
    "nonstandard_bond_type": "b4_excluded_nonstandard_bond",
}


def baseline_buckets(flat: DataFrame, baseline: DataFrame, fails: Column, key: str = "peptide_id") -> DataFrame:
    """(key, bucket, reason) of all keys of both tables: in_both, b1 to b5 by fails for records that the baseline lacks, c for the others."""
    left = flat.withColumn("_fails", fails).withColumn("_l", F.lit(True))
    j = left.join(baseline.select(key).distinct().withColumn("_r", F.lit(True)), key, "full_outer")
    table = F.create_map(*[F.lit(x) for kv in _BUCKETS.items() for x in kv])
    shown = lambda name, c: F.concat(F.lit(name + "="), F.coalesce(c, F.lit("none")))
    detail = (
        F.when(F.col("_fails") == "non_monomer_complexity", shown("complexity", F.col("complexity"))).when(F.col("_fails") == "unsupported_nterminus", shown("nterminus", F.col("nterminus")))
        .when(F.col("_fails") == "unsupported_cterminus", shown("cterminus", F.col("cterminus"))).when(F.col("_fails") == "unresolved_residue_no_native_smiles", shown("codes", F.col("unusual_aa_detail")))
        .when(F.col("_fails") == "nonstandard_bond_type", shown("bonds", F.col("bond_types"))).otherwise("not explained")
    )
    bucket = F.when(F.col("_l").isNull(), "c_only_in_baseline").when(F.col("_r"), "in_both").otherwise(F.coalesce(F.try_element_at(table, F.col("_fails")), F.lit("b5_excluded_unexplained")))
    return j.select(key, bucket.alias("bucket"), F.when(F.col("_l").isNull() | F.col("_r"), "").otherwise(detail).alias("reason"))


def resolved_structure(native: Column, generated: Column, constraint: Column, refusal: Column) -> Column:
    """struct<smiles, source, reason>: the first native structure, else the generated one, else none with the refusal."""
    first = F.try_element_at(native, F.lit(1))
    smiles = F.coalesce(first, generated)
    source = F.when(first.isNotNull(), "native").when(generated.isNotNull(), F.concat(F.lit("generated("), F.coalesce(constraint, F.lit("linear")), F.lit(")")))
    return F.struct(smiles.alias("smiles"), source.alias("source"), F.when(smiles.isNull(), refusal).otherwise("").alias("reason"))


def refusal(sequence_reasons: Column, n_terminus: Column, c_terminus: Column, n_bonds: Column, bond: Column, bond_ends_fit: Column) -> Column:
    """First reason why no structure can be generated, null if one can: termini, residues, number of bonds, the bond's class, its place."""
    made = F.coalesce(bond["convertible"] & bond["constraint"].isin("SS", "HT"), F.lit(False))
    return first_failure(
        (n_terminus.isNotNull() & (n_terminus != "ACT"), "unsupported n-terminus"),
        (c_terminus.isNotNull() & (c_terminus != "AMD"), "unsupported c-terminus"),
        (F.size(sequence_reasons) > 0, "unresolved residues"),
        (n_bonds > 1, "several bonds"),
        ((n_bonds == 1) & ~made, "bond not generated"),
        ((n_bonds == 1) & (bond["constraint"] == "HT") & ((n_terminus == "ACT") | (c_terminus == "AMD")), "ring bond beside a changed terminus"),
        ((n_bonds == 1) & (bond["constraint"] == "SS") & ~bond_ends_fit, "bond ends cannot form it"),
    )


def entity_counts(flat: DataFrame, lists: dict[str, Column]) -> DataFrame:
    """(entity, value, n): how often each value stands in arrays of values, by entity name, in one pass."""
    named = lambda name: lambda v: F.struct(F.lit(name).alias("entity"), v.cast("string").alias("value"))
    pairs = F.concat(*[F.transform(c, named(name)) for name, c in lists.items()])
    return flat.select(F.explode(pairs).alias("p")).select("p.*").groupBy("entity", "value").agg(F.count("*").alias("n"))


def final_rows(df: DataFrame, baseline: DataFrame, key: str = "peptide_id") -> DataFrame:
    """df with source (baseline or recovered) and linear, told from bond_type, where none or null means linear."""
    j = df.join(baseline.select(key).distinct().withColumn("_b", F.lit(True)), key, "left")
    return j.withColumn("source", F.when(F.col("_b"), "baseline").otherwise("recovered")).withColumn("linear", F.coalesce("bond_type", F.lit("none")) == "none").drop("_b")


def activity_index(records: DataFrame, ids: DataFrame, species: DataFrame) -> DataFrame:
    """activities() of the wanted ids (id), with the domain, taxon and binomial of their species (species, domain, taxon, binomial)."""
    return activities(records.join(ids.select("id").distinct(), "id", "left_semi")).join(species, "species", "left")


def wanted_activities(rows: DataFrame, ids: DataFrame, pairs: DataFrame, key: str, name: str) -> DataFrame:
    """rows whose key is in ids (key) and whose key and name are together in pairs (key, name); repeated ids and pairs add no rows."""
    return rows.join(ids.select(key).distinct(), key, "left_semi").join(pairs.select(key, name).distinct(), [key, name], "left_semi").select(*rows.columns)
