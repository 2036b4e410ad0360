"""Species as a dimension, thresholds by species or genus, and recovered bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import binomial, genus
from .checks import CheckError
from .joins import by_level

# Lineage names in order of priority, and the domains that they stand for.
DOMAINS = [("Bacteria", "Bacteria"), ("Archaea", "Archaea"), ("Viruses", "Virus"), ("Fungi", "Fungus"), ("Metazoa", "Animal"), ("Viridiplantae", "Plant")]


def lineage_names(parents: DataFrame, max_depth: int = 64) -> DataFrame:
    """(taxon, names): the names of each taxon and all above it, from (taxon, parent, name); a root's parent is null or itself.

    Doubles the distance it has gone in each round, so a chain of d needs log d joins.
    """
    up = parents.select("taxon", F.when(F.col("parent") == F.col("taxon"), None).otherwise(F.col("parent")).alias("top"), F.array("name").alias("names"))
    steps = 1
    while steps < max_depth:
        above = up.select(F.col("taxon").alias("_t"), F.col("top").alias("_top"), F.col("names").alias("_names"))
        up = up.join(above, up.top == above._t, "left").select("taxon", F.col("_top").alias("top"), F.concat("names", F.coalesce("_names", F.array().cast("array<string>"))).alias("names"))
        steps *= 2
    return up.select("taxon", F.array_distinct("names").alias("names"))


def domain_of(names: Column) -> Column:
    """The first of DOMAINS among the lineage's names, else Other; Unknown without a lineage."""
    out = F.when(names.isNull(), "Unknown")
    for name, domain in DOMAINS:
        out = out.when(F.array_contains(names, name), domain)
    return out.otherwise("Other")


def species_dimension(species: DataFrame, lineages: DataFrame, names: DataFrame) -> DataFrame:
    """(species, domain, taxon, binomial) of the distinct values of a column species.

    names: (name, taxon). The genus tells the domain; the taxon is that of the
    binomial if it has one, else the genus'.
    """
    s = species.select("species").distinct().withColumn("binomial", binomial(F.col("species"))).withColumn("_g", F.substring_index("binomial", " ", 1))
    g = names.join(lineages, "taxon").select(F.col("name").alias("_g"), F.col("taxon").alias("_gt"), "names")
    b = names.select(F.col("name").alias("binomial"), F.col("taxon").alias("_bt"))
    j = s.join(g, "_g", "left").join(b, "binomial", "left")
    return j.select("species", domain_of(F.col("names")).alias("domain"), F.coalesce("_bt", "_gt").alias("taxon"), "binomial")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


_ACTIVE, _INACTIVE = "active_threshold_uM", "inactive_threshold_uM"
_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def threshold_faults(table: DataFrame) -> DataFrame:
    """table (level, match_key and two breakpoints as text) with fault: the first thing that is wrong with a row, null if nothing is.

    duplicate, unknown_level, partial_fill, not_a_number or reversed. Rows with
    neither breakpoint are fine: nobody has filled them yet.
    """
    a, i = F.col(_ACTIVE), F.col(_INACTIVE)
    number = lambda c: F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
    level, key = F.trim("level"), F.trim("match_key")
    repeated = table.groupBy(level.alias("_l"), key.alias("_k")).agg((F.count("*") > 1).alias("_twice"))
    j = table.withColumns({"_l": level, "_k": key}).join(repeated, ["_l", "_k"])
    fault = (
        F.when(F.col("_twice"), "duplicate").when(~F.coalesce(F.col("_l").isin("species", "genus"), F.lit(False)), "unknown_level").when(_blank(a) != _blank(i), "partial_fill")
        .when(~_blank(a) & (number(a).isNull() | number(i).isNull()), "not_a_number").when(number(a) > number(i), "reversed")
    )
    return j.withColumn("fault", fault).drop("_l", "_k", "_twice")


def load_thresholds(table: DataFrame) -> DataFrame:
    """(match_key, level, active, inactive) of the filled rows; a table with any fault raises with their numbers."""
    checked = threshold_faults(table)
    faults = checked.where("fault is not null").groupBy("fault").count().orderBy("fault").collect()
    if faults:
        raise CheckError("threshold table: " + ", ".join(f"{r['fault']} {r['count']}" for r in faults))
    filled = checked.where(~_blank(F.col(_ACTIVE)))
    return filled.select(F.trim("match_key").alias("match_key"), F.trim("level").alias("level"), F.trim(_ACTIVE).cast("double").alias("active"), F.trim(_INACTIVE).cast("double").alias("inactive"))


def with_thresholds(df: DataFrame, thresholds: DataFrame, organism: str = "organism") -> DataFrame:
    """df with active, inactive and matched (species, genus or none) by the organism's name, else its first word."""
    return by_level(df, thresholds, F.trim(F.col(organism)), genus(F.col(organism)), ["active", "inactive"])


def thresholds_in_use(thresholds: DataFrame, df: DataFrame, organism: str = "organism") -> DataFrame:
    """The rows of thresholds that some organism of df matches by name or first word."""
    o = df.select(F.trim(F.col(organism)).alias("o")).distinct()
    used = o.select(F.col("o").alias("match_key"), F.lit("species").alias("level")).union(o.select(F.substring_index("o", " ", 1), F.lit("genus"))).distinct()
    return thresholds.join(used, ["match_key", "level"], "left_semi")


def label_mismatches(labels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row: labels, and how many differ in match level or label from what the thresholds say.

    labels: (organism, mic_type, value, low, high, matched, label). Written apart
    from the labelling itself: plain comparisons, unlabeled without thresholds.
    """
    t = with_thresholds(labels.drop("matched").withColumn("_was", F.lit(None)), thresholds) if "matched" not in labels.columns else with_thresholds(labels.withColumnRenamed("matched", "_was"), thresholds)
    low = F.when(F.col("mic_type") == "censored", F.coalesce("low", F.lit(0.0))).otherwise(F.col("value"))
    high = F.when(F.col("mic_type") == "censored", F.coalesce("high", F.lit(float("inf")))).otherwise(F.col("value"))
    want = F.when(F.col("active").isNull(), "unlabeled").when(high <= F.col("active"), "active").when(low >= F.col("inactive"), "inactive").otherwise("uncertain")
    return t.agg(F.count("*").alias("n"), F.count_if(~F.col("_was").eqNullSafe(F.col("matched"))).alias("level_mismatches"), F.count_if(~want.eqNullSafe(F.col("label"))).alias("label_mismatches"))


def template(rows: DataFrame, organism: str = "organism", taxon: str = "taxon") -> DataFrame:
    """(level, match_key, taxon, n): rows by species and by genus, most frequent first, with each one's smallest taxon."""
    o = F.trim(F.col(organism))
    both = F.array(F.struct(F.lit("species").alias("level"), o.alias("match_key")), F.struct(F.lit("genus").alias("level"), F.substring_index(o, " ", 1).alias("match_key")))
    t = rows.select(F.explode(both).alias("k"), F.col(taxon).alias("taxon")).groupBy("k.level", "k.match_key").agg(F.min("taxon").alias("taxon"), F.count("*").alias("n"))
    return t.orderBy(F.col("n").desc(), "level", "match_key")


def unfilled(rows: DataFrame, thresholds: DataFrame, k: int = 20, organism: str = "organism") -> DataFrame:
    """The k most frequent organisms without thresholds of their own: a list of what to fill next."""
    have = thresholds.where("level = 'species'").select(F.col("match_key").alias("_o"))
    c = rows.groupBy(F.trim(F.col(organism)).alias(organism)).agg(F.count("*").alias("n"))
    return c.join(have, c[organism] == have._o, "left_anti").orderBy(F.col("n").desc(), organism).limit(k)


def recovered_bounds(wanted: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, censor_type, low, high) of every wanted key: the only open or ranged measurement's, else [0, inf).

    measured: (keys, censor, low, high). Exact measurements do not count; status
    is recovered, zero_matches or multi_matches.
    """
    m = measured.where("censor <> 'exact'").join(wanted.select(*keys).distinct(), keys, "left_semi")
    per = m.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct("censor", "low", "high")).alias("_m"))
    j = wanted.select(*keys).distinct().join(per, keys, "left")
    one = F.col("_n").eqNullSafe(1)
    status = F.when(one, "recovered").when(F.col("_n").isNull(), "zero_matches").otherwise("multi_matches")
    return j.select(*keys, status.alias("status"), F.when(one, F.col("_m.censor")).otherwise("").alias("censor_type"), F.when(one, F.col("_m.low")).otherwise(F.lit(0.0)).alias("low"), F.when(one, F.col("_m.high")).otherwise(F.lit(float("inf"))).alias("high"))
