"""Residue codes of annotated positions, resolved against a code table without guessing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import residue_code

# Codes that are written otherwise in the code table.
SYNONYMS = {"ABU": "ABA", "CHA": "ALC", "CIT": "CIR", "HARG": "HRG", "PHG": "PG", "1-NAL": "ALN", "MET(O)": "SME", "NVAL": "NVA"}


def resolve_codes(codes: DataFrame, table: DataFrame, column: str = "code") -> DataFrame:
    """codes with base, is_d, letter and reason: the table's letter of the code or its synonym; unknown and ambiguous ones have none.

    table: (code, letter), one row an entry; a code with several entries is
    ambiguous. An exact code goes before a synonym.
    """
    r = residue_code(F.col(column))
    per = table.groupBy(F.upper("code").alias("_code")).agg(F.count("*").alias("_n"), F.min("letter").alias("_letter"))
    other = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    c = codes.withColumn("base", r["code"]).withColumn("is_d", r["is_d"]).withColumn("_syn", F.try_element_at(other, F.col("base")))
    c = c.join(per.select(F.col("_code").alias("base"), F.col("_n").alias("_n1"), F.col("_letter").alias("_l1")), "base", "left")
    c = c.join(per.select(F.col("_code").alias("_syn"), F.col("_n").alias("_n2"), F.col("_letter").alias("_l2")), "_syn", "left")
    n, letter = F.coalesce("_n1", "_n2"), F.coalesce("_l1", "_l2")
    reason = F.when(n.isNull(), F.concat(F.lit("unknown code "), F.col("base"))).when(n > 1, F.concat(F.lit("ambiguous code "), F.col("base"))).otherwise("")
    return c.withColumn("letter", F.when(n == 1, letter)).withColumn("reason", reason).select(*codes.columns, "base", "is_d", "letter", "reason")


def resolve_letters(peptides: DataFrame, table: DataFrame, alphabet: str) -> DataFrame:
    """(id, letters, reasons): each position's letter, or why there is none, for (id, sequence, noted array<struct<pos, name>>).

    Annotated positions take their code's letter, lower-case for D forms, which
    the alphabet must have; all others must be in the alphabet as they are. All
    reasons are given, in order of position; letters is null if there is any.
    """
    chars = F.transform(F.filter(F.split("sequence", ""), lambda c: c != ""), lambda c, i: F.struct((i + 1).alias("pos"), c.alias("ch")))
    noted = F.map_from_entries(F.transform(F.array_distinct(F.transform("noted", lambda u: u["pos"])), lambda p: F.struct(p, F.element_at(F.filter("noted", lambda u: u["pos"] == p), -1)["name"])))
    p = peptides.select("id", noted.alias("m"), F.explode(chars).alias("c")).select("id", "c.pos", "c.ch", F.try_element_at("m", F.col("c.pos")).alias("code"))
    known = resolve_codes(p.select("code").where("code is not null").distinct(), table)
    j = p.join(known, "code", "left")
    inside = lambda c: F.lit(alphabet).contains(c)
    form = F.when(F.col("is_d"), F.lower("letter")).otherwise(F.col("letter"))
    why = (
        F.when(F.col("code").isNull(), F.when(~inside(F.col("ch")), F.concat(F.lit("unresolved residue "), F.col("ch"))))
        .when(F.col("reason") != "", F.col("reason")).when(F.col("is_d") & ~inside(F.lower("letter")), F.concat(F.lit("no D form of "), F.col("base")))
    )
    one = F.struct("pos", F.when(F.col("code").isNull(), F.col("ch")).otherwise(form).alias("letter"), F.concat(F.lit("position "), F.col("pos").cast("string"), F.lit(": "), why).alias("why"))
    g = j.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    reasons = F.filter(F.transform("p", lambda x: x["why"]), lambda w: w.isNotNull())
    out = g.select("id", F.when(F.size(reasons) == 0, F.array_join(F.transform("p", lambda x: x["letter"]), "")).alias("letters"), reasons.alias("reasons"))
    # an empty sequence has no positions and no faults
    return peptides.select("id").join(out, "id", "left").select("id", F.when(F.col("reasons").isNull(), "").otherwise(F.col("letters")).alias("letters"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
