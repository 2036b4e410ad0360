"""Line dedup, with DataFrame functions only.

Method: lines are split off, normalised and hashed; distinct documents are
counted per hash; lines over the threshold are dropped in all documents but the
last that holds them, and what stays is put together again by position.

Only hashes of lines that are long enough to be dropped are shuffled for the
count, which Spark aggregates before it shuffles. A hash with a thousandth of all
lines or more is looked up by a broadcast of at most a thousand rows, so that no
task gets all lines of one hash; a text's lines are shuffled once, by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash is frequent from this share of all lines on, so that at most so many of them are.
FREQUENT = 1000


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) with text less its dropped lines, n_lines (before) and n_dropped.

    Lines whose key has least_chars code points or more and stands in least_docs
    documents or more go, except in the greatest doc_id that holds the key, where
    all of them stay. Null and empty texts are one empty line, and null texts
    come back empty. Rows that share a doc_id count as one document; rows without
    one count together as one that comes before all others. Repeated rows are
    treated alike. Lines and texts may be of any length; an empty table gives no
    rows. Columns with the new names are replaced, all others stay.
    """
    names = docs.columns
    own = {c: f"_c{i}" for i, c in enumerate(names)}
    d = docs.toDF(*own.values()).withColumn("_lines", F.split(F.coalesce(F.col(own["text"]), F.lit("")), "\n", -1)).drop(own["text"])
    # with the lines and numbers stored, each reader sees the same
    d = materialize(d.withColumn("_row", F.monotonically_increasing_id()))
    lines = d.select("_row", F.col(own["doc_id"]).alias("_doc"), F.posexplode("_lines").alias("_at", "_line")).withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= least_chars)
    # two hashes of 64 bits each
    hashes = [F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), F.reverse("_key")).alias("_g")]
    lines = materialize(lines.select("_row", "_doc", "_at", *hashes))
    found = lines.groupBy("_h", "_g").agg(F.count_distinct("_doc").alias("_n"), F.max(F.col("_doc").isNull().cast("int")).alias("_none"), F.max("_doc").alias("_last"), F.count("*").alias("_all"))
    found = materialize(found.where(F.col("_n") + F.col("_none") >= least_docs).select("_h", "_g", "_last", "_all"))
    most = lines.count() // FREQUENT
    often = found.where(F.col("_all") > most).drop("_all")
    marked = lines.join(F.broadcast(often.withColumn("_often", F.lit(True))), ["_h", "_g"], "left")
    rare = marked.where("_often is null").select("_h", "_g", "_row", "_doc", "_at").join(found.where(F.col("_all") <= most).drop("_all"), ["_h", "_g"])
    gone = marked.where("_often").select("_row", "_doc", "_at", "_last").unionByName(rare.select("_row", "_doc", "_at", "_last")).where(~F.col("_doc").eqNullSafe(F.col("_last")))
    gone = gone.groupBy("_row").agg(F.collect_list("_at").alias("_gone"))
    j = d.join(gone, "_row", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    text = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    new = {"text": text, "n_lines": F.size("_lines").cast("long"), "n_dropped": F.size("_gone").cast("long")}
    return j.select(*[new.get(c, F.col(own[c])).alias(c) for c in names], *[v.alias(c) for c, v in new.items() if c not in names])
