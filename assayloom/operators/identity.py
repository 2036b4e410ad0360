"""Sequence identity graph: all pairs whose best global alignment is alike enough, without comparing all pairs.

Candidates come from a lemma on grams. Let L be the length of an alignment with
identity t or more, n the longer sequence's length: L >= n, and at most
(1 - t) * L columns differ. Each of the L - q + 1 windows of q columns that holds
no such column is a gram of both sequences, and a column stands in at most q
windows. So the sequences share at least

    L - q + 1 - q * (1 - t) * L  >=  n * (1 - q * (1 - t)) - q + 1

grams, counted with their repeats, if q * (1 - t) <= 1. Two bags with s common
grams share one of each bag's first size - s + 1 in any common order. Grams are
numbered from the rarest on, so these are the rare ones. Of the q that give a
useful bound for a length the greatest is taken; q = 1 always does, so sequences
of any length, and of one letter, are found.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, stored
from .order import numbered
from .similarity import align_identities

#: The longest grams that are tried, and the share of a length that their bound must reach.
MOST_GRAM, USEFUL = 4, 1 / 8
#: Sequences with one gram among their rare ones that are joined by one task.
CELL = 512


def common_grams(n: Column, q: int, threshold: float) -> Column:
    """How many grams of q letters a sequence of n letters shares at least with a shorter one that is alike enough."""
    return F.ceil(n * (1 - q * (1 - threshold)) - q + 1 - 1e-9)


def gram_size(n: Column, threshold: float) -> Column:
    """The gram's length by which sequences of n letters are joined with shorter ones."""
    out = F.lit(1)
    for q in range(2, MOST_GRAM + 1):
        if q * (1 - threshold) <= 1 + 1e-9:
            out = F.when(common_grams(n, q, threshold) >= F.greatest(F.lit(1.0), n * F.lit(USEFUL)), q).otherwise(out)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bag(s: pd.Series, q: pd.Series) -> pd.Series:
    """The grams of each sequence, numbered by repeat, so that common elements count common grams."""

    def grams(text, n):
        seen: Counter = Counter()
        out = []
        for i in range(len(text) - n + 1):
            g = text[i : i + n]
            seen[g] += 1
            out.append(f"{g}{seen[g]}")
        return out

    return pd.Series([grams(a, b) for a, b in zip(s, q)], dtype=object)


def identity_classes(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, first, s): the upper-cased sequence of each row that can be aligned, and the smallest key with that sequence.

    Null and empty sequences and those with a placeholder (X) take no part.
    """
    s = df.select(F.col(key).alias("key"), F.upper(seq).alias("s")).where((F.length("s") > 0) & ~F.contains("s", F.lit("X")) & F.col("key").isNotNull())
    first = s.groupBy("s").agg(F.min("key").alias("first"))
    # one row a sequence on the right; the copies of a very frequent one are split by the adaptive skew join
    return s.join(first.hint("merge"), "s")


def identity_candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(i, j): pairs of the sequences (k, s), the longer one first, among which are all that are alike enough."""
    c = classes.withColumn("n", F.length("s"))
    reach = F.greatest(F.col("n"), F.floor(F.col("n") / threshold + 1e-9).cast("int"))
    # as the longer one a sequence has one gram length, as the shorter one those of all lengths that it can meet
    short = F.array_distinct(F.transform(F.sequence(F.col("n"), reach), lambda m: gram_size(m, threshold)))
    sides = c.select("k", "s", "n", F.explode(F.array_union(F.array(gram_size(F.col("n"), threshold)), short)).alias("q")).where("n >= q")
    least = F.lit(0)
    for q in range(1, MOST_GRAM + 1):
        least = F.when(F.col("q") == q, F.greatest(F.lit(1), common_grams(F.col("n"), q, threshold))).otherwise(least)
    flat = stored(sides.select("k", "n", "q", (F.col("q") == gram_size(F.col("n"), threshold)).alias("long"), least.cast("int").alias("least"), F.explode(_bag("s", "q")).alias("g")), "grams")
    counts = flat.groupBy("q", "g").agg(F.count("*").alias("f"))
    ranks = stored(numbered(counts.where("f > 1"), [F.col("f"), F.col("q"), F.col("g")], "r").select("q", "g", "r", "f"), "grams")
    # a gram of one sequence is in no pair, but has its place before all others
    bags = flat.join(ranks.hint("merge"), ["q", "g"], "left").groupBy("k", "n", "q", "long", "least").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("r")).alias("r"))
    alone = F.col("size") - F.size("r")
    lead = F.greatest(F.lit(0), F.col("size") - F.col("least") + 1 - alone).cast("int")
    prefix = stored(bags.select("k", "n", "q", "long", (F.col("size") - alone).alias("_m"), F.posexplode(F.slice("r", F.lit(1), lead)).alias("p", "r")).withColumn("left", F.col("_m") - F.col("p")).drop("_m", "p"), "grams")
    cells = prefix.groupBy("r").agg(F.ceil(F.count("*") / CELL).cast("int").alias("c")).where("c > 1")
    p = prefix.join(cells.hint("merge"), "r", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    own, every = F.pmod(F.xxhash64("k"), F.col("c")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("c") - 1))
    a = p.where("long").select("r", own.alias("x"), every.alias("y"), F.col("k").alias("i"), F.col("n").alias("n"), "q", F.col("left").alias("_a"))
    b = p.select("r", every.alias("x"), own.alias("y"), F.col("k").alias("j"), F.col("n").alias("m"), F.col("left").alias("_b"))
    need = F.lit(0)
    for q in range(1, MOST_GRAM + 1):
        need = F.when(F.col("q") == q, common_grams(F.col("n"), q, threshold)).otherwise(need)
    later = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("i") > F.col("j")))
    # at the first gram that two bags share, what is left of both must hold all that they share
    fits = later & (F.col("m") >= F.col("n") * F.lit(threshold) - 1e-9) & (F.least("_a", "_b") >= need)
    out = stored(a.join(b.hint("merge"), ["r", "x", "y"]).where(fits).select("i", "j").distinct(), "grams")
    discard(flat, ranks, prefix)
    return out


def identity_links(classes: DataFrame, threshold: float, scores: dict[str, float] | None = None, gap_open: float = 5.0, gap_extend: float = 1.0, match: float = 1.0, mismatch: float = 0.0) -> DataFrame:
    """(i, j, similarity), i < j, of the distinct sequences (k, s) with alignment identity at least threshold; none is lost."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    c = stored(classes.withColumn("b", _bag("s", F.lit(1))), "grams")
    pairs = identity_candidates(c.select("k", "s"), threshold)
    side = lambda k, s, b: c.select(F.col("k").alias(k), F.col("s").alias(s), F.col("b").alias(b))
    j = pairs.join(side("i", "x", "bx").hint("merge"), "i").join(side("j", "y", "by").hint("merge"), "j")
    # equal letters are common letters, whatever the alignment
    j = j.where(F.size(F.array_intersect("bx", "by")) >= F.length("x") * F.lit(threshold) - 1e-9).select("i", "j", "x", "y", F.length("x").alias("n"), F.length("y").alias("m"))
    # pairs of equal lengths are aligned together
    j = j.repartitionByRange("n", "m", "i", "j").sortWithinPartitions("n", "m")

    @F.pandas_udf("double")
    def identity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(align_identities(x.tolist(), y.tolist(), match, mismatch, gap_open, gap_extend, scores), dtype=np.float64)

    return j.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), identity("x", "y").alias("similarity")).where(F.col("similarity") >= threshold)


def identity_graph(df: DataFrame, key: str, seq: str, threshold: float, **how) -> tuple[DataFrame, DataFrame]:
    """(links, classes): (i, j, similarity) between the smallest keys of different sequences, and (key, first) of all rows that were compared.

    Rows with one sequence are a class; a class of any size adds no links. Keys
    may be of any type that can be ordered; a repeated key with several sequences
    stands in several classes.
    """
    table = stored(identity_classes(df, key, seq), "grams")
    links = identity_links(table.select(F.col("first").alias("k"), "s").distinct(), threshold, **how)
    return links, table.select(F.col("key"), "first")
