"""Mixing sources to target weights, with DataFrame functions only.

Method: a low-discrepancy source schedule. Slot i of the mix is the golden-ratio
point frac((i + 1) * phi), mapped through the cumulative target shares to a
source. A source's slots are ranked; its documents, shuffled by a hash and laid
end to end, are cut into blocks of equal words, and the slot of rank r takes
block r, starting over when the source is used up. The last block of a source is
cut so that it takes its target exactly; a source whose slots fall short by the
schedule's discrepancy gets them after the end, in order of source and rank.

The schedule is what the operator returns: every row has the slots of the mix
where its words stand, and the mix in order of slots keeps each source's share
of any stretch near its weight.

Ranks and running sums are counted in two steps (inside pieces of bounded size,
then over the pieces' totals), so a source with most rows is never one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

PHI = 0.6180339887498949
GRID = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    Sources in code-point order, null last, take the weights in turn. The sizes'
    total is shared by weight; no target is above limit times its source's size,
    and the excess is reshared by weight. That is water-filling: with sources
    ordered by limit * size / weight the capped ones are a prefix.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * limit)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(rest))
    # with this source and all after it below their caps
    level = F.col("left").cast("double") / F.col("w_left")
    holds = level * F.col("w") <= F.col("cap").cast("double")
    s = s.withColumn("found", F.min(F.when(holds, F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("source").isNull().alias("last"), "source", level.alias("level")))).over(every))
    target = F.least(F.col("found.level") * F.col("w"), F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _running(df: DataFrame, keys: list[str], piece: str, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of value over the rows before, per keys, in order of (piece, order)."""
    inside = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, piece).agg(F.sum(value).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    return df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, [*keys, piece]).withColumn(out, (F.col(out) + F.col("_before")).cast("long")).drop("_before")


def schedule(spark: SparkSession, goals: DataFrame, total: int, block: int, piece_rows: int) -> DataFrame:
    """(s, r, slot, take): the slot of each source's block of rank r, and how many words it takes.

    goals: (s, goal) with sources numbered from 1, whose goals add up to total.
    Points find their source by ranges: both are cut at every 1 / GRID, so each
    point meets the few sources of its range instead of all of them.
    """
    slots = -(-total // block)
    over = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    share = goals.where("goal > 0").withColumn("_c", F.sum("goal").over(over)).select("s", (F.col("_c") / F.lit(max(total, 1))).alias("hi"), ((F.col("_c") - F.col("goal")) / F.lit(max(total, 1))).alias("lo"))
    ranges = share.withColumn("g", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.floor(F.col("hi") * GRID))))
    point = (F.col("id") + 1) * F.lit(PHI)
    points = spark.range(slots).withColumn("p", point - F.floor(point)).withColumn("g", F.floor(F.col("p") * GRID))
    placed = points.join(ranges, "g").where("lo <= p and p < hi").select("id", "s").withColumn("piece", F.floor(F.col("id") / piece_rows)).withColumn("one", F.lit(1))
    ranked = _running(placed, ["s"], "piece", ["id"], "one", "r")
    need = goals.withColumn("need", F.ceil(F.col("goal") / block))
    # the schedule's discrepancy is a few slots a source
    late = need.join(placed.groupBy("s").count(), "s", "left").withColumn("have", F.coalesce("count", F.lit(0))).where("have < need")
    late = late.withColumn("before", F.coalesce(F.sum(F.col("need") - F.col("have")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    late = late.select("s", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("r"), (F.lit(slots) + F.col("before") - F.col("have")).alias("_base")).select("s", "r", (F.col("_base") + F.col("r")).alias("slot"))
    got = ranked.select("s", "r", F.col("id").alias("slot")).union(late).join(need, "s").where("r < need")
    return got.select("s", "r", "slot", F.least(F.lit(block), F.col("goal") - F.col("r") * block).alias("take"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, block: int = 512, seed: int = 0, piece_rows: int = 1 << 12, keep: list[str] | None = None, slots: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, *keep) of each row of docs (doc_id, text, source).

    size: words of the text (null: 0); taken: words the mix takes of the row,
    repeats counted, at most limit * size. A row is taken taken // size times
    whole and then its first taken % size words. first_slot: the place in the
    mix where the row is taken first, null if nothing is; with slots, the
    column slots has the place of each time. Null doc_ids, a null source and
    repeated rows are as any others; texts of any length are cut at blocks.
    Empty table: no rows. Reruns agree; rows of one source that agree in doc_id
    and size may swap shares. keep: further columns, with names of their own.
    """
    spark = docs.sparkSession
    own = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep or [])]
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *own).withColumn("_key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    d = materialize(d)
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    targets = materialize(targets.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")).withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    total, rows = targets.agg(F.sum("goal")).first()[0] or 0, d.count()
    piece_rows = max(piece_rows, math.isqrt(rows))  # as many pieces as rows a piece, where there are many
    names = targets.select("s", "source", "source_size", "target", "goal")
    d = d.join(names, d.source.eqNullSafe(names.source)).drop(names.source)
    slot = materialize(schedule(spark, targets.select("s", "goal"), total, block, piece_rows))

    # the documents' places in their sources' streams: pieces are ranges of the key, whose hash spreads a source's rows evenly
    pieces = max(1, -(-rows // piece_rows))
    d = d.withColumn("piece", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.lit(pieces) / F.lit(1 << 32)))
    d = materialize(_running(d, ["s"], "piece", ["_key", "doc_id", "size"], "size", "at").withColumn("_row", F.monotonically_increasing_id()))
    part = (
        d.where("size > 0 and goal > at").select("_row", "s", "size", "at", "source_size", "goal")
        .withColumn("pass", F.explode(F.expr("sequence(0, cast(floor((goal - at - 1) / source_size) as int))")))
        .withColumn("a", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("b", F.col("a") + F.col("size"))
        .withColumn("r", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")))
    )
    n = F.greatest(F.lit(0), F.least("b", F.col("r") * block + F.col("take")) - F.greatest("a", F.col("r") * block))
    words = part.join(slot, ["s", "r"]).select("_row", "r", "slot", "pass", n.alias("n")).where("n > 0")
    # a pass of a document starts in the slot of its first block
    taken = words.groupBy("_row", "pass").agg(F.sum("n").alias("n"), F.min_by("slot", "r").alias("slot")).groupBy("_row").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.array_sort(F.collect_list("slot")).alias("slots"))
    extra = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep or [])]
    return d.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", *(["slots"] if slots else []), *extra)
