"""Classification metrics by group, and summaries of cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of the score into which a group is cut.
RANGES = 65536


def binary_metrics(df: DataFrame, keys: list[str], score: str, truth: str, threshold: float = 0.5) -> DataFrame:
    """(keys, n, accuracy, precision, recall, f1, auroc, status) from scores and 0/1 labels.

    Undefined precision, recall and f1 are 0. auroc is the rank statistic with
    ties halved, null (status single_class) if a group has one class only. It is
    computed from counts per distinct score: these are summed within ranges of the
    score and over the ranges, so a group of any size is many tasks.
    """
    y = F.col(truth).cast("long")
    s = df.select(*keys, F.col(score).cast("double").alias("_s"), y.alias("_y")).groupBy(*keys, "_s").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    # ranges in the order of the score: any growing function of it does
    s = s.withColumn("_b", F.floor(F.lit(RANGES) / (1 + F.exp(-F.col("_s"))))).withColumn("_neg", F.col("_n") - F.col("_p"))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    lower = s.groupBy(*keys, "_b").agg(F.sum("_neg").alias("_t")).withColumn("_under", F.coalesce(F.sum("_t").over(before(keys, "_b")), F.lit(0))).drop("_t")
    same = F.col("s._b").eqNullSafe(F.col("l._b"))
    for k in keys:
        same &= F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}"))
    s = s.withColumn("_in", F.coalesce(F.sum("_neg").over(before([*keys, "_b"], "_s")), F.lit(0))).alias("s").join(lower.alias("l"), same).select("s.*", (F.col("_in") + F.col("_under")).alias("_lo"))
    hit = F.col("_s") >= threshold
    g = s.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_p").alias("_pos"),
        F.sum(F.when(hit, F.col("_p")).otherwise(0)).alias("_tp"), F.sum(F.when(hit, F.col("_n") - F.col("_p")).otherwise(0)).alias("_fp"),
        F.sum(F.col("_p") * (F.col("_lo") * 2 + F.col("_n") - F.col("_p"))).alias("_u2"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, pos, n = (F.col(c) for c in ("_tp", "_fp", "_pos", "n"))
    one = (pos == 0) | (pos == n)
    return g.select(
        *keys, "n", ((tp + (n - pos - fp)) / n).alias("accuracy"), zero(tp, tp + fp).alias("precision"), zero(tp, pos).alias("recall"),
        zero(2 * tp, tp + fp + pos).alias("f1"), F.when(~one, F.col("_u2") / (2 * pos * (n - pos))).alias("auroc"), F.when(one, "single_class").otherwise("ok").alias("status"),
    )


def slice_recall(df: DataFrame, keys: list[str], score: str, truth: str, slice_: str, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """(keys, recall_in, recall_out, delta, n_in, n_out) of positives inside and outside a boolean slice.

    Where a side has none its recall is null, or raises when it is read if strict.
    """
    pos = df.where(F.col(truth) == 1)
    side = lambda c: F.avg(F.when(c, (F.col(score) >= threshold).cast("int")))
    inside = F.col(slice_)
    g = pos.groupBy(*keys).agg(side(inside).alias("recall_in"), side(~inside).alias("recall_out"), F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))
    if strict:
        none = F.raise_error(F.lit("no positives on one side of the slice")).cast("double")
        g = g.withColumns({f"recall_{s}": F.when(F.col(f"n_{s}") == 0, none).otherwise(F.col(f"recall_{s}")) for s in ("in", "out")})
    return g.select(*keys, "recall_in", "recall_out", (F.col("recall_in") - F.col("recall_out")).alias("delta"), "n_in", "n_out")


def confidence_histogram(df: DataFrame, probability: str, correct: str, bins: int = 15) -> DataFrame:
    """(bin, n, n_correct) of equal bins over [0, 1]; 1 is in the last one."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("n_correct"))


def paired_delta(df: DataFrame, run: str, a: str, b: str, pair: str, metric: str) -> DataFrame:
    """One row of two runs' paired metric: pairs, mean difference and pairs that the first wins."""
    x = df.where(F.col(run) == a).select(pair, F.col(metric).alias("_a"))
    y = df.where(F.col(run) == b).select(pair, F.col(metric).alias("_b"))
    d = F.col("_a") - F.col("_b")
    return x.join(y, pair).agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("won"))


def class_weight(df: DataFrame, truth: str, mode: str = "auto", fixed: float | None = None) -> float | None:
    """Weight of positives: negatives by positives, a fixed number, or none."""
    if mode == "none":
        return None
    if mode == "fixed":
        if fixed is None:
            raise ValueError("a fixed weight is needed")
        return fixed
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    r = df.agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n")).first()
    if not r["p"] or not r["n"]:
        raise ValueError("both classes are needed")
    return r["n"] / r["p"]
