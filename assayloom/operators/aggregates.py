"""Grouped summaries: robust means, funnels, conflict-free distincts, extremes and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def robust_mean(df: DataFrame, keys: list[str], low: str = "low", high: str = "high", fence: float = 1.5, least: int = 4, digits: int | None = None, first: list[str] = ()) -> DataFrame:
    """(keys, mean, n_points, n_used, n_rows, kind, first) of bound pairs.

    Each lower bound that isn't 0 and each upper one that isn't infinite is a
    point, so an exact value weighs two. With at least `least` points those
    outside the quartiles by more than fence times their distance are left out.
    Groups without points are dropped. digits: significant digits of the mean, 3
    or 5; kind: averaged for several rows, else exact or censored; first: columns
    whose smallest value is kept. The input is read once: rows are folded to the
    distinct values of a group with their counts, and quartiles join those.
    """
    from ..functions.measurements import censoring, measurement_kind, significant

    points = lambda c, bad: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != bad), F.col(c).cast("double"))
    values = F.filter(F.array(points(low, 0.0), points(high, INF)), lambda x: x.isNotNull())
    # a row's first point stands for the row
    each = F.posexplode_outer(values)
    p = df.select(*keys, *first, (censoring(F.col(low), F.col(high)) == "exact").alias("_e"), each.alias("_i", "_x"))
    whole = F.coalesce(F.col("_i"), F.lit(0)) == 0
    c = p.groupBy(*keys, "_x").agg(F.count("_x").alias("_c"), F.count_if(whole).alias("_r"), F.count_if(whole & F.col("_e")).alias("_e"), *[F.min(x).alias(x) for x in first])
    g = c.groupBy(*keys).agg(F.percentile("_x", F.array(F.lit(0.25), F.lit(0.75)), F.greatest(F.col("_c"), F.lit(1))).alias("_q"), F.sum("_c").alias("n_points"), F.sum("_r").alias("n_rows"), F.sum("_e").alias("_exact"), *[F.min(x).alias(x) for x in first])
    same = None
    for k in keys:
        e = F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}"))
        same = e if same is None else same & e
    j = c.where("_x is not null").select(*keys, "_x", "_c").alias("c").join(g.alias("g"), same).select(*[F.col(f"g.{k}").alias(k) for k in keys], "_x", "_c", "_q", "n_points", "n_rows", "_exact", *[F.col(f"g.{x}").alias(x) for x in first])
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    used = j.where((F.col("n_points") < least) | F.col("_x").between(lo - fence * (hi - lo), hi + fence * (hi - lo)))
    out = used.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("mean"), F.max("n_points").alias("n_points"), F.sum("_c").alias("n_used"), F.max("n_rows").alias("n_rows"), F.max("_exact").alias("_exact"), *[F.min(x).alias(x) for x in first])
    kind = F.when(F.col("n_rows") >= 2, "averaged").when(F.col("_exact") > 0, "exact").otherwise("censored")
    mean = significant(F.col("mean"), digits) if digits else F.col("mean")
    return out.select(*keys, mean.alias("mean"), "n_points", "n_used", "n_rows", kind.alias("kind"), *first)


def funnel(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, n) where reason is null for kept rows, shown as kept."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def distinct_or_conflict(df: DataFrame, key: str, same: list[str], measures: dict[str, Column]) -> DataFrame:
    """One row a key with measures and the columns that must agree; conflict says whether one of them doesn't."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in same], *[m.alias(n) for n, m in measures.items()], F.coalesce(F.greatest(*[F.min(c) < F.max(c) for c in same], F.lit(False)), F.lit(False)).alias("conflict"))


def scaler(df: DataFrame, vector: str) -> DataFrame:
    """(i, mean, scale) by position: population deviation, 1 where it is 0."""
    v = df.select(F.posexplode(vector).alias("i", "x"))
    s = F.stddev_pop(F.col("x").cast("double"))
    return v.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.when(s == 0, 1.0).otherwise(s).alias("scale"))


def scaler_arrays(table: DataFrame) -> DataFrame:
    """scaler()'s rows as one row of arrays mean and scale."""
    return table.agg(F.array_sort(F.collect_list(F.struct("i", "mean", "scale"))).alias("a")).select(F.col("a.mean").alias("mean"), F.col("a.scale").alias("scale"))


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, share): the most frequent value, the smallest on ties."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = c.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_n").desc(), value))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    return ranked.where("_r = 1").select(*keys, value, F.col("_n").alias("n"), (F.col("_n") / F.col("_all")).alias("share"))


def best_at(df: DataFrame, keys: list[str], at: str, value: str, largest: bool = True) -> DataFrame:
    """(keys, best_at, best, last): where value is greatest (or least), the first such place on ties, and the value at the last place."""
    v = F.col(value) if largest else -F.col(value)
    return df.groupBy(*keys).agg(F.max_by(at, F.struct(v, -F.col(at))).alias("best_at"), (F.max(value) if largest else F.min(value)).alias("best"), F.max_by(value, at).alias("last"))


def coverage_totals(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by row and column value with all totals; a total has null in place of the value, told by grouping flags."""
    return df.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).cast("int").alias("all_rows"), F.grouping(column).cast("int").alias("all_columns"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with one column a value, 0 where none."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def crosstab_totals(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """crosstab() with total and share_x, each value's percentage of its row, and a row for all rows together, told by all_rows.

    A row value that is null is a row like any other; rows whose column value is
    not in values count nowhere.
    """
    own = df.where(F.col(column).isin(*values))
    n = {v: F.count_if(F.col(column) == v) for v in values}
    g = own.rollup(row).agg(F.grouping(row).cast("int").alias("all_rows"), F.count("*").alias("total"), *[c.alias(str(v)) for v, c in n.items()])
    return g.select(row, "all_rows", *[str(v) for v in values], "total", *[(100 * F.col(f"`{v}`") / F.col("total")).alias(f"share_{v}") for v in values])


def mean_std(df: DataFrame, keys: list[str], values: list[str], single: float | None = 0.0) -> DataFrame:
    """Mean and sample deviation of each value; a single row has no deviation, which is told as single (null if None)."""
    std = lambda v: F.stddev_samp(v) if single is None else F.coalesce(F.stddev_samp(v), F.lit(single))
    return df.groupBy(*keys).agg(*[f.alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg(v)), ("std", std(v)))])


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values, in order of count, then value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def size_summary(df: DataFrame, cluster: str, large: float = 0.5) -> DataFrame:
    """One row on cluster sizes: clusters, least, median, greatest, mean, and whether one holds more than a share of all."""
    s = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("n_clusters"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("greatest"), F.avg("n").alias("mean"), (F.max("n") > large * F.sum("n")).alias("imbalanced"))


def every_nth(df: DataFrame, at: str, n: int) -> DataFrame:
    """Rows at every n-th place and at the last one."""
    last = df.agg(F.max(at).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where((F.col(at) % n == 0) | (F.col(at) == F.col("_last"))).drop("_last")


def group_share(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """(keys, n, share) of rows that meet a condition; without keys one row, whose share is 0 for an empty table."""
    hit = F.coalesce(condition, F.lit(False)).cast("int")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("share"))


def pivot_mean(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """Means with one column a value; null where there is none."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(value))


def row_best(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, column, value): where the mean value is greatest in each row, the smallest column on ties."""
    m = df.groupBy(row, column).agg(F.avg(value).alias(value))
    return m.groupBy(row).agg(F.min_by(F.struct(F.col(column), F.col(value)), F.struct(-F.col(value), F.col(column))).alias("_b")).select(row, "_b.*")


def running_best(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """df with best_so_far and improved: whether a row is better than all before it in its group."""
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    b = F.max(value).over(before)
    return df.withColumn("best_so_far", F.greatest(b, F.col(value))).withColumn("improved", b.isNull() | (F.col(value) > b))


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): numbers from 0 in order of value; null is -1."""
    from .order import numbered

    d = numbered(df.select(column).distinct(), [F.col(column).asc_nulls_last()], "_r")
    return d.select(column, F.when(F.col(column).isNull(), -1).otherwise(F.col("_r")).cast("int").alias("code"))
