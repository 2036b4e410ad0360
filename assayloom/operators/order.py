"""Running sums and numbers in an order over whole tables, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def running(df: DataFrame, order: list, value, out: str, inclusive: bool = False) -> DataFrame:
    """df with out: the sum of value over the rows before in the given order, own row included if inclusive.

    Rows are dealt by ranges of the order and stored with their places; sums are
    taken inside each range and then over the ranges' totals, of which there is
    one a partition. Nulls come first unless the order says otherwise.
    """
    d = df.withColumn("_run_v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_run_id", F.monotonically_increasing_id())
    d = stored(d, "order").withColumn("_run_p", F.shiftright("_run_id", 33))
    over = Window.orderBy("_run_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_run_p").agg(F.sum("_run_v").alias("_run_t")).withColumn("_run_before", F.coalesce(F.sum("_run_t").over(over), F.lit(0))).select("_run_p", "_run_before")
    inside = Window.partitionBy("_run_p").orderBy("_run_id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return d.withColumn(out, F.coalesce(F.sum("_run_v").over(inside), F.lit(0))).join(totals, "_run_p").withColumn(out, F.col(out) + F.col("_run_before")).drop("_run_v", "_run_id", "_run_p", "_run_before")


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with out: the number of rows before in the given order."""
    return running(df, order, F.lit(1).cast("long"), out)
