"""Running totals over whole groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: str, bucket: Column, order: list[str], value: str, into: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group that come before (exclusive) in column ``into``.

    Rows are ordered by ``bucket``, then by ``order``; ``bucket`` must put a bounded number of rows into each bucket, so a
    group is never sorted by one task: totals of buckets are summed up first (one row a bucket), and each bucket then adds
    its own running total to that of the buckets before it. Ties in ``order`` get an arbitrary order; null values count 0;
    a null group is a group. Two shuffles, by (group, bucket).
    """
    df = df.withColumn("__rt_bucket", bucket)
    totals = df.groupBy(group, "__rt_bucket").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__rt_sum"))
    before = Window.partitionBy(group).orderBy("__rt_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("__rt_group"), F.col("__rt_bucket").alias("__rt_at"), F.coalesce(F.sum("__rt_sum").over(before), F.lit(0)).alias("__rt_before"))
    inner = Window.partitionBy(group, "__rt_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__rt_local", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inner), F.lit(0)))
    joined = local.join(totals, F.col(group).eqNullSafe(F.col("__rt_group")) & (F.col("__rt_bucket") == F.col("__rt_at")))
    return joined.withColumn(into, F.col("__rt_before") + F.col("__rt_local")).drop("__rt_bucket", "__rt_group", "__rt_at", "__rt_before", "__rt_local")
