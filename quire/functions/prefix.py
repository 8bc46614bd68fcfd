"""Running sums that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(df: DataFrame, groups: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Adds the running sum of `value` within `groups` by `order`, the row included.

    `bucket` must rise with the order. Sums within buckets are windows of bounded
    size; sums of whole buckets are added from a table with one row a bucket, so a
    group that holds a third of all rows is spread over its buckets.
    """
    df = df.withColumn("_b", bucket)
    whole = df.groupBy(*groups, "_b").agg(F.sum(value).alias("_s"))
    earlier = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select(*groups, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_e"))
    inside = W.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(whole, [*groups, "_b"]).withColumn(out, F.sum(value).over(inside) + F.col("_e")).drop("_b", "_e")


def running_last(df: DataFrame, groups: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Adds the last value that is not null within `groups` by `order`, the row included.

    As `running_sum`, by windows of bounded size and a table with one row a bucket.
    """
    df = df.withColumn("_b", bucket)
    ends = df.groupBy(*groups, "_b").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(*order, value))).alias("_s"))
    earlier = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*groups, "_b", F.last("_s", True).over(earlier)[value].alias("_e"))
    inside = W.partitionBy(*groups, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(ends, [*groups, "_b"]).withColumn(out, F.coalesce(F.last(value, True).over(inside), F.col("_e"))).drop("_b", "_e")
