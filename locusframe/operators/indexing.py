"""Dense numbering and offsets without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_index(df: DataFrame, bucket: list[Column], order: list[str], name: str) -> DataFrame:
    """Number rows from 0 in the order of bucket, then order: row numbers within buckets plus the buckets' offsets.

    bucket must grow with the order (such as chromosome and position block); only one row a bucket is
    ordered globally.
    """
    keyed = df.withColumn("__b", F.struct(*bucket))
    sizes = keyed.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__o", F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__b", F.coalesce("__o", F.lit(0)).alias("__o"))
    within = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return keyed.withColumn("__r", within).join(before, "__b").withColumn(name, (F.col("__o") + F.col("__r")).cast("long")).drop("__b", "__r", "__o")


def offsets(counts: DataFrame, key: str = "q", n: str = "n") -> DataFrame:
    """counts with the running total before (start) and behind (stop) each key; keys are dealt to blocks of 2**16."""
    block = F.floor(F.col(key) / 65536)
    sums = counts.groupBy(block.alias("__b")).agg(F.sum(n).alias("__n"))
    base = sums.withColumn("__o", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__o")
    w = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("__b", block).withColumn("__s", F.sum(n).over(w)).join(F.broadcast(base), "__b")
    return out.withColumn("stop", (F.col("__o") + F.col("__s")).cast("long")).withColumn("start", (F.col("stop") - F.col(n)).cast("long")).drop("__b", "__s", "__o")


def chunks(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """df with chunk, the number from 0 of the near-equal part that a row of its group is in (the first parts are the longer ones)."""
    return df.withColumn("chunk", (F.ntile(n).over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))


def running_start(df: DataFrame, by: str, order: str, size: str, name: str, block: int = 1 << 16) -> DataFrame:
    """df with name: the sum of size over the rows of by that stand before, by order; added up in blocks of order, so no task sees a whole group."""
    keyed = df.withColumn("__b", F.floor(F.col(order) / block))
    sums = keyed.groupBy(by, "__b").agg(F.sum(size).alias("__n"))
    before = sums.withColumn("__o", F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.coalesce(F.sum(size).over(Window.partitionBy(by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.withColumn("__w", within).join(before, [by, "__b"]).withColumn(name, F.col("__o") + F.col("__w")).drop("__b", "__w", "__o")


def running_max(df: DataFrame, by: str, at: str, order: list[str], value: Column, name: str, before: bool, block: int = 1 << 20) -> DataFrame:
    """df with name: the largest value over the rows of by up to each row (before: without the row itself), in order, whose first key is at.

    Blocks of at are reduced first and only they are ordered by by, so no task sees a whole group. Null where there is no value yet.
    """
    keyed = df.withColumns({"__b": F.floor(F.col(at) / block), "__v": value})
    tops = keyed.groupBy(by, "__b").agg(F.max("__v").alias("__t"))
    earlier = tops.withColumn("__e", F.max("__t").over(Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__t")
    within = F.max("__v").over(Window.partitionBy(by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    return keyed.withColumn("__w", within).join(earlier, [by, "__b"]).withColumn(name, F.greatest("__w", "__e")).drop("__b", "__v", "__w", "__e")
