"""Numbering of all rows in order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """df with `name` (long): start, start + 1, ... in order of the columns `order`.

    Rows are dealt to ranges of the order and written; a row's number is its rank within its range plus
    the rows of the ranges before. Only counts, one per range, meet in one task.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = dealt.join(F.broadcast(counts), "_range")  # one row per range
    return out.withColumn(name, (rank + F.col("_base") + (start - 1)).cast("long")).drop("_range", "_base")


def summed_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name` (long): the sum of `value` over all rows before, in order of the columns `order` (which tell rows apart). By ranges, as numbered."""
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_n")).select("_range", before("_n", Window.orderBy("_range")).alias("_base"))
    out = dealt.join(F.broadcast(sums), "_range")  # one row per range
    return out.withColumn(name, (before(value, Window.partitionBy("_range").orderBy(*order)) + F.col("_base")).cast("long")).drop("_range", "_base")


def numbered_within(df: DataFrame, group: str, order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """df with `name` (long): 0, 1, ... in order of the columns `order` among the rows of each value of `group` (nulls are one).

    As numbered, but counts are one per range and group: a group with most of the rows is spread over ranges (so many of them, or the session's number of partitions).
    """
    taken = {c.lower() for c in df.columns}
    part, at, of, n, base = (next(x for k in range(len(taken) + 1) if (x := f"_{c}{k or ''}") not in taken) for c in ("range", "at", "group", "n", "base"))
    dealt = written(df.repartitionByRange(*([ranges] if ranges else []), group, *order).withColumn(part, F.spark_partition_id()))
    before = F.sum(n).over(Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(F.col(part).alias(at), F.col(group).alias(of)).agg(F.count(F.lit(1)).alias(n)).select(at, of, F.coalesce(before, F.lit(0)).alias(base))
    rank = F.row_number().over(Window.partitionBy(part, group).orderBy(*order)) - 1
    out = dealt.join(counts, (F.col(part) == F.col(at)) & F.col(group).eqNullSafe(F.col(of)))
    return out.withColumn(name, (rank + F.col(base)).cast("long")).drop(part, base, at, of)
