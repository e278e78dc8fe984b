"""Ranks and row numbers without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.rounds import cut

#: Ranges that a column is cut into; the tables of ranges are this long for each group.
RANGES = 256


def numbered(df: DataFrame, *order: str, name: str = "_n") -> DataFrame:
    """Rows with their number from 1 in the order of some columns.

    Rows are dealt by ranges of the order; the counts of the ranges, a row each,
    give where each one starts, and a window numbers the rows of a range. The dealt
    rows are checkpointed, so that counts and numbers are of the same ranges."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, number).drop("_range", "_start")


def ranked(values: DataFrame, column: str, *groups: str) -> DataFrame:
    """The distinct values (v) of a column by group, with their count (n), how many are
    up to each (upto), and how many there are (total). Nulls do not count.

    Approximate quantiles cut each group into ranges; exact counts of the ranges, RANGES
    rows for a group, give where each begins, and only values of one range meet in a window."""
    rows = values.filter(F.col(column).isNotNull()).select(*groups, F.col(column).alias("v"))
    keys = groups or ("_all",)
    rows = rows if groups else rows.withColumn("_all", F.lit(0))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_cuts"), F.count("*").alias("total"))
    placed = rows.join(F.broadcast(cuts), list(keys)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("v"))))
    counts = placed.groupBy(*keys, "_range", "v", "total").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("size")).select(*keys, "_range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_in", F.sum("n").over(inside)).join(F.broadcast(starts), [*keys, "_range"]).select(*groups, "v", "n", (F.col("_start") + F.col("_in")).alias("upto"), "total")


def element(index) -> Column:
    """Aggregate over ranked values: the element at an index (from 0) of the sorted list."""
    return F.min(F.when(F.col("upto") > index, F.col("v")))


def percentile(rows: DataFrame, qs: dict[str, float], *groups: str) -> DataFrame:
    """Percentiles of ranked values, linear between neighbours, as columns."""
    at = {name: (F.col("total") - 1) * F.lit(q) for name, q in qs.items()}
    both = [(element(F.floor(x)).alias(f"_low_{n}"), element(F.ceil(x)).alias(f"_high_{n}")) for n, x in at.items()]
    sums = rows.groupBy(*groups).agg(*(c for pair in both for c in pair), F.max("total").alias("total"))
    part = {n: (F.col("total") - 1) * F.lit(q) - F.floor((F.col("total") - 1) * F.lit(q)) for n, q in qs.items()}
    return sums.select(*groups, *((F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * part[n]).alias(n) for n in qs))
