"""Stratified sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def first_of_each(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Each of SALTS parts of a group is cut to n first, so no task sorts a whole hot group."""
    part = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    cut = lambda df, *by: df.withColumn("_k", F.row_number().over(Window.partitionBy(group, *by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
    return cut(cut(rows, part))


def round_robin_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` rows, one of each group per round, in the order of each group's first row; with a column ``round`` from 1.

    No group can give more than n rows. Null groups are a group.
    """
    kept = first_of_each(rows, group, [order], n)
    ranked = kept.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    firsts = rows.groupBy(group).agg(F.min(order).alias("_first")).withColumnRenamed(group, "_group")
    both = ranked.join(firsts, F.col(group).eqNullSafe(F.col("_group")))
    return both.orderBy("round", "_first", order).limit(n).drop("_first", "_group")


def scan_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """A round-robin sample of ``n`` rows from the beginning of a source that is too large to be read whole.

    Rows are taken in order until ``n`` candidates are there (each group gives at most n) and either enough rows were seen
    (200 x n, between 200 and 5000) or n groups; after 1000 x n rows it ends in any case. Only that many rows,
    a number the caller sets, are ranked together.
    """
    least = max(200, min(5000, 200 * n))
    most = max(least, 1000 * n)
    line = F.row_number().over(Window.orderBy(order))
    first = rows.orderBy(order).limit(most).withColumn("_line", line)
    within = F.row_number().over(Window.partitionBy(group).orderBy("_line"))
    seen = first.withColumn("_g", within)
    so_far = Window.orderBy("_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = seen.withColumn("_cand", F.sum((F.col("_g") <= n).cast("int")).over(so_far)).withColumn("_groups", F.sum((F.col("_g") == 1).cast("int")).over(so_far))
    enough = (F.col("_cand") >= n) & ((F.col("_line") >= least) | (F.col("_groups") >= n) | (F.col("_line") >= most))
    stop = F.min(F.when(enough, F.col("_line"))).over(Window.partitionBy(F.lit(1)))
    kept = counted.withColumn("_stop", stop).where((F.col("_line") <= F.coalesce("_stop", F.lit(most))) & (F.col("_g") <= n))
    return round_robin_sample(kept.select(*rows.columns, "_line"), group, "_line", n).drop("_line")
