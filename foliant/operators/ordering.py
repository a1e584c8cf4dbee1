"""Places and running sums in an order, over groups of any size: ordered blocks, block totals, offsets joined back.

A window function brings a whole group into one task. Here rows are ordered in blocks by Spark's range partitioning,
which cuts a large group into many blocks; each block is counted by itself, and only the blocks' totals are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.lineage import cut

#: Totals are broadcast up to this many rows; beyond, they meet the rows by a shuffle.
MOST_TOTALS = 200_000


def _blocks(rows: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """The rows in ordered blocks: block, and at, a number that ascends in each block. The rows are written once.

    Rows that are equal in every way go apart by their place in the table, so copies don't fill one block.
    """
    kept = cut(rows).withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(group), *order, F.col("_tie")]
    placed = kept.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    return cut(placed.withColumn("_block", F.shiftright("_at", 33)))


def _sized(totals: DataFrame) -> DataFrame:
    totals = cut(totals)
    return F.broadcast(totals) if totals.limit(MOST_TOTALS + 1).count() <= MOST_TOTALS else totals


def _with_totals(blocks: DataFrame, totals: DataFrame, group: str) -> DataFrame:
    """The rows of blocks with what is known of their block and group; null groups meet too."""
    known = _sized(totals).withColumnsRenamed({group: "_group", "_block": "_of"})
    return blocks.join(known, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_of")))


def ranked(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """The rows with ``place`` (from 0, in the order within the group) and ``group_rows``.

    Null groups are one group; equal rows get places in no given order. Groups may have any size.
    """
    blocks = _blocks(rows, group, list(order))
    totals = blocks.groupBy(group, "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select(group, "_block", "_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"), F.sum("n").over(whole).alias("_in_all"))
    met = _with_totals(blocks, sums, group)
    return met.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), F.col("_in_all").alias("group_rows"))


def summed(rows: DataFrame, group: str, value: str, *order: Column | str) -> DataFrame:
    """The rows with ``before``: the sum of ``value`` (a whole number; null counts as 0) over the group's earlier rows."""
    blocks = _blocks(rows, group, list(order))
    one = F.coalesce(F.col(value).cast("long"), F.lit(0))
    totals = blocks.groupBy(group, "_block").agg(F.sum(one).alias("n"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select(group, "_block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_block", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    met = _with_totals(blocks.withColumn("_inside", F.coalesce(F.sum(one).over(inside), F.lit(0))), sums, group)
    return met.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias("before"))


def following(rows: DataFrame, group: str, value: str, *order: Column | str) -> DataFrame:
    """The rows with ``next``: the first ``value`` that isn't null at the row itself or after it in the group's order."""
    blocks = _blocks(rows, group, list(order))
    firsts = blocks.groupBy(group, "_block").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("first"))
    # From the end on, so that each frame grows by a row; a frame that shrinks from the front is computed anew for each row.
    later = Window.partitionBy(group).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = firsts.select(group, "_block", F.last("first", True).over(later).alias("_later"))
    inside = Window.partitionBy("_block", group).orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = _with_totals(blocks.withColumn("_inside", F.last(value, True).over(inside)), known, group)
    return met.select(*rows.columns, F.coalesce("_inside", "_later").alias("next"))
