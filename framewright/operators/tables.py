"""Putting small results together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several one-row results in one row, without a join; their names must differ."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in the order, from 1, without sorting it in one task.

    The order must be total. Rows are sorted by ranges; a range's numbers start after the rows of the ranges before it, of which there is
    one row per partition.
    """
    parts = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = parts.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return own.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).drop("__part", "__own", "__before")
