"""Gaps and islands, scene cuts and other operators on ordered rows, spread over buckets of the order.

A key may hold a large share of all rows, so no window orders a whole key: rows are ordered within (key, bucket), where the bucket
grows with the order, and what crosses buckets comes from one row per bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import numeric as N


def _bucketed(df: DataFrame, order: list[str], width: float) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(order[0]) / width))


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], width: float) -> DataFrame:
    """``df`` with ``prev``, a struct of the columns of the row before within ``by``, null at the first row.

    order: columns whose first is a number, cut into buckets of ``width``; ties of all of them are ordered arbitrarily. Rows whose
    first order column is null come before all others.
    """
    keys = [*by, "__b"]
    b = _bucketed(df, order, width)
    w = Window.partitionBy(*keys).orderBy(*order)
    last = b.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
    edge = last.withColumn("__before", F.lag("__last").over(Window.partitionBy(*by).orderBy("__b"))).drop("__last")
    local = b.withColumn("prev", F.lag(F.struct(*columns)).over(w))
    same = [local[k].eqNullSafe(edge[k]) for k in keys]
    joined = local.join(edge, same, "left").select(*[local[c] for c in df.columns], F.coalesce(local["prev"], F.col("__before")).alias("prev"))
    return joined


def running_count(df: DataFrame, by: list[str], order: list[str], flag: str, name: str, width: float) -> DataFrame:
    """``df`` with the number of rows up to this one, within ``by``, whose ``flag`` is true."""
    keys = [*by, "__b"]
    b = _bucketed(df, order, width)
    one = F.coalesce(F.col(flag), F.lit(False)).cast("long")
    local = b.withColumn("__n", F.sum(one).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    total = b.groupBy(*keys).agg(F.sum(one).alias("__t"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edge = total.withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    same = [local[k].eqNullSafe(edge[k]) for k in keys]
    return local.join(edge, same, "left").select(*[local[c] for c in df.columns], (F.col("__n") + F.col("__before")).alias(name))


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Callable[[Column], Column], columns: list[str], width: float = 600.0, name: str = "island") -> DataFrame:
    """``df`` with a number per run of rows: a run starts at the first row of ``by`` and where ``breaks`` of the row before is true or null.

    breaks gets the struct of ``columns`` of the row before.
    """
    p = with_previous(df, by, order, columns, width)
    p = p.withColumn("__new", F.col("prev").isNull() | F.coalesce(breaks(F.col("prev")), F.lit(True))).drop("prev")
    return running_count(p, by, order, "__new", "__run", width).withColumn(name, F.col("__run") - 1).drop("__run", "__new")


def scene_cuts(frames: DataFrame, by: str, order: str, time: str, vector: str, card: str, threshold: float = 0.70, min_sec: float = 4.0, width: float = 600.0) -> DataFrame:
    """``frames`` with scene (0, 1, ...) per ``by``.

    A frame opens a scene if its vector is less similar than ``threshold`` to the one before, or if a title card begins or ends
    there. Scenes shorter than ``min_sec``, measured to the last frame before the next cut, join the one before; those that a
    card opens or that follow one stay, as does the first. Rows with a null vector count as similar to their neighbours.
    Only the frames that open a scene are numbered as a whole.
    """
    keys, row = [by], [order]
    f = with_previous(frames, keys, row, [vector, card], width)
    similar = N.dot(F.col(vector), F.col(f"prev.{vector}"))
    cut = F.col("prev").isNull() | F.coalesce(similar < threshold, F.lit(False)) | F.coalesce(F.col(card) != F.col(f"prev.{card}"), F.lit(False))
    f = f.withColumn("__was", F.col(f"prev.{card}")).withColumn("__cut", cut).drop("prev")
    f = running_count(f, keys, row, "__cut", "__part", width)
    spans = f.groupBy(by, "__part").agg(F.min_by(F.struct(time, card, "__was"), order).alias("a"), F.max_by(time, order).alias("z"))
    kept = (F.col("__part") == 1) | (F.col("z") - F.col(f"a.{time}") >= min_sec) | F.col(f"a.{card}") | F.coalesce(F.col("a.__was"), F.lit(False))
    scenes = running_count(spans.withColumn("__kept", kept), keys, ["__part"], "__kept", "__scene", width).select(by, "__part", (F.col("__scene") - 1).alias("scene"))
    return f.join(scenes, [by, "__part"]).drop("__was", "__cut", "__part")
