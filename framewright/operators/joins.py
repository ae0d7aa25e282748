"""Range, distance and as-of joins as bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.numeric import iou
from framewright.operators.tables import numbered


#: Buckets that an interval of a range join is listed in at most.
LONG = 4096


def range_join(points: DataFrame, intervals: DataFrame, by: str, point: str, start: str, end: str, width: float, closed: bool = True) -> DataFrame:
    """All pairs of a point and an interval of the same ``by`` that holds it; columns of both.

    Intervals are listed once per bucket of ``width`` that they meet and joined on (by, bucket), so no side is compared as a
    whole. Choose the width near the usual length of an interval. One that meets more than LONG buckets, whatever its bounds, is compared with
    the points of its ``by`` instead, most of which such an interval holds. Closed intervals hold their end, others don't. Rows with a
    null or NaN point or bound, or a start after the end, give no pairs. Columns other than ``by`` must differ in name.
    """
    b = "__bucket"
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    p = points.where(finite(point)).withColumn(b, F.floor(F.col(point) / width))
    i = intervals.where(finite(start) & finite(end) & (F.col(start) <= F.col(end)))
    buckets = (F.col(end).cast("double") - F.col(start).cast("double")) / width
    listed = i.where(buckets <= LONG).withColumn(b, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    inside = (F.col(point) >= F.col(start)) & ((F.col(point) <= F.col(end)) if closed else (F.col(point) < F.col(end)))
    short = p.join(listed, [by, b]).where(inside).drop(b)
    return short.unionByName(p.drop(b).join(i.where(buckets > LONG), by).where(inside))


def within(a: DataFrame, b: DataFrame, by: str, left: str, right: str, distance: float) -> DataFrame:
    """All pairs of the same ``by`` whose values differ by at most ``distance``; see range_join for nulls."""
    spans = a.withColumn("__lo", F.col(left) - distance).withColumn("__hi", F.col(left) + distance)
    pairs = range_join(b, spans, by=by, point=right, start="__lo", end="__hi", width=max(distance * 2, 1e-9), closed=True)
    return pairs.where(F.abs(F.col(left) - F.col(right)) <= distance).drop("__lo", "__hi")


def as_of(rows: DataFrame, events: DataFrame, by: str, time: str, tie: str, value: str, bucket: float) -> DataFrame:
    """``rows`` with the ``value`` of the latest event of the same ``by`` at or before their time, null before the first.

    Of events at the same time the one with the largest ``tie`` counts. Both sides are merged in one sort per (by, bucket
    of time), so a key is no single task; a bucket's rows before its first event take the last event of the buckets
    before, found over one row per bucket. Rows with a null or NaN time get null, events with one count for nothing; events with a
    null value leave the one before in force.
    """
    t = F.col(time).cast("double")
    ok = t.isNotNull() & ~F.isnan(t)
    own = [c for c in rows.columns]
    left = rows.select(F.struct(*own).alias("__row"), F.col(by).alias("__by"), F.when(ok, t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(events.schema[value].dataType).alias("__v"), F.lit(None).cast(events.schema[tie].dataType).alias("__k"))
    right = events.where(ok & F.col(value).isNotNull()).select(F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(by).alias("__by"), t.alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(tie).alias("__k"))
    both = left.unionByName(right).withColumn("__b", F.floor(F.col("__t") / bucket))
    w = Window.partitionBy("__by", "__b").orderBy("__t", "__side", "__k").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("__found", F.last("__v", ignorenulls=True).over(w))
    last = right.withColumn("__b", F.floor(F.col("__t") / bucket)).groupBy("__by", "__b").agg(F.max_by("__v", F.struct("__t", "__k")).alias("__v"))
    buckets = both.select("__by", "__b").where("__b is not null").distinct().join(last, ["__by", "__b"], "left")
    before = Window.partitionBy("__by").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("__by", "__b", F.last("__v", ignorenulls=True).over(before).alias("__before"))
    out = local.where("__side = 1").join(carried, ["__by", "__b"], "left")
    return out.select("__row.*", F.coalesce("__found", "__before").alias(value))


def adopt_tracks(detections: DataFrame, key: str, frame: str, track: str, box: tuple[str, str, str, str], least: float = 0.5) -> DataFrame:
    """(key, track): every detection with a track of its own.

    One without adopts the track of the tracked detection in the next frame whose box overlaps most, from ``least`` on; of equal overlaps
    the one with the larger key. One that finds none is a track of its own, named s and its number in the order of keys from 0. Keys
    are unique; rows with a null key count for nothing, a null frame or box finds none.
    """
    rows = detections.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(frame).alias("f"), F.col(track).alias("t"), F.struct(*[F.col(c).alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"))]).alias("b"))
    lost, found = rows.where("t is null"), rows.where("t is not null")
    nxt = found.select((F.col("f") - 1).alias("f"), F.col("k").alias("other"), F.col("t").alias("next"), F.col("b").alias("c"))
    corners = lambda b: tuple(F.col(f"{b}.{x}") for x in ("x1", "y1", "x2", "y2"))
    pairs = lost.join(nxt, "f").withColumn("iou", iou(corners("b"), corners("c"))).where(F.col("iou") >= least)
    adopted = pairs.groupBy("k").agg(F.max_by("next", F.struct("iou", "other")).alias("t"))
    alone = numbered(lost.select("k").join(adopted, "k", "left_anti"), [F.col("k")], "n").select("k", F.concat(F.lit("s"), (F.col("n") - 1).cast("string")).alias("t"))
    return found.select("k", "t").unionByName(adopted).unionByName(alone).select(F.col("k").alias(key), F.col("t").alias(track))
