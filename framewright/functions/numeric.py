"""Time, geometry, vector and statistics expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ = lambda c: F.col(c) if isinstance(c, str) else c


def minutes_seconds(sec) -> Column:
    """Whole seconds as m:ss, minutes unbounded."""
    s = _(sec).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def parse_minutes_seconds(c) -> Column:
    """Seconds of a text that is exactly m:ss; null otherwise."""
    pattern = r"^\s*(\d{1,2}):([0-5]\d)\s*$"
    return F.when(_(c).rlike(pattern), F.regexp_extract(_(c), pattern, 1).cast("int") * 60 + F.regexp_extract(_(c), pattern, 2).cast("int"))


def ratio(a, b, otherwise: float | None = None) -> Column:
    """a / b, or ``otherwise`` where b is 0."""
    r = F.try_divide(_(a).cast("double"), _(b).cast("double"))
    return r if otherwise is None else F.coalesce(r, F.lit(otherwise))


def iou(a: tuple, b: tuple) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) as a share of their union; 0 where they are apart."""
    ax1, ay1, ax2, ay2 = map(_, a)
    bx1, by1, bx2, by2 = map(_, b)
    w = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    h = F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    inter = w * h
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter + 1e-9))


def nose_offset(nose_x, left_eye_x, right_eye_x) -> Column:
    """How far a face is turned: the nose's distance from the middle of the eyes, in eye distances."""
    eyes = F.abs(_(right_eye_x) - _(left_eye_x))
    return F.abs((_(nose_x) - (_(left_eye_x) + _(right_eye_x)) / 2) / (eyes + 1e-6))


def body_box(x1, y1, x2, y2, width, height, wide: float = 1.0, tall: float = 3.0) -> Column:
    """Struct of the torso below a face, cut at the picture's borders and truncated to whole pixels."""
    fw, fh = _(x2) - _(x1), _(y2) - _(y1)
    return F.struct(
        F.greatest(F.lit(0), (_(x1) - fw * wide)).cast("int").alias("x1"),
        F.least(_(height), _(y2)).cast("int").alias("y1"),
        F.least(_(width), (_(x2) + fw * wide)).cast("int").alias("x2"),
        F.least(_(height), (_(y2) + fh * tall)).cast("int").alias("y2"),
    )


def dot(a, b) -> Column:
    """Inner product in double precision; null where lengths differ."""
    return F.aggregate(F.zip_with(_(a), _(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a) -> Column:
    """The vector scaled to length one (1e-9 is added to its length)."""
    n = norm(a) + 1e-9
    return F.transform(_(a), lambda x: x.cast("double") / n)


def wilson(successes, n, z: float = 1.96) -> Column:
    """Struct (lo, hi): the interval of a share, cut at 0 and 1; (0, 1) without trials."""
    n_, p = _(n).cast("double"), _(successes).cast("double") / _(n)
    mid = (p + z * z / (2 * n_)) / (1 + z * z / n_)
    half = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / (1 + z * z / n_)
    none = _(n) <= 0
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)).alias("lo"), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), mid + half)).alias("hi"))
