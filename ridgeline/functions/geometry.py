"""Boxes and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(a: tuple, b: tuple) -> Column:
    """The common area of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    return w * h


def area(a: tuple) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union, the union floored."""
    common = intersection(a, b)
    return common.cast("double") / F.greatest((area(a) + area(b) - common).cast("double"), F.lit(1e-9))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays as a double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
