"""Box arithmetic on four columns, and one-hot labels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four columns; corners ``x1 y1 x2 y2`` unless a function says otherwise."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box_of(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + n) for n in ("x1", "y1", "x2", "y2")))


def clamp(box: Box, window: Box) -> Box:
    def hold(v: Column, lo: Column, hi: Column) -> Column:
        return F.least(F.greatest(v, lo), hi)

    return Box(
        hold(box.x1, window.x1, window.x2),
        hold(box.y1, window.y1, window.y2),
        hold(box.x2, window.x1, window.x2),
        hold(box.y2, window.y1, window.y2),
    )


def inside(box: Box, window: Box) -> Column:
    return (box.x1 >= window.x1) & (box.y1 >= window.y1) & (box.x2 <= window.x2) & (box.y2 <= window.y2)


def to_centre(box: Box) -> Box:
    """Corners to centre and size."""
    return Box((box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2, box.x2 - box.x1, box.y2 - box.y1)


def to_corners(box: Box) -> Box:
    """Centre and size to corners."""
    return Box(box.x1 - box.x2 / 2, box.y1 - box.y2 / 2, box.x1 + box.x2 / 2, box.y1 + box.y2 / 2)


def area(box: Box) -> Column:
    return (box.x2 - box.x1) * (box.y2 - box.y1)


def intersection(a: Box, b: Box) -> Column:
    width = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0))
    height = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0))
    return width * height


def iou(a: Box, b: Box) -> Column:
    common = intersection(a, b)
    return F.try_divide(common.cast("double"), (area(a) + area(b) - common).cast("double"))


def one_hot(label: Column, classes: int) -> Column:
    """Array with a 1 at the label; a negative label counts as class 0."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == F.greatest(label, F.lit(0))).cast("int")
    )
