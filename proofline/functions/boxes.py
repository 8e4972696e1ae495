"""Box geometry: [left, top, right, bottom] in page units, as array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_valid(box: Column) -> Column:
    """Four numbers with left <= right and the second <= the fourth."""
    return F.coalesce((F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull() | F.isnan(v)) & (box[0] <= box[2]) & (box[1] <= box[3]), F.lit(False))


def area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def coverage(cell: Column, box: Column) -> Column:
    """Share of ``box`` that lies in ``cell``; 0 for a box without area."""
    width = F.greatest(F.least(cell[2], box[2]) - F.greatest(cell[0], box[0]), F.lit(0.0))
    height = F.greatest(F.least(cell[3], box[3]) - F.greatest(cell[1], box[1]), F.lit(0.0))
    return F.coalesce(width * height / F.nullif(area(box), F.lit(0.0)), F.lit(0.0))


def core(box: Column) -> Column:
    """The middle 40 % of a box's height."""
    middle, half = (box[1] + box[3]) / 2, (box[3] - box[1]) * 0.2
    return F.array(box[0], middle - half, box[2], middle + half)


def flipped(box: Column, page_height: Column) -> Column:
    """A box with its origin at the other end of the page."""
    return F.array(box[0], page_height - box[3], box[2], page_height - box[1])
