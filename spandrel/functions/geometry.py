"""Boxes as structs of four floats (x0, y0, x1, y1; points, origin top left). Arithmetic stays in single precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
BOX_TYPE = "struct<x0:float,y0:float,x1:float,y1:float>"


def box(x0, y0, x1, y1) -> Column:
    values = (x0, y0, x1, y1)
    return F.struct(*((v if isinstance(v, Column) else F.lit(v) if not isinstance(v, str) else F.col(v)).cast("float").alias(n) for v, n in zip(values, SIDES)))


def box_of(array: Column) -> Column:
    """A box from an array of four numbers."""
    return F.when(F.size(array) >= 4, box(*(array[i] for i in range(4))))


def _zero() -> Column:
    return F.lit(0).cast("float")


def width(b: Column) -> Column:
    return F.greatest(b.x1 - b.x0, _zero())


def height(b: Column) -> Column:
    return F.greatest(b.y1 - b.y0, _zero())


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> tuple[Column, Column]:
    two = F.lit(2).cast("float")
    return ((b.x0 + b.x1) / two).cast("float"), ((b.y0 + b.y1) / two).cast("float")


def contains_center(outer: Column, inner: Column) -> Column:
    x, y = center(inner)
    return x.between(outer.x0, outer.x1) & y.between(outer.y0, outer.y1)


def overlap(a: Column, b: Column) -> Column:
    """Area in common; 0 where they only touch."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), (w * h).cast("float")).otherwise(_zero())


def iou(a: Column, b: Column) -> Column:
    common = overlap(a, b)
    union = (area(a) + area(b) - common).cast("float")
    return F.when((common > 0) & (union > 0), (common / union).cast("float")).otherwise(_zero())


def union(a: Column, b: Column) -> Column:
    return box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def union_agg(b: Column) -> Column:
    """Aggregate: the smallest box around a group's boxes."""
    return box(F.min(b.x0), F.min(b.y0), F.max(b.x1), F.max(b.y1))


def median_agg(b: Column) -> Column:
    """Aggregate: the median of each side (the mean of the two middle ones for an even count)."""
    return box(*(F.percentile(b[n], F.lit(0.5)) for n in SIDES))


def scaled(b: Column, factor: Column) -> Column:
    return box(*(b[n] * factor for n in SIDES))


def pixels_to_points(b: Column, scale: Column) -> Column:
    return box(*(b[n] / scale for n in SIDES))


def points_to_pixels(b: Column, scale: Column) -> Column:
    return scaled(b, scale)


def crop_to_page(b: Column, x0: Column, y0: Column) -> Column:
    return box(b.x0 + x0, b.y0 + y0, b.x1 + x0, b.y1 + y0)


def to_top_left(l: Column, t: Column, r: Column, b: Column, origin: Column, page_height: Column) -> Column:
    """A box given by left, top, right, bottom, flipped where its origin is the page's bottom left."""
    flip = origin == "BOTTOMLEFT"
    return box(l, F.when(flip, page_height - t).otherwise(t), r, F.when(flip, page_height - b).otherwise(b))


def percent_box(b: Column, page_width: Column, page_height: Column) -> Column:
    return box(b.x0 / page_width * 100, b.y0 / page_height * 100, b.x1 / page_width * 100, b.y1 / page_height * 100)


def looks_risky(risk: Column) -> Column:
    """Parse-time risk markers that call for a second look."""
    return (risk.min_ocr_confidence < 0.85) | (risk.column_count_variance > 0.5) | (risk.merged_cell_rows > 0) | (risk.empty_cells > 0) | risk.rotated_text
