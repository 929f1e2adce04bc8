"""Boxes on pages: normalising, areas, gaps, zones and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the zones and of columns.
SIDEBAR, BODY, TOP, BOTTOM, SAME_COLUMN = 0.35, 0.32, 0.14, 0.78, 0.45


def normalised(value: Column, size: Column) -> Column:
    return F.when(size > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / size)), 6)).otherwise(0.0)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)


def area_ratio(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    return area(x1, y1, x2, y2) / F.greatest(F.lit(1), width * height)


def relative_gap(upper_y2: Column, lower_y1: Column, height: Column) -> Column:
    return F.greatest(F.lit(0.0), (lower_y1 - upper_y2) / F.greatest(F.lit(1), height))


def alignment(n1: Column, n3: Column) -> Column:
    centre = (n1 + n3) / 2
    return F.when(centre < 0.4, "left").when(centre > 0.6, "right").otherwise("center")


def zones(n1: Column, n2: Column, n3: Column, n4: Column) -> Column:
    tests = [(n3 <= SIDEBAR, "left_sidebar_zone"), (n1 >= BODY, "main_body_zone"), (n4 <= TOP, "top_meta_zone"), (n2 >= BOTTOM, "bottom_meta_zone")]
    found = F.filter(F.array(*(F.when(test, name) for test, name in tests)), lambda z: z.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unclassified_zone")))


def centre(low: Column, high: Column) -> Column:
    return F.round((low + high) / 2, 4)


def centre_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.least(F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / float(2**0.5), F.lit(1.0))


def overlap(a1: Column, a3: Column, b1: Column, b3: Column) -> Column:
    """Share of the narrower box's width that the two have in common."""
    common = F.greatest(F.lit(0.0), F.least(a3, b3) - F.greatest(a1, b1))
    return F.least(F.lit(1.0), common / F.greatest(F.least(a3 - a1, b3 - b1), F.lit(1e-6)))
