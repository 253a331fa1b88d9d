"""Box and point arithmetic as column expressions. A box is four columns with a common prefix:
B("a") stands for a_x0, a_y0, a_x1, a_y1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, on which results depend.
#: Mean earth radius and metres of a mile, for distances on the sphere.
EARTH_METRES, MILE_METRES = 6371000.0, 1609.34


@dataclass(frozen=True)
class B:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def named(cls, prefix: str) -> B:
        return cls(*(F.col(f"{prefix}{side}") for side in ("x0", "y0", "x1", "y1")))

    @classmethod
    def of(cls, x0, y0, x1, y1) -> B:
        return cls(*(c if isinstance(c, Column) else F.lit(c) for c in (x0, y0, x1, y1)))


def contains(b: B, x: Column, y: Column) -> Column:
    return x.between(b.x0, b.x1) & y.between(b.y0, b.y1)


def intersects(a: B, b: B) -> Column:
    """Closed: touching counts."""
    return ~((a.x1 < b.x0) | (b.x1 < a.x0) | (a.y1 < b.y0) | (b.y1 < a.y0))


def width(b: B) -> Column:
    return b.x1 - b.x0


def height(b: B) -> Column:
    return b.y1 - b.y0


def area(b: B) -> Column:
    return width(b) * height(b)


def margin(b: B) -> Column:
    return (width(b) + height(b)) * 2


def half_margin(b: B) -> Column:
    return width(b) + height(b)


def overlap(a: B, b: B) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    zero = F.lit(0)
    return F.greatest(zero, w) * F.greatest(zero, h)


def intersects_open(a: B, b: B) -> Column:
    """A common area: a box without area meets nothing."""
    return overlap(a, b) > 0


def distance2_to_box(b: B, x: Column, y: Column) -> Column:
    """Squared; 0 inside."""
    dx = F.greatest(b.x0 - x, F.lit(0.0), x - b.x1)
    dy = F.greatest(b.y0 - y, F.lit(0.0), y - b.y1)
    return dx * dx + dy * dy


def stretched(a: B, b: B) -> B:
    return B(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def stretched_by_point(b: B, x: Column, y: Column) -> B:
    return stretched(b, B(x, y, x, y))


def is_valid(b: B) -> Column:
    """False for the empty box, whose sides are null."""
    return F.coalesce((b.x0 <= b.x1) & (b.y0 <= b.y1), F.lit(False))


def enlargement(a: B, b: B) -> Column:
    return area(stretched(a, b)) - area(a)


def centre_distance2(a: B, b: B) -> Column:
    """Of integer boxes, with halves cut towards zero."""
    dx = F.expr("0")
    parts = []
    for low_a, high_a, low_b, high_b in ((a.x0, a.x1, b.x0, b.x1), (a.y0, a.y1, b.y0, b.y1)):
        halves = [((low + high) / 2).cast("long") for low, high in ((low_a, high_a), (low_b, high_b))]
        parts.append((halves[0] - halves[1]) * (halves[0] - halves[1]))
    return dx + parts[0] + parts[1]


def same(a: B, b: B) -> Column:
    return (a.x0 == b.x0) & (a.y0 == b.y0) & (a.x1 == b.x1) & (a.y1 == b.y1)


def geo_to_integer_box(lat: Column, lon: Column, radius: float, scale: int = 1_000_000) -> B:
    """Degrees to integers, cut towards zero, then grown by a radius in degrees."""
    r = int(radius * scale)
    x, y = (lat * scale).cast("int"), (lon * scale).cast("int")
    return B(x - r, y - r, x + r, y + r)


def lower(b: B, axis: int) -> Column:
    return b.y0 if axis else b.x0


def upper(b: B, axis: int) -> Column:
    return b.y1 if axis else b.x1


def box_of(x: str = "x", y: str = "y", prefix: str = "") -> list[Column]:
    """Aggregates: the box of a group's points, null for none."""
    return [
        F.min(x).alias(f"{prefix}x0"),
        F.min(y).alias(f"{prefix}y0"),
        F.max(x).alias(f"{prefix}x1"),
        F.max(y).alias(f"{prefix}y1"),
    ]


def planar_distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def haversine_miles(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    half_lat, half_lon = F.sin(F.radians(lat1 - lat0) / 2), F.sin(F.radians(lon1 - lon0) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * half_lon * half_lon
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_METRES / MILE_METRES)
