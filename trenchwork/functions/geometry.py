"""Planar geometry as column expressions; a point is a pair (x, y) of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def cross(a: Point, b: Point, c: Point) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def distance(a: Point, b: Point) -> Column:
    return F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]))


def _side(value: Column, eps: float) -> Column:
    return F.when(value > eps, 1).when(value < -eps, -1).otherwise(0)


def crosses(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether the open segments ab and cd cross at an inner point of both."""
    eps = 1e-12
    return (_side(cross(a, b, c), eps) * _side(cross(a, b, d), eps) < 0) & (_side(cross(c, d, a), eps) * _side(cross(c, d, b), eps) < 0)


def _on(a: Point, b: Point, p: Point) -> Column:
    eps = 1e-9
    inside = [(p[i] >= F.least(a[i], b[i]) - eps) & (p[i] <= F.greatest(a[i], b[i]) + eps) for i in (0, 1)]
    return (F.abs(cross(a, b, p)) < eps) & inside[0] & inside[1]


def touches(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether the closed segments have a point in common."""
    inner = (_side(cross(a, b, c), 0) * _side(cross(a, b, d), 0) < 0) & (_side(cross(c, d, a), 0) * _side(cross(c, d, b), 0) < 0)
    return inner | _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)


def cross_place(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Where on ab (0 to 1) cd crosses it; null if nowhere or if parallel."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    den = rx * sy - ry * sx
    safe = F.when(F.abs(den) >= 1e-15, den)
    t = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / safe
    u = ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / safe
    return F.when(t.between(0, 1) & u.between(0, 1), t)


def foot_place(a: Point, b: Point, p: Point) -> Column:
    """The place (0 to 1) on ab that is nearest to p."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    square = dx * dx + dy * dy
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.when(square >= 1e-18, square)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def point_distance(a: Point, b: Point, p: Point) -> Column:
    """From p to the segment ab."""
    t = foot_place(a, b, p)
    return distance((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])), p)


def segment_distance(a: Point, b: Point, c: Point, d: Point) -> Column:
    apart = F.least(point_distance(a, b, c), point_distance(a, b, d), point_distance(c, d, a), point_distance(c, d, b))
    inner = (_side(cross(a, b, c), 0) * _side(cross(a, b, d), 0) < 0) & (_side(cross(c, d, a), 0) * _side(cross(c, d, b), 0) < 0)
    return F.when(inner, 0.0).otherwise(apart)


def sine(a: Point, b: Point, c: Point, d: Point) -> Column:
    """The sine of the angle between ab and cd, 1 if either has no length."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    lengths = distance(a, b) * distance(c, d)
    return F.coalesce(F.abs(ux * vy - uy * vx) / F.when(lengths > 1e-12, lengths), F.lit(1.0))


def path_length(path: Column) -> Column:
    """The length of an array of struct<x, y>."""
    legs = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), lambda p, q: distance((p["x"], p["y"]), (q["x"], q["y"])))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def turn(a: Point, b: Point, c: Point) -> Column:
    """How far the way from a over b to c turns at b, in degrees; 0 where a leg has no length."""
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    lengths = distance(a, b) * distance(b, c)
    cosine = (ux * vx + uy * vy) / F.when(lengths > 1e-12, lengths)
    return F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), F.lit(0.0))


def meets_box(a: Point, b: Point, low: Point, high: Point) -> Column:
    """Whether the segment ab has a point in the box: its own box overlaps it, and the corners are not all on one side."""
    boxes = [(F.least(a[i], b[i]) <= high[i]) & (F.greatest(a[i], b[i]) >= low[i]) for i in (0, 1)]
    corners = [cross(a, b, (x, y)) for x in (low[0], high[0]) for y in (low[1], high[1])]
    return boxes[0] & boxes[1] & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def without_repeats(path: Column, within: float = 1e-9) -> Column:
    """An array of struct<x, y> without the points that lie where the one before them in the array does."""
    far = lambda p, q: (F.abs(p["x"] - q["x"]) > within) | (F.abs(p["y"] - q["y"]) > within)
    return F.filter(path, lambda p, i: (i == 0) | far(p, F.get(path, i - 1)))
