"""Vectors, planes and angles as Column expressions; a vector is a triple of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def normalised(a: Vector) -> Vector:
    """Unit length; the zero vector stays zero."""
    size = length(a)
    return tuple(F.when(size > 0, x / size).otherwise(0.0) for x in a)  # type: ignore[return-value]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def angle_degrees(a: Vector, vertex: Vector, b: Vector) -> Column:
    """The angle at ``vertex``; null where a ray has no length."""
    u, v = minus(a, vertex), minus(b, vertex)
    size = length(u) * length(v)
    return F.when(size > 0, F.degrees(F.acos(clamp(dot(u, v) / size, -1.0, 1.0))))


def direction(v: Vector) -> Column:
    """The anatomical direction of a vector in LPS axes: the dominant axis, X before Y before Z on a tie."""
    x, y, z = (F.abs(c) for c in v)
    return (
        F.when((x == 0) & (y == 0) & (z == 0), "Unknown")
        .when((x >= y) & (x >= z), F.when(v[0] > 0, "Left").otherwise("Right"))
        .when(y >= z, F.when(v[1] > 0, "Posterior").otherwise("Anterior"))
        .otherwise(F.when(v[2] > 0, "Superior").otherwise("Inferior"))
    )


def plane(normal: Vector) -> Column:
    d = direction(normal)
    return F.when(d.isin("Superior", "Inferior"), "Axial").when(d.isin("Anterior", "Posterior"), "Coronal").when(d.isin("Left", "Right"), "Sagittal").otherwise("Unknown")


def opposite(d: Column) -> Column:
    out = F.lit("Unknown")
    for a, b in (("Left", "Right"), ("Anterior", "Posterior"), ("Superior", "Inferior")):
        out = F.when(d == a, b).when(d == b, a).otherwise(out)
    return out


def oblique(v: Vector, threshold: float = 0.9) -> Column:
    size = length(v)
    return F.when(size == 0, True).otherwise(F.greatest(*(F.abs(c) for c in v)) / size < threshold)


def tier(well_formed: Column, volume: Column, thickness: Column, spacing: Column, limit: float = 1.5) -> Column:
    return F.when(~well_formed, "Unusable").when(volume & (F.greatest(thickness, spacing) <= limit + 1e-6), "Extended").otherwise("Baseline")


def rank_of(name: Column, order: list[str]) -> Column:
    """The place of an enumeration's value, from 0; null for other values. Names never compare by alphabet."""
    out = F.lit(None).cast("int")
    for i, value in enumerate(order):
        out = F.when(name == value, i).otherwise(out)
    return out


def roof_angle(left_slope: Column, right_slope: Column) -> Column:
    """The upper angle between two roof lines, in degrees."""
    inner = -1.0 - left_slope * right_slope
    return F.degrees(F.acos(clamp(inner / (F.sqrt(1 + left_slope * left_slope) * F.sqrt(1 + right_slope * right_slope)), -1.0, 1.0)))


def pitch_degrees(ac: Vector, pc: Vector) -> Column:
    d = minus(ac, pc)
    return F.when(length(d) > 0, F.degrees(F.asin(d[2] / length(d))))


def levelling_degrees(ac: Vector, pc: Vector) -> Column:
    return F.degrees(F.atan2(pc[2] - ac[2], ac[1] - pc[1]))


def rotated_about_x(p: Vector, degrees: Column, centre: Vector) -> Vector:
    a = F.radians(degrees)
    y, z = p[1] - centre[1], p[2] - centre[2]
    return p[0], centre[1] + y * F.cos(a) - z * F.sin(a), centre[2] + y * F.sin(a) + z * F.cos(a)
