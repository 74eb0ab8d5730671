"""4 x 4 affine matrices as arrays of 16 numbers in row order; column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def affine(axes: tuple[tuple, tuple, tuple], origin: tuple) -> Column:
    """The matrix that takes (i, j, k) to origin + i * axes[0] + j * axes[1] + k * axes[2]."""
    as_column = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    rows = [as_column(x) for r in range(3) for x in (*(a[r] for a in axes), origin[r])]
    return F.array(*rows, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def at(m: Column, row: int, column: int) -> Column:
    return F.get(m, F.lit(4 * row + column))


def applied(m: Column, point: tuple) -> tuple[Column, Column, Column]:
    """The matrix applied to a point."""
    x, y, z = point
    return tuple(at(m, r, 0) * x + at(m, r, 1) * y + at(m, r, 2) * z + at(m, r, 3) for r in range(3))


def product(a: Column, b: Column) -> Column:
    return F.array(*[sum((at(a, r, k) * at(b, k, c) for k in range(1, 4)), at(a, r, 0) * at(b, 0, c)) for r in range(4) for c in range(4)])


def inverse(m: Column, least: float = 1e-12) -> Column:
    """The inverse of an affine matrix; null where its determinant is ``least`` or less in size, or the matrix is null."""

    def minor(r: int, c: int) -> Column:  # the signed minor, by cyclic indices
        a, b, d, e = (r + 1) % 3, (r + 2) % 3, (c + 1) % 3, (c + 2) % 3
        return at(m, a, d) * at(m, b, e) - at(m, a, e) * at(m, b, d)

    det = sum((at(m, 0, c) * minor(0, c) for c in (1, 2)), at(m, 0, 0) * minor(0, 0))
    linear = [[minor(c, r) / det for c in range(3)] for r in range(3)]
    shift = [-(row[0] * at(m, 0, 3) + row[1] * at(m, 1, 3) + row[2] * at(m, 2, 3)) for row in linear]
    flat = [x for row, s in zip(linear, shift) for x in (*row, s)]
    return F.when(F.abs(det) > least, F.array(*flat, *map(F.lit, (0.0, 0.0, 0.0, 1.0))))
