"""Three-dimensional vectors as triples of columns.

Scalar columns keep every expression inside whole-stage code generation.
Each function fixes the order of its additions, so that results are the same
wherever the expression is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, s) -> Vec:
    return a[0] * s, a[1] * s, a[2] * s


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, floor: float = 1e-6) -> Vec:
    n = F.greatest(norm(a), F.lit(floor))
    return a[0] / n, a[1] / n, a[2] / n


def mat(prefix: str) -> list[list[Column]]:
    """A 3 x 3 matrix in columns prefix + '00' ... '22'."""
    return [[F.col(f"{prefix}{i}{j}") for j in range(3)] for i in range(3)]


def apply(m: list[list[Column]], a: Vec) -> Vec:
    return tuple(dot(tuple(row), a) for row in m)  # type: ignore[return-value,arg-type]


def transposed(m: list[list[Column]]) -> list[list[Column]]:
    return [list(row) for row in zip(*m, strict=True)]


def rotate_z(a: Vec, angle: Column) -> Vec:
    c, s = F.cos(angle), F.sin(angle)
    return a[0] * c - a[1] * s, a[0] * s + a[1] * c, a[2]


def rotate_z_back(a: Vec, angle: Column) -> Vec:
    c, s = F.cos(angle), F.sin(angle)
    return a[0] * c + a[1] * s, a[1] * c - a[0] * s, a[2]


def look_at(position: Vec, target: Vec) -> list[Vec]:
    """Rows right, down, forward of a camera rotation; the up axis is +z, or +y where the view is steep."""
    forward = unit(sub(target, position), 1e-12)
    steep = F.abs(forward[2]) > F.lit(0.95)
    up = F.lit(0.0), F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0)
    right = unit(cross(forward, up), 1e-12)
    return [right, cross(forward, right), forward]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def micro(x: Column) -> Column:
    """Millionths, rounded, as a whole number: a value that engines agree on."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("long")


def named(a: Vec, *names: str) -> list[Column]:
    return [c.alias(n) for c, n in zip(a, names, strict=True)]
