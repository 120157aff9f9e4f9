"""Column expressions on coordinates, triangles and deterministic draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gap(a: list[Column], b: list[Column]) -> Column:
    """The Euclidean distance of two points."""
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def heron(a: Column, b: Column, c: Column) -> Column:
    """The area of a triangle with the given side lengths; 0 where they make none."""
    s = (a + b + c) / 2
    return F.sqrt(F.greatest(s * (s - a) * (s - b) * (s - c), F.lit(0.0)))


def corner(opposite: Column, b: Column, c: Column) -> Column:
    """The angle between sides b and c of a triangle; null where one of them has no length."""
    cosine = F.try_divide(b * b + c * c - opposite * opposite, 2 * b * c)
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def barycentric(px: Column, py: Column, a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> list[Column]:
    """Weights of the corners a, b and c at a point of the plane; null in a triangle without area."""
    area = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    wa = F.try_divide((b[1] - c[1]) * (px - c[0]) + (c[0] - b[0]) * (py - c[1]), area)
    wb = F.try_divide((c[1] - a[1]) * (px - c[0]) + (a[0] - c[0]) * (py - c[1]), area)
    return [wa, wb, 1 - wa - wb]


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) drawn from the text of the parts: the same for equal parts, whatever the partitioning."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def normal(*parts: Column | str) -> Column:
    """A standard normal number drawn likewise (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(*parts, "r"))) * F.cos(2 * math.pi * uniform(*parts, "a"))
