"""Rotations, rigid motions and small numeric helpers as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sensors import Point, norm

#: Below this angle the series is more exact than the closed form.
SMALL = 1e-3


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def plane_normal(a: Point, b: Point, c: Point) -> Point:
    """The unit normal of the plane through three points, null if they lie on a line."""
    n = cross(tuple(q - p for p, q in zip(a, b, strict=True)), tuple(q - p for p, q in zip(b, c, strict=True)))
    length = norm(n)
    return tuple(F.when(length > 0, x / length) for x in n)


def power_two_up(x: Column) -> Column:
    """The least power of two that is not below x, 1 at least; by counting bits, as logarithms aren't exact."""
    below = F.ceil(x).cast("long") - 1
    return F.when(below < 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(below))))


def fraction(x: Column) -> Column:
    """What is above the floor, in [0, 1) for negative numbers too."""
    return x - F.floor(x)


def _sum(p: Point, *terms: tuple[Column, Point]) -> Point:
    out = list(p)
    for share, q in terms:
        out = [x + share * y for x, y in zip(out, q, strict=True)]
    return tuple(out)


def _shares(w: Point) -> tuple[Column, Column, Column]:
    """sin t / t, (1 - cos t) / t^2 and (t - sin t) / t^3 of a rotation vector's angle t."""
    t = norm(w)
    half = F.sin(t / 2)
    return (
        F.when(t < SMALL, F.lit(1.0) - t * t / 6).otherwise(F.sin(t) / t),
        F.when(t < SMALL, F.lit(0.5) - t * t / 24).otherwise(F.lit(2.0) * half * half / (t * t)),
        F.when(t < SMALL, F.lit(1 / 6) - t * t / 120).otherwise((t - F.sin(t)) / (t * t * t)),
    )


def turned(w: Point, p: Point) -> Point:
    """A point turned by a rotation vector: axis times angle."""
    s, c, _ = _shares(w)
    once = cross(w, p)
    return _sum(p, (s, once), (c, cross(w, once)))


def moved(t: Point, w: Point, p: Point) -> Point:
    """A point under the rigid motion of a twist (translation, rotation)."""
    _, c, d = _shares(w)
    once = cross(w, t)
    shift = _sum(t, (c, once), (d, cross(w, once)))
    return tuple(a + b for a, b in zip(turned(w, p), shift, strict=True))


def pose_matrix(shift: tuple[float, float, float], quaternion: tuple[float, float, float, float] = (1.0, 0.0, 0.0, 0.0), scale: float = 1.0) -> np.ndarray:
    """4x4: scaled, then turned by a quaternion (w, x, y, z) of any length but 0, then moved."""
    w, x, y, z = np.array(quaternion, dtype=float) / np.linalg.norm(quaternion)
    out = np.eye(4)
    out[:3, :3] = scale * (np.eye(3) + 2 * np.array([[-y * y - z * z, x * y - w * z, x * z + w * y], [x * y + w * z, -x * x - z * z, y * z - w * x], [x * z - w * y, y * z + w * x, -x * x - y * y]]))
    out[:3, 3] = shift
    return out
