"""Colours as Column functions: channels are whole numbers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One colour for each scale, coarser scales share the last.
SCALE_COLOURS = ((255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (0, 255, 255), (255, 0, 255), (127, 127, 127))
RGB = tuple[Column, Column, Column]


def cut(x: Column) -> Column:
    """A channel cut off to a whole number within its range."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x))).cast("int")


def add(a: RGB, b: RGB) -> RGB:
    return tuple(((x + y) % 256).cast("int") for x, y in zip(a, b, strict=True))


def scaled(a: RGB, by: Column | float) -> RGB:
    return tuple(cut(x * by) for x in a)


def blend(a: RGB, b: RGB, alpha: float) -> RGB:
    """alpha of a over b."""
    return tuple(cut(F.lit(float(alpha)) * x + F.lit(1.0 - alpha) * y) for x, y in zip(a, b, strict=True))


def pack(rgb: RGB, alpha: int = 255) -> Column:
    """One BIGINT: red in the low byte, alpha in the high one."""
    r, g, b = (x.cast("long") for x in rgb)
    return r + g * 256 + b * 65536 + F.lit(alpha * 16777216)


def unpack(packed: Column) -> RGB:
    return tuple(F.pmod(F.floor(packed / F.lit(256**k)), F.lit(256)).cast("int") for k in range(3))


def of_scale(scale: Column) -> RGB:
    k = F.greatest(F.lit(0), F.least(scale, F.lit(len(SCALE_COLOURS) - 1)))
    return tuple(F.element_at(F.array(*[F.lit(c[j]) for c in SCALE_COLOURS]), k + 1) for j in range(3))


def of_depth(depth: Column, low: float, high: float) -> RGB:
    """Black for no depth, grey nearer than low, white beyond high, between them from blue over green to red."""
    t = (depth - F.lit(low)) / F.lit(high - low)
    ramp = (cut(F.lit(255.0) * (F.lit(2.0) * t - 1)), cut(F.lit(255.0) * (F.lit(1.0) - F.abs(F.lit(2.0) * t - 1))), cut(F.lit(255.0) * (F.lit(1.0) - F.lit(2.0) * t)))
    return tuple(F.when(depth <= 0, F.lit(0)).when(depth < low, F.lit(64)).when(depth > high, F.lit(255)).otherwise(c).cast("int") for c in ramp)


def shade(normal: RGB, light: tuple[float, float, float], ambient: tuple[float, float, float], diffuse: RGB) -> RGB:
    """Ambient light plus a share of the surface's colour by the angle to the light."""
    along = F.greatest(normal[0] * F.lit(light[0]) + normal[1] * F.lit(light[1]) + normal[2] * F.lit(light[2]), F.lit(0.0))
    return tuple(cut((F.lit(a) + along) * d) for a, d in zip(ambient, diffuse, strict=True))
