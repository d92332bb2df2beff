"""Pinhole and LiDAR models as Column functions; intrinsics and poses become literals."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def norm(p: Point) -> Column:
    return F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])


def dot(n, p: Point) -> Column:
    return p[0] * F.lit(float(n[0])) + p[1] * F.lit(float(n[1])) + p[2] * F.lit(float(n[2]))


def transform(pose: np.ndarray, p: Point) -> Point:
    """A rigid transform (4x4) of a point."""
    return tuple(p[0] * F.lit(float(r[0])) + p[1] * F.lit(float(r[1])) + p[2] * F.lit(float(r[2])) + F.lit(float(r[3])) for r in pose[:3])


def pixel(u: Column) -> Column:
    """The pixel that a projected coordinate falls on: half a pixel added, then cut off."""
    return (u + F.lit(0.5)).cast("int")


@dataclass(frozen=True)
class Pinhole:
    """A pinhole camera: measurements are along z."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    near: float = 0.1
    far: float = 10.0

    def downsampled(self, by: int) -> Pinhole:
        """The camera of images that are smaller by a factor in both directions."""
        return replace(self, fx=self.fx / by, fy=self.fy / by, cx=(self.cx + 0.5) / by - 0.5, cy=(self.cy + 0.5) / by - 0.5, width=self.width // by, height=self.height // by)

    @property
    def left_handed(self) -> bool:
        return (self.fx < 0) != (self.fy < 0)

    @property
    def fov(self) -> tuple[float, float]:
        """Horizontal and vertical opening angles in radians."""
        return 2 * float(np.arctan(self.width / (2 * abs(self.fx)))), 2 * float(np.arctan(self.height / (2 * abs(self.fy))))

    def project(self, p: Point) -> tuple[Column, Column, Column]:
        """(u, v, ok): image coordinates, and whether they are in front of the camera and in the image."""
        u, v = p[0] * F.lit(self.fx) / p[2] + F.lit(self.cx), p[1] * F.lit(self.fy) / p[2] + F.lit(self.cy)
        ok = (p[2] > 0) & (u >= -0.5) & (u < self.width - 0.5) & (v >= -0.5) & (v < self.height - 0.5)
        return u, v, ok

    def ray(self, x: Column, y: Column) -> Point:
        """The point at z = 1 that a pixel sees."""
        return (x - F.lit(self.cx)) / F.lit(self.fx), (y - F.lit(self.cy)) / F.lit(self.fy), F.lit(1.0)

    def planes(self) -> np.ndarray:
        """(6, 4): inward unit normals and offsets of left, right, top, bottom, near and far."""
        sx, sy = np.sign(self.fx), np.sign(self.fy)
        n = np.array([
            [sx * self.fx, 0, sx * self.cx, 0],
            [-sx * self.fx, 0, sx * (self.width - self.cx), 0],
            [0, sy * self.fy, sy * self.cy, 0],
            [0, -sy * self.fy, sy * (self.height - self.cy), 0],
            [0, 0, 1, -self.near],
            [0, 0, -1, self.far],
        ], dtype=float)
        return n / np.linalg.norm(n[:, :3], axis=1, keepdims=True)

    def sees_sphere(self, p: Point, radius: float | Column = 0.0, infinite: bool = False) -> Column:
        """Whether a sphere (a point for radius 0) touches the frustum; infinite leaves out the far plane."""
        r = F.lit(float(radius)) if isinstance(radius, int | float) else radius
        out = F.lit(True)
        for plane in self.planes()[: 5 if infinite else 6]:
            out = out & (dot(plane[:3], p) + F.lit(float(plane[3])) >= -r)
        return out

    def measured(self, p: Point) -> Column:
        return p[2]

    def range_of(self, ray: Point, distance: float) -> Column:
        """The distance along a ray at which its measurement is this near or far."""
        return F.lit(float(distance)) * norm(ray) / ray[2]

    def min_angle(self) -> float:
        """The angle that the narrowest pixel covers, in the small-angle approximation."""
        return 1.0 / max(abs(self.fx), abs(self.fy))

    def scale(self, distance: Column, res: float, last: Column | None = None, top: int = 3) -> Column:
        return integration_scale(distance * F.lit(self.min_angle()) / F.lit(float(res)), last, top, distance, self.min_angle() / res)


#: Pixels per voxel above which the next coarser scale is integrated; metres of hysteresis.
SCALE_STEPS, HYSTERESIS = (1.5, 3.0, 6.0), 0.25


def integration_scale(ratio: Column, last: Column | None, top: int, distance: Column, per_metre: float) -> Column:
    """The scale for a pixel-to-voxel ratio; a block that has one changes it only beyond the hysteresis."""

    def ladder(r: Column) -> Column:
        out = F.lit(0)
        for k, step in enumerate(SCALE_STEPS[:top]):
            out = F.when(r >= step, F.lit(k + 1)).otherwise(out)
        return out

    now = ladder(ratio)
    if last is None:
        return now
    moved = distance + F.when(now > last, F.lit(-HYSTERESIS)).otherwise(F.lit(HYSTERESIS))
    return F.when((last < 0) | (now == last), now).otherwise(ladder(moved * F.lit(per_metre)))


@dataclass(frozen=True)
class Lidar:
    """A scanning LiDAR: measurements are ranges; beams lie between two elevations (degrees)."""

    min_elevation: float
    max_elevation: float
    near: float = 0.5
    far: float = 100.0
    #: Smallest angle between two beams, in degrees.
    resolution: float = 0.35

    @staticmethod
    def ouster(elevations: list[float], width: int, **how) -> Lidar:
        """From beam elevations and points per turn."""
        steps = np.abs(np.diff(np.sort(elevations)))
        return Lidar(min(elevations), max(elevations), resolution=float(min(steps.min(), 360.0 / width)), **how)

    @staticmethod
    def leica(azimuth: float, elevation: float, **how) -> Lidar:
        return Lidar(-90.0, 90.0, resolution=min(azimuth, elevation), **how)

    def measured(self, p: Point) -> Column:
        return norm(p)

    def range_of(self, ray: Point, distance: float) -> Column:
        return F.lit(float(distance))

    def sees_point(self, p: Point, infinite: bool = False) -> Column:
        r = norm(p)
        elevation = F.asin(p[2] / r)
        out = (r >= self.near) & (elevation >= float(np.radians(self.min_elevation))) & (elevation <= float(np.radians(self.max_elevation)))
        return out if infinite else out & (r <= self.far)

    def sees_sphere(self, p: Point, radius: float, infinite: bool = False) -> Column:
        """Whether a sphere touches the range shell and the elevation cone."""
        r = norm(p)
        elevation = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p[2] / r)))
        low, high = float(np.radians(self.min_elevation)), float(np.radians(self.max_elevation))
        miss = F.greatest(F.lit(low) - elevation, elevation - F.lit(high), F.lit(0.0))
        shell = r + radius >= self.near if infinite else (r + radius >= self.near) & (r - radius <= self.far)
        return shell & ((r <= radius) | (F.sin(miss) * r <= radius))

    def scale(self, distance: Column, res: float, last: Column | None = None, top: int = 3) -> Column:
        per_metre = float(np.radians(self.resolution)) / res
        return integration_scale(distance * F.lit(per_metre), last, top, distance, per_metre)
