"""Occupancy from LiDAR rays: every ray updates the voxels between the sensor and a little behind its end.

Rays are marched at the finest scale. A straight ray enters a voxel once, so "one update for
each voxel in turn" compares a sample's voxel with the one before, without a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensors import norm
from . import fusion
from .fusion import SHIFT, VoxelMap


@dataclass(frozen=True)
class RayModel:
    """A ray's surface: thickness and deviation grow with its length, between multiples of the voxel's size."""

    near: float = 0.1
    far: float = 10.0
    k_tau: float = 0.026
    tau: tuple[float, float] = (6.0, 16.0)
    k_sigma: float = 0.052
    sigma: tuple[float, float] = (1.5, 6.0)

    def thickness(self, n: Column, res: float) -> Column:
        return _clamp(F.lit(self.k_tau) * n, self.tau, res)

    def three_sigma(self, n: Column, res: float) -> Column:
        return F.lit(3.0) * _clamp(F.lit(self.k_sigma) * n, self.sigma, res)


def _clamp(x: Column, to: tuple[float, float], res: float) -> Column:
    return F.greatest(F.lit(to[0] * res), F.least(x, F.lit(to[1] * res)))


def aimed(rays: DataFrame, vmap: VoxelMap, model: RayModel) -> DataFrame:
    """Rays (scan, seq, x, y, z in the sensor's frame) with n, tau, s, their direction ux, uy, uz, the sensor's place px, py, pz and the number of half-voxel steps.

    Poses are the columns tx, ty, tz and qw to qz, if there are any; else the sensor is at
    the origin. Rays shorter than the near plane, or with null or infinite ends, and rays
    that start outside the map give nothing.
    """
    rows = fusion.posed(rays).withColumn("n", norm((F.col("x"), F.col("y"), F.col("z"))))
    rows = rows.filter((F.col("n") >= model.near) & (F.col("n") < math.inf))
    unit = fusion.to_world(rows, tuple(F.col(c) / F.col("n") for c in "xyz"))
    start = [F.col(c) if c in rows.columns else F.lit(0.0) for c in SHIFT]
    tau, n = model.thickness(F.col("n"), vmap.res), F.col("n")
    rows = rows.select("scan", "seq", "n", tau.alias("tau"), model.three_sigma(n, vmap.res).alias("s"), *[u.alias(f"u{c}") for u, c in zip(unit, "xyz", strict=True)], *[p.alias(f"p{c}") for p, c in zip(start, "xyz", strict=True)])
    rows = fusion.settle(rows, "n", "tau", "s", "ux", "uy", "uz", "px", "py", "pz")
    steps = F.ceil((F.least(n + F.col("tau"), F.lit(model.far)) - model.near) / F.lit(0.5 * vmap.res)).cast("int")
    return rows.filter(vmap.inside(*_at(F.lit(0), vmap, model))).withColumn("steps", steps).filter("steps > 0")


def _at(k: Column, vmap: VoxelMap, model: RayModel) -> list[Column]:
    return [F.col(f"u{c}") * (F.lit(model.near) + k * F.lit(0.5 * vmap.res)) + F.col(f"p{c}") for c in "xyz"]


def marched(rays: DataFrame, vmap: VoxelMap, model: RayModel) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Rays (see aimed) with k for each half-voxel step, up to where they leave the map; and the number of the voxel at a step."""

    def voxel(k: Column) -> Column:
        x, y, z = (vmap.voxel(p).cast("long") for p in _at(k, vmap, model))
        return (z * vmap.size + y) * vmap.size + x

    rows = aimed(rays, vmap, model)
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).filter(vmap.inside(*_at(F.col("k"), vmap, model))), voxel


def behind(vmap: VoxelMap, model: RayModel) -> Column:
    """How far step k lies behind the ray's end."""
    return F.lit(model.near) + F.col("k") * F.lit(0.5 * vmap.res) - F.col("n")


def log_odds(vmap: VoxelMap, model: RayModel) -> Column:
    """What step k says of its voxel; null beyond the surface."""
    value = fusion.inverse_sensor_model(behind(vmap, model), F.col("tau"), F.col("s"))
    return F.when(value.isNotNull(), F.least(value, F.lit(fusion.LOG_ODD_MAX)))


def updates(rays: DataFrame, vmap: VoxelMap, model: RayModel) -> DataFrame:
    """scan, seq, v, value: the log-odds that each ray (see marched) gives a voxel."""
    rows, voxel = marched(rays, vmap, model)
    rows = rows.select("scan", "seq", "n", "tau", "s", "k", voxel(F.col("k")).alias("v"), voxel(F.col("k") - 1).alias("before"))
    rows = rows.filter((F.col("k") == 0) | (F.col("v") != F.col("before")))
    return rows.select("scan", "seq", "v", log_odds(vmap, model).alias("value")).filter("value is not null")


def segments(rows: DataFrame, by: str, segment: list[str], order: str, value: str, max_weight: int) -> DataFrame:
    """by, segment, n, head, tail: each pair of by and segment folded alone, into its first max_weight values and the faded sum of the others."""
    w, fade = max_weight, F.lit((max_weight - 1) / max_weight)
    x = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value])
    parts = rows.groupBy(by, *segment).agg(x.alias("x"))
    tail = F.aggregate(F.slice("x", w + 1, F.greatest(F.size("x") - w, F.lit(0))), F.lit(0.0), lambda s, v: s * fade + v)
    return parts.select(by, *segment, F.size("x").cast("long").alias("n"), F.slice("x", 1, w).alias("head"), tail.alias("tail"))


def joined_mean(parts: DataFrame, by: str, segment: list[str], max_weight: int) -> DataFrame:
    """by, mean, weight: the clamped running mean over segments() in the order of segment."""
    w, fade = max_weight, F.lit((max_weight - 1) / max_weight)

    def plain(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def faded(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s * fade + v)

    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("n").over(group.orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"before": before, "all": F.sum("n").over(group)})
    first = F.greatest(F.lit(0), F.least(F.size("head").cast("long"), w - F.col("before"))).cast("int")
    rest = F.slice("head", first + 1, F.size("head") - first)
    later = faded(rest) * F.pow(fade, F.col("n") - F.size("head")) + F.col("tail")
    early = plain(F.slice("head", F.lit(1), first)) * F.pow(fade, F.greatest(F.col("all") - w, F.lit(0))) / F.least(F.col("all"), F.lit(w))
    share = early + later * F.pow(fade, F.col("all") - F.col("before") - F.col("n")) / F.lit(w)
    return parts.withColumn("share", share).groupBy(by).agg(F.sum("share").alias("mean"), F.least(F.sum("n"), F.lit(w)).cast("int").alias("weight"))


def segmented_mean(rows: DataFrame, by: str, segment: list[str], order: str, value: str, max_weight: int) -> DataFrame:
    """by, mean, weight: the clamped running mean of groups that may be very large.

    segment, then order, is the order of the rows; a pair of by and segment holds few rows.
    Each is folded alone first, so the window over a group sees one row a segment.
    """
    return joined_mean(segments(rows, by, segment, order, value, max_weight), by, segment, max_weight)


def fuse(rays: DataFrame, vmap: VoxelMap, model: RayModel | None = None, per_segment: int = 4096) -> DataFrame:
    """(vx, vy, vz, occupancy, weight) of every voxel that a ray passes or ends in, folded by scan and seq.

    Voxels by the sensor lie on all rays: they are folded by segments of per_segment rays of
    a scan first, on as many tasks as there are segments.
    """
    rows = updates(rays, vmap, model or RayModel()).withColumn("part", F.floor(F.col("seq") / per_segment))
    out = segmented_mean(rows, "v", ["scan", "part"], "seq", "value", fusion.occupancy_max_weight())
    return out.select(*fusion.voxel_of(F.col("v"), vmap), F.col("mean").alias("occupancy"), "weight")
