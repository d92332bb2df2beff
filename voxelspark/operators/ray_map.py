"""Occupancy from LiDAR rays at all scales: batches of rays update blocks that are each at a scale of their own.

A batch asks each block that it passes for a scale: by the distance from the sensor, at
least free_scale where the ray is still in free space, the finest that any sample asks for.
A block keeps its scale within the hysteresis, else its voxels are averaged to a coarser
one or handed down to a finer one before the batch is integrated. At scale s a ray is
sampled at every 2^s-th of its half-voxel steps. Rays are dealt by ranges of (scan, seq), and
many are marched at once: a task folds its samples for every scale that a block may take, a
voxel and run of rays at a time. Only these are shuffled, and those of the blocks' scales
joined for each voxel, whatever the rays' order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sensors import Lidar
from . import fusion, ray_fusion
from .fusion import VoxelMap
from .ray_fusion import RayModel

TOP = 3
#: A voxel of a map: block, its scale, number of the voxel's lower corner, mean log-odds and weight.
STATE = "b long, scale int, v long, occupancy double, weight int"
#: Rays, and steps of them, that are marched and folded at once.
PER_SEGMENT, STEPS = 1 << 16, 1 << 19


@dataclass(frozen=True)
class RayMap:
    """What a map of rays is made with; free_scale is the finest scale of free space."""

    vmap: VoxelMap = field(default_factory=VoxelMap)
    lidar: Lidar = field(default_factory=lambda: Lidar.leica(0.35, 0.35))
    model: RayModel = field(default_factory=RayModel)
    free_scale: int = 1

    @property
    def side(self) -> int:
        """Blocks along an edge of the map."""
        return -(-self.vmap.size // self.vmap.block)

    def coordinates(self, v: Column) -> list[Column]:
        n = self.vmap.size
        return [v % n, F.floor(v / n) % n, F.floor(v / (n * n))]

    def number(self, at: list[Column]) -> Column:
        n = self.vmap.size
        return (at[2] * n + at[1]) * n + at[0]

    def block(self, v: Column) -> Column:
        x, y, z = (F.floor(c / self.vmap.block) for c in self.coordinates(v))
        return (z * self.side + y) * self.side + x

    def corner(self, v: Column, scale: Column) -> Column:
        """The number of the lower corner of the voxel at scale that holds voxel v."""
        step = F.call_function("shiftleft", F.lit(1), scale).cast("long")
        return self.number([F.floor(c / step) * step for c in self.coordinates(v)])

    def centre(self, b: Column) -> list[Column]:
        """The middle of a block in the world."""
        n, edge = self.side, self.vmap.block
        at = [b % n, F.floor(b / n) % n, F.floor(b / (n * n))]
        return [(c * edge + F.lit(edge / 2)) * F.lit(self.vmap.res) - F.lit(self.vmap.dim / 2) for c in at]

    def wanted(self, free: Column, surface: Column, last: Column) -> Column:
        """A block's scale for the least distances at which free space and a surface were sampled in it; last is null where it has none."""
        last = F.coalesce(last, F.lit(-1))
        ask = lambda d: self.lidar.scale(d, self.vmap.res, last, TOP)
        return F.least(F.when(surface.isNotNull(), ask(surface)), F.when(free.isNotNull(), F.greatest(ask(free), F.lit(self.free_scale)))).cast("int")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def dealt(rays: DataFrame, how: RayMap) -> DataFrame:
    """Rays (see ray_fusion.aimed) in ranges of (scan, seq), in that order."""
    rows = ray_fusion.aimed(rays, how.vmap, how.model)
    rows = rows.repartitionByRange(int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scan", "seq")
    return rows.sortWithinPartitions("scan", "seq", "n", "ux", "uy", "uz", "px", "py", "pz")


def _segments(batches: Iterator[pa.RecordBatch], per_segment: int) -> Iterator[pa.Table]:
    """Runs of rays (see dealt), of at most per_segment rays and of STEPS steps, if it is more than one ray."""
    held, rays, steps = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(batch.column("steps").to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(total[start - 1]) if start else 0
            end = min(int(np.searchsorted(total, before + STEPS - steps, side="right")), start + per_segment - rays)
            end = max(end, start if held else start + 1)
            if end > start:
                held.append(batch.slice(start, end - start))
                rays, steps, start = rays + end - start, steps + int(total[end - 1]) - before, end
            if start < batch.num_rows or rays >= per_segment:
                yield pa.Table.from_batches(held)
                held, rays, steps = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _samples(rays: pa.Table, how: RayMap) -> dict[str, np.ndarray]:
    """b, ray (its row), at (coordinates), value, fresh, free: steps of rays, in order, that some scale takes.

    fresh has bit s where scale s takes the step: it is a multiple of 2^s and in another
    voxel than the one before.
    """
    vmap, model, low = how.vmap, how.model, float(fusion.LOG_ODD_MIN)
    of = {c: rays.column(c).to_numpy() for c in ("n", "tau", "s", "ux", "uy", "uz", "px", "py", "pz", "steps")}
    steps = of["steps"].astype(np.int64)
    ray = np.repeat(np.arange(len(steps)), steps)
    k = np.arange(len(ray)) - np.repeat(np.cumsum(steps) - steps, steps)
    along = model.near + k * (0.5 * vmap.res)
    inside, at = np.ones(len(ray), dtype=bool), []
    for c in "xyz":
        p = of[f"u{c}"][ray] * along + of[f"p{c}"][ray] + vmap.dim / 2
        inside &= (p >= 0) & (p < vmap.dim)
        # Beyond the map a number doesn't matter, but it has to be one.
        at.append((np.clip(p, -vmap.res, vmap.dim + vmap.res) / vmap.res).astype(np.int64))
    v = (at[2] * vmap.size + at[1]) * vmap.size + at[0]
    fresh = np.zeros(len(ray), dtype=np.int64)
    for s in range(TOP + 1):
        takes = np.flatnonzero(k % (1 << s) == 0)
        takes = takes[(k[takes] < 1 << s) | (v[takes] != v[takes - (1 << s)])]
        fresh[takes] |= 1 << s
    x, tau, sigma = along - of["n"][ray], of["tau"][ray], of["s"][ray]
    keep = np.flatnonzero(inside & (x < tau) & (fresh > 0))
    x, tau, sigma, at = x[keep], tau[keep], sigma[keep], [c[keep] for c in at]
    value = np.where(x <= -sigma, low, np.where(x < tau / 2, -low * x / sigma, -low * tau / (2.0 * sigma)))
    block = [c // vmap.block for c in at]
    return {"b": (block[2] * how.side + block[1]) * how.side + block[0], "ray": ray[keep], "at": np.stack(at), "value": np.minimum(value, fusion.LOG_ODD_MAX), "fresh": fresh[keep], "free": x < -sigma}


def _passed(rays: pa.Table, how: RayMap) -> pa.RecordBatch:
    """(b, near, surface): blocks of samples, with the least distances from the sensor to the block's middle at which they are free and not."""
    rows = _samples(rays, how)
    away = np.zeros(len(rows["b"]))
    for c, name in zip(rows["at"], "xyz", strict=True):
        d = (c // how.vmap.block * how.vmap.block + how.vmap.block / 2) * how.vmap.res - how.vmap.dim / 2 - rays.column(f"p{name}").to_numpy()[rows["ray"]]
        away += d * d
    away = np.sqrt(away)
    b, of = np.unique(rows["b"], return_inverse=True)
    least = []
    for which in (rows["free"], ~rows["free"]):
        out = np.full(len(b), np.inf)
        np.minimum.at(out, of[which], away[which])
        least.append(pa.array(out, mask=np.isinf(out)))
    return pa.RecordBatch.from_arrays([pa.array(b), *least], names=["b", "near", "surface"])


def _folded(rays: pa.Table, how: RayMap, w: int) -> Iterator[pa.RecordBatch]:
    """(b, scale, key, scan, seq, n, head, tail): a segment's values of each voxel at each scale, as ray_fusion.segments() has them, with its first ray."""
    rows, fade, n = _samples(rays, how), (w - 1) / w, how.vmap.size
    for s in range(TOP + 1):
        takes = np.flatnonzero(rows["fresh"] >> s & 1)
        if not len(takes):
            continue
        x, y, z = (c[takes] >> s << s for c in rows["at"])
        key = ((z * n + y) * n + x) * (TOP + 1) + s
        order = np.argsort(key, kind="stable")
        key, value = key[order], rows["value"][takes][order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        i = np.arange(len(key)) - np.repeat(first, count)
        late = np.where(i >= w, value * fade ** (np.repeat(count, count) - 1 - i), 0.0)
        ends = np.r_[0, np.cumsum(np.minimum(count, w))].astype(np.int32)
        head = pa.ListArray.from_arrays(pa.array(ends), pa.array(value[i < w]))
        whole = [pa.array([rays.column(c)[0].as_py()] * len(first), pa.int64()) for c in ("scan", "seq")]
        cols = [pa.array(rows["b"][takes][order][first]), pa.array(np.full(len(first), s, dtype=np.int32)), pa.array(key[first]), *whole, pa.array(count), head, pa.array(np.add.reduceat(late, first))]
        yield pa.RecordBatch.from_arrays(cols, names=["b", "scale", "key", "scan", "seq", "n", "head", "tail"])


def touched(rows: DataFrame, state: DataFrame, how: RayMap) -> DataFrame:
    """(b, last, scale): the blocks that rays (see dealt) pass, the scale they have (null: none) and the one that they take."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rays in _segments(batches, PER_SEGMENT):
            yield _passed(rays, how)

    near = rows.mapInArrow(passed, "b long, near double, surface double").groupBy("b").agg(F.min("near").alias("near"), F.min("surface").alias("surface"))
    old = state.groupBy("b").agg(F.first("scale").alias("last"))
    return near.join(old, "b", "left").select("b", "last", how.wanted(F.col("near"), F.col("surface"), F.col("last")).alias("scale"))


def rescaled(state: DataFrame, how: RayMap) -> DataFrame:
    """(v, scale, occupancy, weight) of voxels (last, scale, v, occupancy, weight) brought from scale last to scale.

    Finer voxels take what the coarse one had; a coarse one takes the mean of its observed
    children and the mean of their weights, rounded up, level by level.
    """
    names = ["v", "scale", "occupancy", "weight"]
    out = state.filter("scale = last").select(*names)
    d = F.col("last") - F.col("scale")
    one = F.call_function("shiftleft", F.lit(1), d).cast("long")
    step = F.call_function("shiftleft", F.lit(1), F.col("scale")).cast("long")
    down = state.filter("scale < last").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), one * one * one - 1)))
    n = how.vmap.size
    offset = ((F.floor(F.col("i") / (one * one)) * n + F.floor(F.col("i") / one) % one) * n + F.col("i") % one) * step
    out = out.unionByName(down.select((F.col("v") + offset).alias("v"), *names[1:]))
    up = state.filter("scale > last").select(*names, "last")
    for s in range(TOP):
        here = up.filter(F.col("last") == s).withColumn("v", how.corner(F.col("v"), F.lit(s + 1)))
        here = here.groupBy("v", "scale").agg(F.avg("occupancy").alias("occupancy"), F.ceil(F.avg("weight")).cast("int").alias("weight"))
        out = out.unionByName(here.filter(F.col("scale") == s + 1).select(*names))
        up = up.filter(F.col("last") > s).unionByName(here.filter(F.col("scale") > s + 1).withColumn("last", F.lit(s + 1)))
    return out


def changes(state: DataFrame, rays: DataFrame, how: RayMap, per_segment: int = PER_SEGMENT) -> DataFrame:
    """The blocks that a batch of rays touches, as they are after it (b, scale, v, occupancy, weight).

    rays as in ray_fusion.aimed, folded by scan and seq. Voxels by the sensor lie on all
    rays; their values are folded by segments of at most per_segment rays first. A voxel's
    state counts as its weight's many values before the first.
    """
    rows, w = dealt(rays, how), fusion.occupancy_max_weight()
    blocks = touched(rows, state, how)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment in _segments(batches, per_segment):
            yield from _folded(segment, how, w)

    # A voxel and its scale in one number.
    key = lambda v: (v * (TOP + 1) + F.col("scale")).alias("key")
    parts = rows.mapInArrow(folded, "b long, scale int, key long, scan long, seq long, n long, head array<double>, tail double")
    parts = parts.join(blocks.select("b", "scale"), ["b", "scale"]).select("key", "scan", "seq", "n", "head", "tail")
    old = rescaled(state.drop("scale").join(blocks.filter("last is not null"), "b"), how)
    none = F.lit(None).cast("long")
    old = old.select(key(F.col("v")), none.alias("scan"), none.alias("seq"), F.col("weight").cast("long").alias("n"), F.array_repeat("occupancy", F.col("weight")).alias("head"), F.lit(0.0).alias("tail"))
    out = ray_fusion.joined_mean(parts.unionByName(old), "key", ["scan", "seq"], w)
    out = out.select(F.floor(F.col("key") / (TOP + 1)).alias("v"), (F.col("key") % (TOP + 1)).cast("int").alias("scale"), F.col("mean").alias("occupancy"), "weight")
    return out.select(how.block(F.col("v")).alias("b"), "scale", "v", "occupancy", "weight")


def levels(state: DataFrame, how: RayMap) -> DataFrame:
    """(scale, v, low, high, observed): octants above the voxels of a map, up to its root.

    low and high are the least and greatest mean log-odds times weight below, observed says
    that every voxel below has been; v numbers lower corners. One aggregate over the voxels,
    combined before its shuffle.
    """
    root = how.vmap.size.bit_length() - 1
    rows = state.withColumn("at", F.explode(F.sequence(F.col("scale") + 1, F.lit(root))))
    held, whole = F.col("occupancy") * F.col("weight"), lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (s * 3).cast("int"))
    rows = rows.select(F.col("at").alias("scale"), how.corner(F.col("v"), F.col("at")).alias("v"), held.alias("held"), whole(F.col("scale")).alias("n"))
    out = rows.groupBy("scale", "v").agg(F.min("held").alias("low"), F.max("held").alias("high"), F.sum("n").alias("n"))
    return out.select("scale", "v", "low", "high", (F.col("n") == whole(F.col("scale"))).alias("observed"))
