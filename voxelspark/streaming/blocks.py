"""Multi-resolution fusion: one state machine for each block, folded over its frames in order.

The scale at which a block is updated follows its distance. An occupancy block whose scale
should change fills a buffer at the new scale beside its current one, and changes over when
the buffer has enough integrations and covers enough of what was observed. A TSDF block
changes at once, by one scale at a time towards finer ones, and passes on what changed at
the coarser scale since it was last passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morton as m
from ..functions.sensors import HYSTERESIS, SCALE_STEPS, Pinhole
from ..operators import carve, free_space
from ..operators.fusion import LOG_ODD_MIN, SHIFT, TURN, VoxelMap, cropped, occupancy_max_weight, packed, parts_of, pose_columns, posed, settle, surface_samples, to_camera, visits
from ..operators.octree import BLOCK_SCALE

#: Integrations and share of the observed volume after which a buffer takes over.
BUFFER_ROUNDS, BUFFER_SHARE = 20, 0.9
#: The finest scale at which a block that is free as a whole is filled for the first time.
FREE_SCALE = 1
OUT = "bx int, by int, bz int, scale int, vx int, vy int, vz int, value double, weight int"


def scale_of(distance: float, camera: Pinhole, res: float, last: int | None, top: int = 3) -> int:
    ladder = lambda d: sum(d * camera.min_angle() / res >= s for s in SCALE_STEPS[:top])
    now = ladder(distance)
    if last is None or now == last:
        return now
    return ladder(distance - HYSTERESIS if now > last else distance + HYSTERESIS)


def up(mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of observed children and their mean weights rounded up; cubes of half the edge."""
    n = len(mean) // 2
    part = lambda a: a.reshape(n, 2, n, 2, n, 2).transpose(0, 2, 4, 1, 3, 5).reshape(n, n, n, 8)
    m, w = part(mean), part(weight)
    count = (w > 0).sum(-1)
    safe = np.maximum(count, 1)
    return np.where(count > 0, (m * (w > 0)).sum(-1) / safe, 0.0), np.where(count > 0, np.ceil(w.sum(-1) / safe), 0)


def down(a: np.ndarray) -> np.ndarray:
    return a.repeat(2, 0).repeat(2, 1).repeat(2, 2)


@dataclass
class Block:
    """Mean and weight of a block's voxels at every scale it has."""

    edge: int
    occupancy: bool
    max_weight: int
    scale: int | None = None
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    past: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    buffer: int | None = None
    rounds: int = 0

    def empty(self, scale: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.edge >> scale
        return np.full((n, n, n), 0.0 if self.occupancy else 1.0), np.zeros((n, n, n))

    def moved(self, level: tuple[np.ndarray, np.ndarray], start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """A level brought to another scale: children take their parent's data, parents the mean."""
        while start > end:
            level, start = (down(level[0]), down(level[1])), start - 1
        while start < end:
            level, start = up(*level), start + 1
        return level

    def add(self, scale: int, seen: np.ndarray, value: np.ndarray) -> None:
        """The running mean of the voxels seen (numbers, x fastest) with their new values."""
        if not len(seen):
            return
        # Levels may be shared with the past, so they are replaced, not changed.
        mean, weight = (a.copy() for a in self.levels[scale])
        m, w = mean.reshape(-1), weight.reshape(-1)
        n = np.minimum(w[seen] + 1, self.max_weight)
        m[seen], w[seen] = (m[seen] * (n - 1) + value) / n, n
        self.levels[scale] = mean, weight

    def integrate(self, scale: int, observe) -> None:
        """One frame: observe(scale) gives the values at a scale as a cube, with NaN for no observation."""

        def sparse(s: int) -> tuple[np.ndarray, np.ndarray]:
            value = observe(s).reshape(-1)
            seen = np.flatnonzero(~np.isnan(value))
            return seen, value[seen]

        self.visit(scale, sparse)

    def visit(self, scale: int, observe) -> None:
        """integrate() with observe(scale) giving the numbers of the voxels that are observed, and their values."""
        if self.scale is None:
            self.scale, self.levels[scale] = scale, self.empty(scale)
        if self.occupancy:
            self._buffered(scale, observe)
        else:
            self._change(max(scale, self.scale - 1))
            self.add(self.scale, *observe(self.scale))

    def free_scale(self, scale: int, top: int = 3) -> int:
        """The scale for a frame in which the block is free as a whole; it changes by one, but a free block may take any coarser one."""
        if self.scale is None:
            return min(max(scale, FREE_SCALE), top)
        mean, weight = self.levels[self.scale]
        free = (weight > 0).any() and mean[weight > 0].max() < 0.95 * LOG_ODD_MIN
        return min(max(scale, FREE_SCALE if free else max(0, self.scale - 1)), min(top, self.scale + 1))

    def _buffered(self, scale: int, observe) -> None:
        self.add(self.scale, *observe(self.scale))
        if scale == self.scale:
            self.buffer = None
            return
        if self.buffer != scale:
            self.buffer, self.rounds = scale, 0
            self.levels[scale] = self.moved(self.levels[self.scale], self.scale, scale)
            if scale < self.scale:
                self.levels[scale] = (self.levels[scale][0], np.minimum(self.levels[scale][1], 1))
            self.fresh = np.zeros(self.levels[scale][0].shape, dtype=bool)
        seen, value = observe(scale)
        self.add(scale, seen, value)
        self.fresh.reshape(-1)[seen] = True
        self.rounds += 1
        if self.rounds >= BUFFER_ROUNDS and self.fresh.mean() >= BUFFER_SHARE * (self.levels[self.scale][1] > 0).mean():
            self.scale, self.buffer = scale, None

    def _change(self, scale: int) -> None:
        while self.scale < scale:
            self.levels[self.scale + 1] = up(*self.levels[self.scale])
            self.past[self.scale + 1] = self.levels[self.scale + 1]
            self.scale += 1
        while self.scale > scale:
            mean, weight = self.levels[self.scale]
            old_mean, old_weight = self.past.get(self.scale, self.empty(self.scale))
            child_mean, child_weight = self.levels.get(self.scale - 1, self.empty(self.scale - 1))
            known = child_weight > 0
            shift = np.where(old_weight > 0, mean - old_mean, 0.0)
            self.levels[self.scale - 1] = (
                np.where(known, np.clip(child_mean + down(shift), -1, 1), down(mean)),
                np.where(known, np.minimum(child_weight + down(np.maximum(weight - old_weight, 0)), self.max_weight), down(weight)),
            )
            self.past[self.scale] = (mean, weight)
            self.scale -= 1


#: Visits of a block that are projected at once.
CHUNK = 64


class Sight:
    """What a batch of visits observes: at(row)(scale) gives the voxels' numbers and values of one of them.

    Visits of the same block that follow are mostly observed at the same scale, so a chunk of
    them is projected when its first one is asked for. Visits without an image see nothing.
    The visits' parts of images (see fusion.cropped) lie in image one after another, each from first on.
    """

    def __init__(self, block: np.ndarray, shift: np.ndarray, turn: np.ndarray | None, image: np.ndarray, first: np.ndarray, x0: np.ndarray, y0: np.ndarray, wide: np.ndarray, camera: Pinhole, vmap: VoxelMap, occupancy: bool, sigma: float, tau: float):
        self.block, self.shift, self.turn, self.image, self.first = block, shift, turn, image, first
        self.x0, self.y0, self.wide = x0, y0, wide
        self.camera, self.vmap, self.occupancy, self.sigma, self.tau = camera, vmap, occupancy, sigma, tau
        self.known: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        #: The visits with an image, and for each visit how many of them come before it.
        self.some = np.flatnonzero(np.diff(np.r_[first, len(image)]))
        self.before = np.searchsorted(self.some, np.arange(len(block))).tolist()

    def at(self, row: int, end: int):
        """observe(scale) for a visit; the block's visits end before end."""
        k = self.before[row]
        nothing = k == len(self.some) or self.some[k] != row

        def observe(scale: int) -> tuple[np.ndarray, np.ndarray]:
            if nothing:
                return _NONE
            known = self.known.setdefault(scale, {})
            if row not in known:
                rows = self.some[k : k + CHUNK]
                known.clear()
                known.update(self._project(rows[rows < end], scale))
            return known[row]

        return observe

    def _project(self, rows: np.ndarray, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        vmap, camera = self.vmap, self.camera
        n, stride = vmap.block >> scale, 1 << scale
        corner = self.block[rows[0]].astype(np.int64) * vmap.block
        at = [(corner[k] + np.arange(n) * stride + stride / 2) * vmap.res - vmap.dim / 2 - self.shift[rows, k][:, None] for k in range(3)]
        # Voxels have x fastest.
        full = (len(rows), n, n, n)
        x, y, z = (np.broadcast_to(a, full) for a in (at[0][:, None, None, :], at[1][:, None, :, None], at[2][:, :, None, None]))
        if self.turn is not None:
            r = self.turn[rows][:, :, :, None, None, None]
            x, y, z = (r[:, 0, k] * x + r[:, 1, k] * y + r[:, 2, k] * z for k in range(3))
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = x * camera.fx / z + camera.cx, y * camera.fy / z + camera.cy
            hit = np.flatnonzero((z > 0) & (z <= camera.far) & (u >= -0.5) & (u < camera.width - 0.5) & (v >= -0.5) & (v < camera.height - 0.5))
        x, y, z, u, v = (a.reshape(-1)[hit] for a in (x, y, z, u, v))
        own = hit // n**3
        r = rows[own]
        d = self.image[self.first[r] + ((v + 0.5).astype(np.int64) - self.y0[r]) * self.wide[r] + (u + 0.5).astype(np.int64) - self.x0[r]]
        sdf = (d - z) / z * np.sqrt(x * x + y * y + z * z)
        if self.occupancy:
            behind, tau, three = -sdf, self.tau, 3 * self.sigma
            keep = (d >= camera.near) & (behind < tau)
            value = np.where(behind < tau / 2, -LOG_ODD_MIN * behind / three, -LOG_ODD_MIN * tau / (2 * three))
            value = np.where(behind <= -three, LOG_ODD_MIN, value)
        else:
            keep = (d >= camera.near) & (sdf >= -vmap.boundary)
            value = np.minimum(sdf / vmap.boundary, 1)
        own, voxel, value = own[keep], hit[keep] % n**3, value[keep]
        cuts = np.searchsorted(own, np.arange(len(rows) + 1)).tolist()
        return {row: (voxel[a:b], value[a:b]) for row, a, b in zip(rows.tolist(), cuts, cuts[1:], strict=False)}


_NONE = np.empty(0, dtype=np.int64), np.empty(0)


def fuse(pixels: DataFrame, poses: DataFrame, camera: Pinhole, vmap: VoxelMap, occupancy: bool = True, sigma: float = 0.05, tau: float = 0.2) -> DataFrame:
    """fuse_frames() of pixels (frame, x, y, depth) and poses."""
    return fuse_frames(packed(pixels, poses, camera), camera, vmap, occupancy, sigma, tau)


def fuse_frames(frames: DataFrame, camera: Pinhole, vmap: VoxelMap, occupancy: bool = True, sigma: float = 0.05, tau: float = 0.2) -> DataFrame:
    """(bx, by, bz, scale, vx, vy, vz, value, weight): blocks at the scale they end up with.

    value is the mean log-odds, or the truncated distance. Observed voxels only; vx.. are
    their lower corners. Visits are sorted by block and frame and folded as they come, so a
    task holds one block's state and one batch, however many frames see the block; with a
    visit goes only the part of the image that the block covers.
    """
    frames = posed(frames)
    return fuse_visits(visits(surface_samples(frames, camera, vmap), frames, camera, vmap), frames, camera, vmap, occupancy, sigma, tau)


def fuse_carved(frames: DataFrame, camera: Pinhole, vmap: VoxelMap, folder: str, sigma: float = 0.05, tau: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """An occupancy map with free space in octants of any size: its nodes (key, occupancy, weight) and its blocks' voxels.

    Frames are carved (carve.carve_frames()). Nodes above the blocks are freed as they are and split
    where another frame needs their blocks; a block is updated by the frames that need it and
    freed by those that found it, or a node around it, free. Voxels as in fuse_frames(). What
    was carved and the leaves are read by several jobs, so they become tables in folder.
    """
    spark = frames.sparkSession

    frames, top = posed(frames), vmap.size.bit_length() - 1
    free_space.visits_of(carve.carve_frames(frames, camera, vmap, sigma, tau)).write.parquet(f"{folder}/visits")
    visited = spark.read.parquet(f"{folder}/visits")
    free_space.leaves(visited, top).write.parquet(f"{folder}/leaves")
    leaf = spark.read.parquet(f"{folder}/leaves")
    small = m.key_scale(F.col("key")) == BLOCK_SCALE
    here = leaf.filter(small).join(visited.filter("value is null"), "key").select("key", "frame", F.lit(False).alias("free"))
    freed = free_space.history(leaf.filter(small), visited.filter("value is not null"), top).select("key", "frame", F.lit(True).alias("free"))
    at = dict(zip("xyz", m.key_coord(F.col("key")), strict=True))
    seen = here.unionByName(freed).select("frame", "free", *[(v / vmap.block).cast("int").alias(f"b{c}") for c, v in at.items()])
    seen = settle(seen, "bx", "by", "bz").join(frames.select("frame", *pose_columns(frames)), "frame")
    state = free_space.update(spark.createDataFrame([], free_space.STATE), visited, top)
    return state.filter(~small), fuse_visits(seen, frames, camera, vmap, True, sigma, tau)


def fuse_visits(seen: DataFrame, frames: DataFrame, camera: Pinhole, vmap: VoxelMap, occupancy: bool = True, sigma: float = 0.05, tau: float = 0.2) -> DataFrame:
    """fuse_frames() of given visits (bx, by, bz, frame, pose); with a column free, the frame found the block free as a whole."""
    # A block that lies further behind all of its part of the image than anything is observed needs no image.
    reach = math.sqrt(3) / 2 * vmap.block * vmap.res + (tau if occupancy else vmap.boundary)
    ahead = to_camera(seen, tuple((F.col(f"b{c}") * vmap.block + F.lit(vmap.block / 2)) * F.lit(vmap.res) - F.lit(vmap.dim / 2) for c in "xyz"))[2]
    rows = cropped(seen.withColumn("ahead", ahead), frames, camera, vmap)
    hidden = F.coalesce(F.col("ahead") - F.lit(reach) > F.col("most"), F.lit(False))
    rows = rows.withColumn("depth", F.when(~hidden, F.col("depth"))).drop("ahead", "most")
    if "free" in seen.columns:
        rows = rows.withColumn("depth", F.when(~F.col("free"), F.col("depth")))
    weight, turned, carved = occupancy_max_weight() if occupancy else vmap.max_weight, "r00" in rows.columns, "free" in rows.columns
    shifts, turns = list(SHIFT), list(TURN)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None

        def finish() -> pa.RecordBatch:
            mean, w = block.levels[block.scale]
            z, y, x = np.nonzero(w)
            stride, n = 1 << block.scale, len(z)
            whole = [np.full(n, v, dtype=np.int32) for v in (*key, block.scale)]
            at = [(key[k] * vmap.block + c * stride).astype(np.int32) for k, c in enumerate((x, y, z))]
            return pa.record_batch([pa.array(c) for c in (*whole, *at, mean[z, y, x], w[z, y, x].astype(np.int32))], names=[c.split()[0] for c in OUT.split(", ")])

        for batch in batches:
            col = lambda c, batch=batch: batch.column(c).to_numpy(zero_copy_only=False)
            at, shift = np.stack([col(c) for c in ("bx", "by", "bz")], 1), np.stack([col(c) for c in shifts], 1)
            turn = np.stack([col(c) for c in turns], 1).reshape(-1, 3, 3) if turned else None
            whole_free = (col("free") if carved else np.zeros(batch.num_rows, dtype=bool)).tolist()
            x0, y0, wide = (col(c).astype(np.int64) for c in ("x0", "y0", "wide"))
            image, first = parts_of(batch.column("depth"))
            image = np.nan_to_num(image)
            sight = Sight(at, shift, turn, image, first, x0, y0, wide, camera, vmap, occupancy, sigma, tau)
            centre = (at.astype(np.int64) * vmap.block + vmap.block / 2) * vmap.res - vmap.dim / 2 - shift
            away = (centre[:, 2] if turn is None else turn[:, 0, 2] * centre[:, 0] + turn[:, 1, 2] * centre[:, 1] + turn[:, 2, 2] * centre[:, 2]).tolist()
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)]).tolist() if len(at) else []
            for start, end in zip(starts, [*starts[1:], len(at)], strict=True):
                if key != tuple(at[start].tolist()):
                    if block is not None:
                        yield finish()
                    key, block = tuple(at[start].tolist()), Block(vmap.block, occupancy, weight)
                for k in range(start, end):
                    scale = scale_of(away[k], camera, vmap.res, block.scale)
                    if whole_free[k]:
                        block.visit(block.free_scale(scale), lambda s: (np.arange((vmap.block >> s) ** 3), LOG_ODD_MIN))
                        continue
                    block.visit(scale, sight.at(k, end))
        if block is not None:
            yield finish()

    order = ["bx", "by", "bz", "frame"]
    # Visits are small and their work is not: their number of tasks must not follow their size.
    parts = 4 * int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bx", "by", "bz").sortWithinPartitions(*order).mapInArrow(fold, OUT)
