"""Casting rays through a voxel table, as sampled joins: rays (id, ox, oy, oz, dx, dy, dz), in voxels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sensors import norm
from .fusion import settle
from .voxels import CUBE, based, cubes, gradient, trilinear

XYZ = ("x", "y", "z")


def entry_distance(size: float, far: float) -> Column:
    """Where a ray enters the cube [0, size): 0 from inside, null if it misses or enters beyond far."""
    near, out = F.lit(0.0), F.lit(float("inf"))
    hits = F.lit(True)
    for c in XYZ:
        o, d = F.col(f"o{c}"), F.col(f"d{c}")
        a, b = F.try_divide(F.lit(0.0) - o, d), F.try_divide(F.lit(size) - o, d)
        near = F.greatest(near, F.when(d != 0, F.least(a, b)).otherwise(F.lit(0.0)))
        out = F.least(out, F.when(d != 0, F.greatest(a, b)).otherwise(F.lit(float("inf"))))
        hits = hits & ((d != 0) | ((o >= 0) & (o < size)))
    return F.when(hits & (near <= out) & (near <= far), near)


def _crossing(o: Column, d: Column, block: int, plane: Column) -> Column:
    return (plane * F.lit(block) - o) / d


def blocks_on_ray(rays: DataFrame, far: float, block: int = 8) -> DataFrame:
    """(id, n, bx, by, bz): every block that a ray passes within far, in order, however briefly.

    A ray changes its block where it crosses a plane of an axis, so the crossings of each
    axis are listed, the lists merged in order, and the middle of each stretch between two
    of them lies in its block. A stretch without length is none.
    """
    cuts = [F.array(F.lit(0.0), F.lit(float(far)))]
    for c in XYZ:
        o, d = F.col(f"o{c}"), F.col(f"d{c}")
        ends = (F.floor((o + e) / block) for e in (F.lit(0.0), d * F.lit(float(far))))
        a, b = ends
        planes = F.sequence(F.least(a, b), F.greatest(a, b) + 1)
        at = F.transform(planes, partial(_crossing, o, d, block))
        cuts.append(F.when(d != 0, F.filter(at, lambda t: (t > 0) & (t < float(far)))).otherwise(F.array().cast("array<double>")))
    rows = rays.withColumn("cuts", F.array_sort(F.array_distinct(F.concat(*cuts))))
    rows = rows.select(*rays.columns, "cuts", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)).alias("n"))
    middle = (F.get("cuts", F.col("n") - 1) + F.get("cuts", F.col("n"))) / 2
    rows = rows.select("id", "n", *[F.floor((F.col(f"o{c}") + middle * F.col(f"d{c}")) / block).cast("int").alias(f"b{c}") for c in XYZ])
    return rows


#: Fixed value: at most this log-odds times weight is free space that rays skip.
FREE = -0.2


def occupied_blocks(voxels: DataFrame, value: str = "tsdf", block: int = 8) -> DataFrame:
    """(bx, by, bz): blocks where an interpolated value may be above 0, with those below them in any axis.

    A block whose every observed voxel has value times weight of FREE or less is empty. A sample
    takes voxels of the block of its lowest neighbour and of the next ones, hence the others.
    """
    high = voxels.filter(F.col("weight") > 0).groupBy(*[F.floor(F.col(f"v{c}") / block).alias(f"b{c}") for c in XYZ]).agg(F.max(F.col(value) * F.col("weight")).alias("high"))
    below = F.array(*[F.struct(*[F.lit(k >> a & 1).alias(f"d{c}") for a, c in enumerate(XYZ)]) for k in range(8)])
    rows = high.filter(F.col("high") > FREE).withColumn("o", F.explode(below))
    return rows.select(*[(F.col(f"b{c}") - F.col(f"o.d{c}")).alias(f"b{c}") for c in XYZ]).distinct()


def ray_cubes(voxels: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """voxels.cubes() for samples along rays; with blocks (bx, by, bz), only of those."""
    held = cubes(voxels, "tsdf", 0, 1)
    if blocks is None:
        return held
    return held.join(blocks.select(*[F.col(f"b{c}").cast("int").alias(f"c{c}") for c in XYZ]), ["cx", "cy", "cz"], "left_semi")


def _sample(c: str, k: Column, step: float) -> Column:
    """Lowest neighbour of sample k in an axis."""
    return F.floor(F.col(f"o{c}") + k * F.lit(step) * F.col(f"d{c}") - F.lit(0.5))


def along_rays(rays: DataFrame, held: DataFrame, steps: int, step: float, first: int = 0) -> DataFrame:
    """samples() in these cubes. The samples of a ray in one cube are one row until they have met it.

    Rays are few bytes and much work: the number of tasks must not follow their size.
    """
    parts = 4 * int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [f"c{c}" for c in XYZ]
    cube = lambda c, k: F.floor(_sample(c, k, step) / CUBE).cast("int")
    changed = lambda k: (k == first) | (cube("x", k) != cube("x", k - 1)) | (cube("y", k) != cube("y", k - 1)) | (cube("z", k) != cube("z", k - 1))
    rows = rays.repartition(parts, "id").select("id", *[f"{n}{c}" for n in "od" for c in XYZ], F.filter(F.sequence(F.lit(first), F.lit(steps)), changed).alias("starts"))
    rows = rows.select("*", F.posexplode("starts").alias("n", "k0")).withColumn("k1", F.coalesce(F.get("starts", F.col("n") + 1) - 1, F.lit(steps))).drop("starts", "n")
    rows = rows.withColumns({f"c{c}": cube(c, F.col("k0")) for c in XYZ}).repartition(parts, *at).join(held.repartition(parts, *at).hint("merge"), at)
    rows = rows.withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumns({c: F.col(f"o{c}") + F.col("k") * F.lit(step) * F.col(f"d{c}") for c in XYZ})
    rows = based(rows).select("id", "k", "held", *at, *[f"{n}{c}" for n in "bf" for c in XYZ])
    rows = settle(rows, *[f"{n}{c}" for n in "bf" for c in XYZ])
    return settle(rows.select("id", "k", trilinear().alias("value")), "value").filter("value is not null")


def samples(rays: DataFrame, voxels: DataFrame, steps: int, step: float, first: int = 0, blocks: DataFrame | None = None) -> DataFrame:
    """(id, k, value): the interpolated field at first to steps steps along each ray, where it is known.

    Samples whose lowest neighbour lies in none of blocks are left out.
    """
    return along_rays(rays, ray_cubes(voxels, blocks), steps, step, first)


def march(cast: Callable[[DataFrame], DataFrame], rays: DataFrame, voxels: DataFrame, steps: int, step: float, near: int = 24, blocks: DataFrame | None = None) -> DataFrame:
    """What cast finds along the whole of each ray, first by near steps and then, for rays without a row, by the rest.

    The last near sample is the first of the rest, so that a change of sign between them is seen.
    Cubes of voxels and near rows are persisted, as each is read twice. blocks as in samples.
    """
    held = ray_cubes(voxels, blocks).persist()
    if steps <= near:
        return cast(along_rays(rays, held, steps, step))
    soon = cast(along_rays(rays, held, near, step)).persist()
    later = rays.join(soon.select("id").hint("merge"), "id", "left_anti")
    return soon.unionByName(cast(along_rays(later, held, steps, step, near)))


def first_known(along: DataFrame, step: float) -> DataFrame:
    """(id, t): how far each ray goes before the field is known."""
    return along.filter("value is not null").groupBy("id").agg((F.min("k") * F.lit(step)).alias("t"))


def cast_surface(along: DataFrame, step: float) -> DataFrame:
    """(id, t): where each ray first goes from outside (0 or more) to inside, by linear refinement."""
    w = Window.partitionBy("id").orderBy("k")
    rows = along.withColumns({"before": F.lag("value").over(w), "last": F.lag("k").over(w)}).filter("last = k - 1 and before >= 0 and value < 0")
    t = (F.col("k") - 1) * F.lit(step) + F.col("before") / (F.col("before") - F.col("value")) * F.lit(step)
    return rows.groupBy("id").agg(F.min(F.struct("k", t.alias("t"))).alias("hit")).select("id", F.col("hit.t").alias("t"))


def cast_occupied(along: DataFrame, step: float) -> DataFrame:
    """(id, t): where the log-odds along each ray first exceed 0; rays without a hit are left out."""
    return along.filter("value > 0").groupBy("id").agg((F.min("k") * F.lit(step)).alias("t"))


#: Edge of the regions of voxels that rays are dealt to, in blocks of 8, and how many pieces of rays share a copy of a region.
REGION, PER_COPY = 32, 1 << 15
#: What the rows of a region are, if no pieces of rays: they have this as k1 and come first.
OPEN, VOXEL = -2, -1


def _around(c: str, below: int, above: int, edge: int = 1) -> Column:
    """The regions along an axis that hold what is at c, in units of edge, or have it in their margin."""
    n = REGION // edge
    return F.explode(F.sequence(F.floor((F.col(c) - above) / n).cast("int"), F.floor((F.col(c) + below) / n).cast("int")))


def _held(voxels: DataFrame, blocks: DataFrame | None, below: int, above: int) -> DataFrame:
    """(rx, ry, rz, k1, k0, ox): what regions hold, a row an observed voxel (k0: where, ox: its value) and one for each of blocks."""

    def placed(rows: DataFrame, name: str, kind: int, low: int, high: int, edge: int, value: Column) -> DataFrame:
        n = REGION // edge + low + high
        for c in XYZ:
            rows = rows.withColumn(f"r{c}", _around(f"{name}{c}", low, high, edge))
        at = sum((F.col(f"{name}{c}") - F.col(f"r{c}") * (REGION // edge) + low) * n**k for k, c in enumerate(XYZ)).cast("int")
        return rows.select(*[f"r{c}" for c in XYZ], F.lit(kind).alias("k1"), at.alias("k0"), value.cast("double").alias("ox"))

    out = placed(voxels.filter("weight > 0"), "v", VOXEL, below, above, 1, F.col("tsdf"))
    if blocks is None:
        return out
    return out.unionByName(placed(blocks, "b", OPEN, 1, 1, CUBE, F.lit(None)))


def _pieces(rays: DataFrame, first: int, last: int, step: float) -> DataFrame:
    """rays with (rx, ry, rz, k0, k1): their samples first to last, a row for each run in one region. Rays without a place have none."""
    k = np.arange(first, last + 1)
    names = [f"{n}{c}" for n in "od" for c in XYZ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            many = max(1, (1 << 20) // len(k))
            for batch in (whole.slice(a, many) for a in range(0, whole.num_rows, many)):
                ray = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
                real = np.isfinite(ray).all(axis=0)
                ray = np.where(real, ray, 0.0)
                if (np.square(ray[3:]).sum(axis=0) > 1 + 1e-9).any():
                    raise ValueError("directions of rays must have a length of 1 at most")
                at = [np.floor((ray[a][:, None] + k * step * ray[a + 3][:, None] - 0.5) / REGION).astype(np.int32) for a in range(3)]
                new = np.repeat(real[:, None], len(k), axis=1)
                new[:, 1:] &= (at[0][:, 1:] != at[0][:, :-1]) | (at[1][:, 1:] != at[1][:, :-1]) | (at[2][:, 1:] != at[2][:, :-1])
                row, i = np.nonzero(new)
                more = np.r_[row[1:] == row[:-1], False] if len(row) else np.zeros(0, dtype=bool)
                end = np.where(more, np.r_[k[i][1:], 0][: len(row)] - 1, last)
                cols = [batch.column("id").take(pa.array(row)), *[pa.array(c[row]) for c in ray], *[pa.array(c[row, i]) for c in at], pa.array(k[i].astype(np.int32)), pa.array(end.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", *names, "rx", "ry", "rz", "k0", "k1"])

    kind = rays.schema["id"].dataType.simpleString()
    return rays.select("id", *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(cut, f"id {kind}, {', '.join(f'{c} double' for c in names)}, rx int, ry int, rz int, k0 int, k1 int")


def _values(field: np.ndarray, n: int, low: int, p: list[np.ndarray], base: list[np.ndarray]) -> np.ndarray:
    """trilinear() at points p, whose lowest neighbours are base, in the field of a region that starts at -low; NaN where unknown."""
    f, out = [c - 0.5 - b for c, b in zip(p, base, strict=True)], 0.0
    for k in (0, 1):
        for j in (0, 1):
            for i in (0, 1):
                share = 1.0
                for a, d in enumerate((i, j, k)):
                    share = share * (f[a] if d else 1.0 - f[a])
                out = out + share * field[i + n * (j + n * k) + (base[0] + low) + n * ((base[1] + low) + n * (base[2] + low))]
    return out


def _region_hits(rays: DataFrame, held: DataFrame, skips: bool, first: int, last: int, step: float, hit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """first_hits() at samples first to last, with what regions hold."""
    parts = 4 * int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, below, above = ["rx", "ry", "rz"], math.ceil(step), math.ceil(step) + 1
    n, m = REGION + below + above, REGION // CUBE + 2
    pieces = _pieces(rays.repartition(parts, "id"), first, last, step)
    copies = pieces.groupBy(*at).count().join(held.select(*at).distinct(), at).select(*at, F.ceil(F.col("count") / PER_COPY).cast("int").alias("copies"))
    rows = pieces.join(copies, at).withColumn("copy", F.pmod(F.xxhash64("id"), "copies").cast("int")).drop("copies")
    whole = held.join(copies, at).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    rows = rows.unionByName(whole, allowMissingColumns=True)
    kind = rays.schema["id"].dataType.simpleString()

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, field, open_ = None, None, None
        for batch in batches:
            col = lambda c, batch=batch: batch.column(c).to_numpy(zero_copy_only=False)
            keys, k0, k1, ox = np.stack([col(c) for c in (*at, "copy")], 1), col("k0"), col("k1"), col("ox")
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]).tolist() if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if key != (new := tuple(keys[start].tolist())):
                    key, field, open_ = new, np.full(n**3, np.nan), np.full(m**3, not skips)
                there = np.arange(start, end)
                open_[k0[there[k1[start:end] == OPEN]]] = True
                v = there[k1[start:end] == VOXEL]
                field[k0[v]] = ox[v]
                there = there[k1[start:end] >= 0]
                if not len(there):
                    continue
                # The sample before each piece too, so that a change between regions is seen.
                size = k1[there] - k0[there] + 2
                piece = np.repeat(np.arange(len(there)), size)
                ends = np.cumsum(size)
                k = np.arange(len(piece)) - np.repeat(ends - size, size) + np.repeat(k0[there], size) - 1
                p = [col(f"o{c}")[there][piece] + k * step * col(f"d{c}")[there][piece] - key[a] * REGION for a, c in enumerate(XYZ)]
                base = [np.floor(c - 0.5).astype(np.int64) for c in p]
                ok = np.flatnonzero((k >= 0) & open_[sum((b // CUBE + 1) * m**a for a, b in enumerate(base))])
                value = np.full(len(k), np.nan)
                value[ok] = _values(field, n, below, [c[ok] for c in p], [b[ok] for b in base])
                own = np.flatnonzero(np.r_[False, piece[1:] == piece[:-1]])
                own = own[hit(value[own - 1], value[own])]
                found, i = np.unique(piece[own], return_index=True)
                own = own[i]
                cols = [batch.column("id").take(pa.array(there[found])), pa.array(k[own].astype(np.int32)), pa.array(value[own - 1]), pa.array(value[own])]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "k", "before", "value"])

    order = [*at, "copy"]
    out = rows.repartition(parts, *order).sortWithinPartitions(*order, "k1").mapInArrow(cast, f"id {kind}, k int, before double, value double")
    return out.groupBy("id").agg(F.min(F.struct("k", "before", "value")).alias("hit")).select("id", "hit.*")


def first_hits(rays: DataFrame, voxels: DataFrame, steps: int, step: float, hit: Callable[[np.ndarray, np.ndarray], np.ndarray], near: int = 24, blocks: DataFrame | None = None) -> DataFrame:
    """(id, k, before, value): the first sample of each ray where hit(before, value) holds, NaN where the field is unknown.

    Samples lie each step along rays from their origins on, steps of them; before is the value one step earlier. Rays
    are cut where they pass from region to region, pieces and voxels of a region come sorted into one stream, and of a
    piece only its hit leaves it. A task holds one region and one batch; where many rays pass, a region goes to several
    tasks. Rays without a hit in near steps go on to the rest; what regions hold and near hits are persisted, as each
    is read twice. Samples whose lowest neighbour lies in none of blocks (bx, by, bz) are unknown.
    """
    held = _held(voxels, blocks, math.ceil(step), math.ceil(step) + 1).persist()
    cast = partial(_region_hits, held=held, skips=blocks is not None, step=step, hit=hit)
    if steps <= near:
        return cast(rays, first=0, last=steps)
    soon = cast(rays, first=0, last=near).persist()
    later = rays.join(soon.select("id").hint("merge"), "id", "left_anti")
    return soon.unionByName(cast(later, first=near + 1, last=steps))


def known_hits(step: float, **how) -> DataFrame:
    """(id, t): first_known() along the whole of each ray."""
    return first_hits(step=step, hit=lambda before, value: ~np.isnan(value), **how).select("id", (F.col("k") * F.lit(step)).alias("t"))


def surface_hits(step: float, **how) -> DataFrame:
    """(id, t): cast_surface() along the whole of each ray."""
    t = (F.col("k") - 1) * F.lit(step) + F.col("before") / (F.col("before") - F.col("value")) * F.lit(step)
    return first_hits(step=step, hit=lambda before, value: (before >= 0) & (value < 0), **how).select("id", t.alias("t"))


def occupied_hits(step: float, level: float = 0.0, **how) -> DataFrame:
    """(id, t): cast_occupied() along the whole of each ray, of log-odds above level."""
    return first_hits(step=step, hit=lambda before, value: value > level, **how).select("id", (F.col("k") * F.lit(step)).alias("t"))


def hits(rays: DataFrame, surface: DataFrame, voxels: DataFrame) -> DataFrame:
    """(id, x, y, z, nx, ny, nz): points on the surface with unit normals along the gradient, null where unknown."""
    rows = rays.join(surface.hint("merge"), "id")
    at = rows.select("id", *[(F.col(f"o{c}") + F.col("t") * F.col(f"d{c}")).alias(c) for c in XYZ])
    g = gradient(at, voxels)
    n = norm((F.col("gx"), F.col("gy"), F.col("gz")))
    g = g.select("id", *[F.when(n > 0, F.col(f"g{c}") / n).alias(f"n{c}") for c in XYZ])
    return at.join(g.hint("merge"), "id", "left")
