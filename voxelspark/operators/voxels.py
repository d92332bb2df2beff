"""Lookups in a voxel table (vx, vy, vz, tsdf, weight): values, fields, interpolation, gradients, slices.

Points have map coordinates in voxels. A query is a batch: points meet cubes of voxels with
a margin by equality and sum their stencil there; a point without its whole stencil is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def contains(size: float, *p: Column) -> Column:
    """Whether a point lies in the half-open box [0, size) on each axis."""
    out = F.lit(True)
    for c in p:
        out = out & (c >= 0) & (c < size)
    return out


def to_voxel(p: Column, res: float, dim: float) -> Column:
    """Voxel coordinate of a map coordinate in metres, -1 outside; cut off towards zero."""
    return F.when((p >= 0) & (p < dim), (p / F.lit(res)).cast("int")).otherwise(-1)


def to_point(v: Column, res: float, stride: Column | int = 1) -> Column:
    """Map coordinate in metres of a voxel's centre."""
    return (v + F.lit(0.5) * stride) * F.lit(res)


def corners(voxels: DataFrame, stride: int = 1) -> DataFrame:
    """Eight rows (corner, cx, cy, cz) for each voxel, x fastest."""
    rows = voxels.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = lambda k: F.floor(F.col("corner") / 2**k).cast("int") % 2 * stride
    return rows.withColumns({f"c{c}": F.col(f"v{c}") + bit(k) for k, c in enumerate(XYZ)})


def lookup(points: DataFrame, voxels: DataFrame) -> DataFrame:
    """points (id, x, y, z) with tsdf and weight of their voxel: 1 and 0 where nothing is allocated."""
    rows = points.withColumns({f"v{c}": F.floor(F.col(c)).cast("int") for c in XYZ})
    rows = rows.join(voxels, ["vx", "vy", "vz"], "left")
    return rows.select("id", F.coalesce("tsdf", F.lit(1.0)).alias("tsdf"), F.coalesce("weight", F.lit(0)).alias("weight"))


def field(value: Column, weight: Column) -> Column:
    """The field of a TSDF voxel, null where it was never observed."""
    return F.when(weight > 0, value)


def occupancy_field(occupancy: Column, weight: Column) -> Column:
    """Log-odds of an occupancy voxel: mean times weight."""
    return F.when(weight > 0, occupancy * weight)


#: Edge of the cubes of voxels that points look their stencils up in.
CUBE = 8


def cubes(voxels: DataFrame, value: str, below: int, above: int) -> DataFrame:
    """(cx, cy, cz, held): the observed values of each cube and of below and above voxels around it, x fastest, null where there is none.

    A voxel goes to its cube and to those whose margin it lies in, so a point needs one row to see its whole stencil.
    """
    n = CUBE + below + above
    rows = voxels.filter("weight > 0").select("vx", "vy", "vz", F.col(value).cast("double").alias("w"))
    for c in XYZ:
        low, high = F.floor((F.col(f"v{c}") - (CUBE - 1 + above)) / CUBE), F.floor((F.col(f"v{c}") + below) / CUBE)
        # The least cube whose margin above still holds the voxel.
        low = F.when(low * CUBE + CUBE - 1 + above < F.col(f"v{c}"), low + 1).otherwise(low)
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    at = sum((F.col(f"v{c}") - F.col(f"c{c}") * CUBE + below) * n**k for k, c in enumerate(XYZ)).cast("int")
    rows = rows.groupBy("cx", "cy", "cz").agg(F.sort_array(F.collect_list(F.struct(at.alias("i"), "w"))).alias("p"))

    def filled(e: Column, k: Column) -> Column:
        after = F.coalesce(F.get("p", k + 1)["i"], F.lit(n**3))
        gap = lambda size: F.array_repeat(F.lit(None).cast("double"), size)
        first = F.when(k == 0, gap(e["i"])).otherwise(gap(F.lit(0)))
        return F.concat(first, F.array(e["w"]), gap(after - e["i"] - 1))

    whole = F.transform("p", lambda e: e["w"])
    return rows.select("cx", "cy", "cz", F.when(F.size("p") == n**3, whole).otherwise(F.flatten(F.transform("p", filled))).alias("held"))


def _in_cubes(points: DataFrame, held: DataFrame) -> DataFrame:
    """points (with bx, by, bz) with what their base voxel's cube holds, null if nothing.

    Both sides are sorted: points may have grown from few bytes, and are not to be sent to all tasks for that.
    """
    rows = points.withColumns({f"c{c}": F.floor(F.col(f"b{c}") / CUBE).cast("int") for c in XYZ})
    return rows.join(held.hint("merge"), ["cx", "cy", "cz"], "left")


def based(points: DataFrame) -> DataFrame:
    """points with base voxel (bx..) and fractions (fx..) of the eight voxels around them."""
    rows = points
    for c in XYZ:
        rows = rows.withColumn(f"b{c}", F.floor(F.col(c) - F.lit(0.5)).cast("int"))
        rows = rows.withColumn(f"f{c}", F.col(c) - F.lit(0.5) - F.col(f"b{c}"))
    return rows


def _spot(offset: tuple, below: int, above: int) -> Column:
    """What held has at an offset from the base voxel."""
    n = CUBE + below + above
    return F.get("held", sum((F.col(f"b{c}") - F.col(f"c{c}") * CUBE + below + d) * n**k for k, (c, d) in enumerate(zip(XYZ, offset, strict=True))).cast("int"))


def trilinear() -> Column:
    """The interpolated value at a row of based() that has met its cube without margin below."""
    out = F.lit(0.0)
    for k in (0, 1):
        for j in (0, 1):
            for i in (0, 1):
                share = F.lit(1.0)
                for c, d in zip(XYZ, (i, j, k), strict=True):
                    share = share * (F.col(f"f{c}") if d else F.lit(1.0) - F.col(f"f{c}"))
                out = out + share * _spot((i, j, k), 0, 1)
    return out


def interpolate(points: DataFrame, voxels: DataFrame, value: str = "tsdf") -> DataFrame:
    """(id, value): trilinear interpolation, null where one of the eight voxels is missing or unobserved.

    A point meets its cube of voxels once, not each of its eight voxels.
    """
    return _in_cubes(based(points), cubes(voxels, value, 0, 1)).select("id", trilinear().alias("value"))


def gradient(points: DataFrame, voxels: DataFrame, res: float = 1.0, value: str = "tsdf") -> DataFrame:
    """(id, gx, gy, gz): half differences of the interpolated field one voxel on either side, over res.

    All 32 voxels of the stencil must be there and observed; a point meets its cube of voxels once.
    """
    return _slopes(based(points), voxels, res, value, "g").select("id", *[f"g{c}" for c in XYZ])


def _slopes(points: DataFrame, voxels: DataFrame, res: float, value: str, name: str) -> DataFrame:
    """points (see _based) with their gradient in columns name and axis."""
    spots = [(i, j, k) for k in range(-1, 3) for j in range(-1, 3) for i in range(-1, 3) if sum(v in (0, 1) for v in (i, j, k)) >= 2]
    rows = _in_cubes(points, cubes(voxels, value, 1, 2))
    rows = rows.select(*points.columns, F.array(*[_spot(s, 1, 2) for s in spots]).alias("w"))

    def weight(c: str, d: int) -> Column:
        return {0: F.lit(1.0) - F.col(f"f{c}"), 1: F.col(f"f{c}")}.get(d, F.lit(0.0))

    def slope(axis: int) -> Column:
        out = F.lit(0.0)
        for n, s in enumerate(spots):
            own = weight(XYZ[axis], s[axis] - 1) - weight(XYZ[axis], s[axis] + 1)
            others = [(c, d) for k, (c, d) in enumerate(zip(XYZ, s, strict=True)) if k != axis]
            if all(d in (0, 1) for _, d in others):
                for c, d in others:
                    own = own * weight(c, d)
                out = out + own * F.get("w", F.lit(n))
        return out

    whole = F.forall("w", lambda v: v.isNotNull())
    half = F.lit(0.5 / res)
    return rows.select(*points.columns, *[F.when(whole, slope(k) * half).alias(f"{name}{c}") for k, c in enumerate(XYZ)])


def box_of(points: DataFrame, by: list[str]) -> DataFrame:
    """The box around the points of each group."""
    return points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for f, n in ((F.min, "min"), (F.max, "max"))])


def dilate(box: DataFrame, by: float) -> DataFrame:
    """Boxes grown on every side, or shrunk by a negative number."""
    return box.withColumns({f"min_{c}": F.col(f"min_{c}") - F.lit(by) for c in XYZ} | {f"max_{c}": F.col(f"max_{c}") + F.lit(by) for c in XYZ})


def clamp(box: DataFrame, low: float, high: float) -> DataFrame:
    cut = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))
    return box.withColumns({f"{n}_{c}": cut(f"{n}_{c}") for c in XYZ for n in ("min", "max")})


def transformed(box: DataFrame, rotation: tuple, shift: tuple) -> DataFrame:
    """The axis-aligned box around each box after a rigid motion: bounds are sums of the extreme products."""
    out = {}
    for r, t, c in zip(rotation, shift, XYZ, strict=True):
        low, high = F.lit(float(t)), F.lit(float(t))
        for k, a in zip(r, XYZ, strict=True):
            lo, hi = F.lit(float(k)) * F.col(f"min_{a}"), F.lit(float(k)) * F.col(f"max_{a}")
            low, high = low + F.least(lo, hi), high + F.greatest(lo, hi)
        out |= {f"min_{c}": low, f"max_{c}": high}
    return box.withColumns(out)


def plane(voxels: DataFrame, axis: str, at: int, size: tuple[int, int]) -> DataFrame:
    """(u, v, tsdf, weight): a dense slice across axis through voxel at, with defaults where nothing is allocated."""
    u, v = (c for c in XYZ if c != axis)
    spark = voxels.sparkSession
    grid = spark.range(size[0] * size[1]).select((F.col("id") % size[0]).cast("int").alias("u"), F.floor(F.col("id") / size[0]).cast("int").alias("v"))
    cut = voxels.filter(F.col(f"v{axis}") == at).select(F.col(f"v{u}").alias("u"), F.col(f"v{v}").alias("v"), "tsdf", "weight")
    return grid.join(cut, ["u", "v"], "left").select("u", "v", F.coalesce("tsdf", F.lit(1.0)).alias("tsdf"), F.coalesce("weight", F.lit(0)).alias("weight"))


def _at_scale(points: DataFrame, s: int) -> DataFrame:
    """based() of points at scale s; their own coordinates stay as px, py, pz."""
    names = [c for c in points.columns if c not in XYZ]
    own = [F.col(f"p{c}") for c in XYZ] if s else [F.col(c).alias(f"p{c}") for c in XYZ]
    rows = points.select(*[c for c in names if c not in ("px", "py", "pz")], *own)
    return based(rows.withColumns({c: F.col(f"p{c}") / 2**s for c in XYZ}))


def interpolate_scales(points: DataFrame, levels: list[DataFrame], value: str = "tsdf") -> DataFrame:
    """(id, value, scale): interpolation at the finest of levels (scale 0, 1, ...) that has all eight voxels.

    A point carries what it found from level to level, so points never meet each other.
    """
    out = points.select("id", *XYZ, F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("scale"))
    for s, level in enumerate(levels):
        rows = _in_cubes(_at_scale(out, s), cubes(level, value, 0, 1)).withColumn("new", trilinear())
        scale = F.coalesce("scale", F.when(F.col("new").isNotNull(), s))
        out = rows.select("id", "px", "py", "pz", F.coalesce("value", "new").alias("value"), scale.alias("scale"))
    return out.select("id", "value", "scale")


def gradient_scales(points: DataFrame, levels: list[DataFrame], res: float = 1.0, value: str = "tsdf") -> DataFrame:
    """(id, gx, gy, gz): the gradient at the finest of levels that has the whole stencil, per unit of the finest."""
    out = points.select("id", *XYZ, *[F.lit(None).cast("double").alias(f"g{c}") for c in XYZ])
    for s, level in enumerate(levels):
        rows = _slopes(_at_scale(out, s), level, res * 2**s, value, "n")
        out = rows.select("id", "px", "py", "pz", *[F.coalesce(f"g{c}", f"n{c}").alias(f"g{c}") for c in XYZ])
    return out.select("id", *[f"g{c}" for c in XYZ])
