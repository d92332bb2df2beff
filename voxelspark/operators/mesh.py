"""Surfaces from voxel tables: cube indices, marching cubes, normals, structure meshes."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sensors import norm, transform
from .voxels import corners

XYZ = ("x", "y", "z")
#: Corners of a cell as bits x + 2y + 4z; edges join corners that differ in one bit, by axis.
EDGES = tuple((a, a | 1 << k) for k in range(3) for a in range(8) if not a >> k & 1)


@cache
def triangles(case: int) -> tuple[tuple[int, int, int], ...]:
    """Triangles (of edge numbers) that part the corners in case from the others.

    Rule: each face of the cell is walked around; where it goes from an inside to an
    outside corner a segment begins and at the next way back in it ends, so on a face
    with two inside corners across from each other each is cut off alone. Segments of
    all faces make closed loops, and each loop is a fan.
    """
    number = {frozenset(e): k for k, e in enumerate(EDGES)}
    follow: dict[int, int] = {}
    for axis in range(3):
        u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
        for side in (0, 1):
            ring = [0, u, u | v, v] if side else [0, v, u | v, u]
            ring = [c | side << axis for c in ring]
            inside = [case >> c & 1 for c in ring]
            for k in range(4):
                if inside[k] and not inside[(k + 1) % 4]:
                    # Back along the inside corners to where the walk came in.
                    j = k
                    while inside[(j - 1) % 4]:
                        j -= 1
                    out = number[frozenset((ring[k], ring[(k + 1) % 4]))]
                    back = number[frozenset((ring[j % 4], ring[(j - 1) % 4]))]
                    follow[out] = back
    loops, left = [], dict(follow)
    while left:
        start = min(left)
        loop, at = [start], left.pop(start)
        while at != start:
            loop.append(at)
            at = left.pop(at)
        loops.append(loop)
    return tuple((loop[0], loop[k], loop[k + 1]) for loop in loops for k in range(1, len(loop) - 1))


def cells(voxels: DataFrame) -> DataFrame:
    """(vx, vy, vz, n, index, t0..t7): cells all of whose corners are known, and which corners are inside (tsdf < 0).

    Each voxel is a corner of the eight cells around it; a cell has the place of its corner 0.
    """
    rows = corners(voxels.select("vx", "vy", "vz", "tsdf", "weight"), stride=-1)
    rows = rows.filter("weight > 0").select(*[F.col(f"c{c}").alias(f"v{c}") for c in XYZ], "corner", "tsdf")
    bit = F.when(F.col("tsdf") < 0, F.call_function("shiftleft", F.lit(1), F.col("corner"))).otherwise(0)
    at = [F.max(F.when(F.col("corner") == k, F.col("tsdf"))).alias(f"t{k}") for k in range(8)]
    return rows.groupBy("vx", "vy", "vz").agg(F.count("*").cast("int").alias("n"), F.sum(bit).cast("int").alias("index"), *at)


def cube_index(voxels: DataFrame) -> DataFrame:
    """(vx, vy, vz, index): 0 where a corner is unknown, else a bit for each inside corner."""
    return cells(voxels).select("vx", "vy", "vz", F.when(F.col("n") == 8, F.col("index")).otherwise(0).alias("index"))


def marching_cubes(voxels: DataFrame) -> DataFrame:
    """(vx, vy, vz, face, corner, edge, x, y, z): triangles of the zero level, three rows for each face.

    Vertices lie on cell edges, at the linear zero between the corners' values; places are
    in voxels, a corner being its voxel's centre.
    """
    known = cells(voxels).filter("n = 8 and index > 0 and index < 255")
    spark = voxels.sparkSession
    rows = [(case, k, c, e) for case in range(1, 255) for k, t in enumerate(triangles(case)) for c, e in enumerate(t)]
    table = spark.createDataFrame(rows, "index int, face int, corner int, edge int")
    faces = known.join(F.broadcast(table), "index")  # 254 cases of five triangles at most

    def of_edge(pick) -> Column:
        return F.element_at(F.array(*[pick(a, b) for a, b in EDGES]), F.col("edge") + 1)

    low, high = of_edge(lambda a, b: F.col(f"t{a}")), of_edge(lambda a, b: F.col(f"t{b}"))
    faces = faces.withColumns({"low": low, "high": high})
    share = F.col("low") / (F.col("low") - F.col("high"))
    place = {}
    for k, c in enumerate(XYZ):
        base = of_edge(lambda a, b, k=k: F.lit(float(a >> k & 1)))
        along = of_edge(lambda a, b, k=k: F.lit(float((b >> k & 1) - (a >> k & 1))))
        place[c] = F.col(f"v{c}") + F.lit(0.5) + base + along * share
    return faces.withColumns(place).select("vx", "vy", "vz", "face", "corner", "edge", *XYZ)


def edge_ids(faces: DataFrame) -> DataFrame:
    """faces with vertex: one id for each edge of the grid, so that cells share vertices.

    The id is the edge's lower end and axis, three 20-bit places and two bits.
    """
    axis = F.floor(F.col("edge") / 4)
    low = [F.element_at(F.array(*[F.lit(a >> k & 1) for a, _ in EDGES]), F.col("edge") + 1) for k in range(3)]
    vertex = axis.cast("long")
    for k, c in enumerate(XYZ):
        vertex = vertex * F.lit(1 << 20) + (F.col(f"v{c}") + low[k]).cast("long")
    return faces.withColumn("vertex", vertex)


def face_rows(faces: DataFrame) -> DataFrame:
    """One row for each face: (vx, vy, vz, face) and the places a, b, c of its corners."""
    p = F.struct(*XYZ)
    at = [F.max(F.when(F.col("corner") == k, p)).alias(n) for k, n in enumerate("abc")]
    return faces.groupBy("vx", "vy", "vz", "face").agg(*at)


def vertex_normals(faces: DataFrame) -> DataFrame:
    """(vertex, nx, ny, nz): the unit sum of the unit normals of the faces around each vertex."""
    whole = face_rows(faces)
    u = [F.col(f"b.{c}") - F.col(f"a.{c}") for c in XYZ]
    v = [F.col(f"c.{c}") - F.col(f"a.{c}") for c in XYZ]
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    whole = whole.select("vx", "vy", "vz", "face", *[x.alias(f"n{c}") for c, x in zip(XYZ, cross, strict=True)])
    n = norm((F.col("nx"), F.col("ny"), F.col("nz")))
    whole = whole.filter(n > 0).select("vx", "vy", "vz", "face", *[(F.col(f"n{c}") / n).alias(f"n{c}") for c in XYZ])
    sums = edge_ids(faces).select("vx", "vy", "vz", "face", "vertex").join(whole, ["vx", "vy", "vz", "face"])
    sums = sums.groupBy("vertex").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in XYZ])
    n = norm((F.col("nx"), F.col("ny"), F.col("nz")))
    return sums.filter(n > 0).select("vertex", *[(F.col(f"n{c}") / n).alias(f"n{c}") for c in XYZ])


#: Corners of a box's six faces, x + 2y + 4z.
BOX_FACES = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))


def quads_to_triangles(quads: DataFrame) -> DataFrame:
    """Two triangles (0, 1, 2) and (0, 2, 3) for each quad (id, corners array)."""
    two = F.array(*[F.struct(F.lit(k).alias("half"), *[F.get("corners", F.lit(i)).alias(f"v{j}") for j, i in enumerate(t)]) for k, t in enumerate(((0, 1, 2), (0, 2, 3)))])
    return quads.select("id", F.inline(two))


def structure(octants: DataFrame) -> DataFrame:
    """Six quads for each leaf octant (key, x, y, z, size, scale): face and corners 0 to 3 as places."""
    table = F.array(*[F.struct(F.lit(k).alias("face"), F.array(*[F.lit(c) for c in f]).alias("cs")) for k, f in enumerate(BOX_FACES)])
    rows = octants.select("key", "x", "y", "z", "size", "scale", F.inline(table))
    rows = rows.select("key", "scale", "face", F.posexplode("cs").alias("corner", "c"), "x", "y", "z", "size")
    bit = lambda k: (F.floor(F.col("c") / 2**k) % 2).cast("int")
    return rows.select("key", "scale", "face", "corner", *[(F.col(c) + bit(k) * F.col("size")).alias(c) for k, c in enumerate(XYZ)])


def placed(points: DataFrame, pose: np.ndarray, names: tuple[str, ...] = ()) -> DataFrame:
    """x, y, z, or the places in the columns of names, under an affine map (4x4)."""
    if not names:
        return points.withColumns(dict(zip(XYZ, transform(pose, tuple(F.col(c) for c in XYZ)), strict=True)))
    at = {n: transform(pose, tuple(F.col(f"{n}.{c}") for c in XYZ)) for n in names}
    return points.withColumns({n: F.struct(*[v.alias(c) for c, v in zip(XYZ, p, strict=True)]) for n, p in at.items()})


def affine(points: DataFrame, scale: float, shift: tuple[float, float, float]) -> DataFrame:
    """Places scaled and moved, from voxels to metres of a world frame."""
    return points.withColumns({c: F.col(c) * F.lit(scale) + F.lit(t) for c, t in zip(XYZ, shift, strict=True)})
