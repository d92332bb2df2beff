"""Surfaces across scales: marching cubes on the dual of a map whose voxels differ in size.

A dual cell surrounds each corner of a voxel; its eight corners are the middles of the
voxels in the eight octants around that point, of which a coarse voxel may be several.
Neighbouring cells share whole faces whatever the scales beside them, so the mesh has no
cracks where blocks of different scales meet. Voxels are dealt by the cubes of lattice
points that they touch; a cube's unit cells name the voxel that fills them, and eight of
them lie around each of its points. A vertex lies between two voxels, which are its identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import mesh
from .fusion import settle

XYZ = ("x", "y", "z")
#: Bits of a coordinate in a voxel's number.
BITS = 19


def leaf_id(scale: Column, x: Column, y: Column, z: Column) -> Column:
    """One number for a voxel: its lower corner and scale."""
    return ((z.cast("long") * (1 << BITS) + y) * (1 << BITS) + x) * 4 + scale


#: Edge of the cubes of lattice points that voxels are dealt by, and cubes that are worked on at once.
EDGE, CHUNK = 8, 64
_VERTEX = "struct<low:bigint,high:bigint,x:double,y:double,z:double>"


def by_cube(voxels: DataFrame) -> DataFrame:
    """(cube, leaf, value): voxels with each cube of lattice points that they touch, dealt and sorted by it.

    voxels (scale up to 3, vx, vy, vz their lower corners, value; those without a value are
    not there, and none may overlap). Most voxels touch one cube, those that end at a cube's
    upper side the next one too, so little more than the voxels is shuffled.
    """
    parts = 4 * int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaf = leaf_id(F.col("scale"), F.col("vx"), F.col("vy"), F.col("vz")).alias("leaf")
    size = F.call_function("shiftleft", F.lit(1), F.col("scale"))
    ends = [(F.floor(F.col(f"v{c}") / EDGE).alias(f"{c}0"), F.floor((F.col(f"v{c}") + size) / EDGE).alias(f"{c}1")) for c in XYZ]
    rows = settle(voxels.select(leaf, "value", *[e for pair in ends for e in pair]), "leaf", "value", *[f"{c}{k}" for c in XYZ for k in (0, 1)])
    rows = rows.filter("value is not null")
    for c in XYZ:
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(f"{c}0", f"{c}1")))
    n = 1 << BITS - EDGE.bit_length() + 1
    cube = ((F.col("cz") * n + F.col("cy")) * n + F.col("cx")).alias("cube")
    return rows.select(cube, "leaf", "value").repartition(parts, "cube").sortWithinPartitions("cube")


@dataclass
class Cells:
    """Dual cells of some cubes: their points, which octants are inside, and the voxels that fill these, as rows of leaf and value."""

    at: np.ndarray
    index: np.ndarray
    held: np.ndarray
    leaf: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, cube: np.ndarray, leaf: np.ndarray, value: np.ndarray, surface: bool) -> Cells:
        """The cells of whole cubes, whose voxels come sorted by cube; surface: only those with both sides in them."""
        n, mask = BITS - EDGE.bit_length() + 1, (1 << BITS) - 1
        starts = np.flatnonzero(np.r_[True, cube[1:] != cube[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(cube)]))
        base = np.stack([(cube[starts] >> n * k & (1 << n) - 1) * EDGE for k in range(3)])
        low = np.stack([leaf >> 2 + BITS * k & mask for k in range(3)])
        size = 1 << (leaf & 3)
        # Unit cells from one before the cube's first point on, numbered with x fastest.
        first = np.maximum(low - base[:, group] + 1, 0)
        long = np.minimum(low - base[:, group] + 1 + size, EDGE + 1) - first
        count = long.prod(0)
        row = np.repeat(np.arange(len(leaf)), count)
        i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        x, y, z = (first[k][row] + e for k, e in enumerate((i % long[0][row], i // long[0][row] % long[1][row], i // (long[0] * long[1])[row])))
        grid = np.full((len(starts), EDGE + 1, EDGE + 1, EDGE + 1), -1)
        grid[group[row], z, y, x] = row
        bits = [(o & 1, o >> 1 & 1, o >> 2 & 1) for o in range(8)]
        around = np.stack([grid[:, c : c + EDGE, b : b + EDGE, a : a + EDGE] for a, b, c in bits], -1)
        g, *zyx = np.nonzero((around >= 0).all(-1))
        held, at = around[(g, *zyx)], np.stack([zyx[2 - k] + base[k][g] for k in range(3)])
        index = ((value < 0)[held] << np.arange(8)).sum(1)
        # An octant's voxel has a corner at the point if it begins there on the axes on whose upper side it lies, and ends there on the others.
        corner = np.zeros(len(g), dtype=bool)
        for o, upper in enumerate(bits):
            corner |= np.logical_and.reduce([at[k] == low[k][held[:, o]] + (0 if upper[k] else size[held[:, o]]) for k in range(3)])
        keep = corner & (index > 0) & (index < 255) if surface else corner
        return cls(at[:, keep], index[keep], held[keep], leaf, value)

    def middle(self, row: np.ndarray) -> list[np.ndarray]:
        return [(self.leaf[row] >> 2 + BITS * k & (1 << BITS) - 1) + (1 << (self.leaf[row] & 3)) / 2.0 for k in range(3)]

    def points(self, row: np.ndarray | slice = slice(None)) -> list[pa.Array]:
        return [pa.array(p[row].astype(np.int32)) for p in self.at]


def _made(voxels: DataFrame, make: Callable[[Cells], list[pa.Array]], schema: str, surface: bool) -> DataFrame:
    """What make() gives for the cells of each few cubes; a task holds one batch and the cube that it ends in."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        for batch in chain(batches, [None]):
            if batch is not None:
                rest = [np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest)]
            if not len(rest[0]):
                continue
            starts = np.flatnonzero(np.r_[True, rest[0][1:] != rest[0][:-1]])
            # The last cube may go on in the next batch.
            ends = [*starts.tolist(), len(rest[0])] if batch is None else starts.tolist()
            for k in range(0, len(ends) - 1, CHUNK):
                part = slice(ends[k], ends[min(k + CHUNK, len(ends) - 1)])
                cells = Cells.of(*[r[part] for r in rest], surface)
                if len(cells.index):
                    yield pa.record_batch(make(cells), names=names)
            rest = [r[ends[-1] :] for r in rest]

    return by_cube(voxels).mapInArrow(run, schema)


def _cell_columns(cells: Cells) -> list[pa.Array]:
    return [*cells.points(), pa.array(cells.index.astype(np.int32))]


def cell_indices(voxels: DataFrame) -> DataFrame:
    """dual_cells() without o."""
    return _made(voxels, _cell_columns, "px int, py int, pz int, index int", surface=False)


def dual_cells(voxels: DataFrame) -> DataFrame:
    """(px, py, pz, index, o): points at which a voxel has a corner and all eight octants are filled.

    index has bit k where octant k is inside (value < 0); o has what fills each octant (leaf,
    value, cx, cy, cz).
    """

    def make(cells: Cells) -> list[pa.Array]:
        row = cells.held.ravel()
        fields = [pa.array(c) for c in (cells.leaf[row], cells.value[row], *cells.middle(row))]
        held = pa.StructArray.from_arrays(fields, names=["leaf", "value", "cx", "cy", "cz"])
        return [*_cell_columns(cells), pa.ListArray.from_arrays(pa.array(np.arange(len(cells.index) + 1, dtype=np.int32) * 8), held)]

    return _made(voxels, make, "px int, py int, pz int, index int, o array<struct<leaf:bigint,value:double,cx:double,cy:double,cz:double>>", surface=False)


#: Of each of the 256 cases, the triangles' number and the ends of their corners' edges, as octants.
_COUNT = np.array([len(mesh.triangles(case)) if 0 < case < 255 else 0 for case in range(256)])
_ENDS = np.zeros((256, _COUNT.max(), 3, 2), dtype=np.int64)
for _case in range(1, 255):
    for _k, _t in enumerate(mesh.triangles(_case)):
        _ENDS[_case, _k] = [mesh.EDGES[e] for e in _t]


def dual_mesh(voxels: DataFrame) -> DataFrame:
    """(px, py, pz, face, a, b, c): triangles of the zero level, with vertices (low, high, x, y, z).

    low and high are the voxels that a vertex lies between, at the linear zero between their
    middles. Triangles two of whose vertices are one, as coarse voxels make them, are left out.
    """

    def make(cells: Cells) -> list[pa.Array]:
        count = _COUNT[cells.index]
        cell = np.repeat(np.arange(len(count)), count)
        face = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
        a, b = (np.take_along_axis(cells.held[cell], _ENDS[cells.index[cell], face, :, k], 1) for k in (0, 1))
        # From the lower voxel to the higher one, so that all cells place it alike.
        ahead = cells.leaf[a] < cells.leaf[b]
        a, b = np.where(ahead, a, b), np.where(ahead, b, a)
        same = lambda m, n: (a[:, m] == a[:, n]) & (b[:, m] == b[:, n])
        keep = ~(same(0, 1) | same(1, 2) | same(0, 2))
        a, b = a[keep], b[keep]
        share = cells.value[a] / (cells.value[a] - cells.value[b])
        at = [f + (s - f) * share for f, s in zip(cells.middle(a), cells.middle(b), strict=True)]
        corner = lambda k: pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c[:, k])) for c in (cells.leaf[a], cells.leaf[b], *at)], names=["low", "high", *XYZ])
        return [*cells.points(cell[keep]), pa.array(face[keep].astype(np.int32)), *[corner(k) for k in range(3)]]

    return _made(voxels, make, f"px int, py int, pz int, face int, a {_VERTEX}, b {_VERTEX}, c {_VERTEX}", surface=True)


def vertices(faces: DataFrame) -> DataFrame:
    """(low, high, x, y, z) of each vertex once; cells of all scales and on both sides of a block's border share it."""
    rows = faces.select(F.explode(F.array("a", "b", "c")).alias("v")).select("v.*")
    return rows.groupBy("low", "high").agg(*[F.min(c).alias(c) for c in XYZ])
