"""Writers of meshes, slices, point clouds, depth images and statistics.

Formats that count their elements in a header need all elements in one file, in order; rows
come to the driver one partition at a time, so no more than one is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.colour import SCALE_COLOURS
from ..functions.rigid import pose_matrix
from ..operators.mesh import placed

FORMATS = (".obj", ".ply", ".vtk")


def has_mesh_format(path: str) -> bool:
    return Path(path).suffix in FORMATS


def _faces(faces: DataFrame) -> Iterator[Row]:
    """Rows (a, b, c places; scale) in the order of cells and faces, or of their places if these are unknown."""
    order = [c for c in ("vx", "vy", "vz", "face") if c in faces.columns]
    return faces.orderBy(*(order or ["a", "b", "c"])).toLocalIterator()


def _pose(scale: float, shift: tuple[float, float, float], pose: np.ndarray | None) -> np.ndarray:
    here = pose_matrix(shift, scale=scale)
    return here if pose is None else np.asarray(pose, dtype=float) @ here


def _place(p: Row) -> str:
    return " ".join(f"{v:.6f}" for v in p)


def save_mesh(faces: DataFrame, path: str, scale: float = 1.0, shift: tuple[float, float, float] = (0.0, 0.0, 0.0), pose: np.ndarray | None = None) -> None:
    """Write faces (a, b, c; optionally scale) as .ply, .vtk or .obj, each with vertices of its own.

    Places are scaled and moved, then taken through pose (4x4), if there is one.
    """
    if not has_mesh_format(path):
        raise ValueError(f"a mesh file ends in one of {', '.join(FORMATS)}")
    faces = faces if "scale" in faces.columns else faces.withColumn("scale", F.lit(0))
    faces = placed(faces, _pose(scale, shift, pose), ("a", "b", "c"))
    n = faces.count()
    kind = Path(path).suffix
    with open(path, "w") as f:
        if kind == ".ply":
            f.write(f"ply\nformat ascii 1.0\nelement vertex {3 * n}\nproperty float x\nproperty float y\nproperty float z\nelement face {n}\nproperty list uchar int vertex_index\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n")
        elif kind == ".vtk":
            f.write(f"# vtk DataFile Version 3.0\nvtk mesh\nASCII\nDATASET POLYDATA\nPOINTS {3 * n} FLOAT\n")
        for r in _faces(faces):
            for p in (r["a"], r["b"], r["c"]):
                f.write(("v " if kind == ".obj" else "") + _place(p) + "\n")
        if kind == ".vtk":
            f.write(f"POLYGONS {n} {4 * n}\n")
        if kind == ".ply":
            for k, r in enumerate(_faces(faces)):
                colour = SCALE_COLOURS[min(int(r["scale"]), len(SCALE_COLOURS) - 1)]
                f.write(f"3 {3 * k} {3 * k + 1} {3 * k + 2} {' '.join(map(str, colour))}\n")
        else:
            for k in range(n):
                f.write(f"f {3 * k + 1} {3 * k + 2} {3 * k + 3}\n" if kind == ".obj" else f"3 {3 * k} {3 * k + 1} {3 * k + 2}\n")
        if kind == ".vtk":
            f.write(f"CELL_DATA {n}\nSCALARS scale int 1\nLOOKUP_TABLE default\n")
            for r in _faces(faces):
                f.write(f"{int(r['scale'])}\n")


def save_slice(plane: DataFrame, path: str, size: tuple[int, int], res: float, value: str = "tsdf") -> None:
    """Write a dense slice (u, v, value), u fastest, as a rectilinear grid."""
    u, v = size
    with open(path, "w") as f:
        f.write(f"# vtk DataFile Version 3.0\nvtk slice\nASCII\nDATASET RECTILINEAR_GRID\nDIMENSIONS {u + 1} {v + 1} 2\n")
        for name, n in (("X", u), ("Y", v), ("Z", 1)):
            f.write(f"{name}_COORDINATES {n + 1} float\n" + " ".join(f"{k * res:.6f}" for k in range(n + 1)) + "\n")
        f.write(f"CELL_DATA {u * v}\nSCALARS {value} float 1\nLOOKUP_TABLE default\n")
        for r in plane.orderBy("v", "u").select(value).toLocalIterator():
            f.write(f"{r[0]:.6f}\n")


def save_points(points: DataFrame, path: str, scale: float = 1.0, shift: tuple[float, float, float] = (0.0, 0.0, 0.0), pose: np.ndarray | None = None) -> None:
    """Write points (x, y, z), in the order of id if they have one, as polydata; placed as in save_mesh."""
    points = placed(points.orderBy("id") if "id" in points.columns else points, _pose(scale, shift, pose))
    n = points.count()
    with open(path, "w") as f:
        f.write(f"# vtk DataFile Version 3.0\nvtk points\nASCII\nDATASET POLYDATA\nPOINTS {n} float\n")
        for r in points.select("x", "y", "z").toLocalIterator():
            f.write(_place(r) + "\n")


def _image(pixels: DataFrame, width: int, height: int, scale: float) -> np.ndarray:
    out = np.zeros((height, width), np.uint16)
    for r in pixels.select("x", "y", F.round(F.col("depth") * scale).cast("int").alias("d")).collect():  # one image
        out[r["y"], r["x"]] = min(max(r["d"], 0), 65535)
    return out


def save_depth(pixels: DataFrame, path: str, width: int, height: int, scale: float = 1000.0) -> None:
    """Write one depth image (x, y, depth) as a 16-bit .png or an ASCII .pgm."""
    image = _image(pixels, width, height, scale)
    if path.endswith(".pgm"):
        Path(path).write_text(f"P2\n{width} {height}\n65535\n" + "".join(" ".join(map(str, row)) + "\n" for row in image.tolist()))
    else:
        from .readers import encode_png

        Path(path).write_bytes(encode_png(image))


def save_log(table: DataFrame, path: str) -> None:
    """Write a statistics table, iterations in order, as tab-separated text with a header."""
    table.coalesce(1).sortWithinPartitions("iter").write.mode("overwrite").csv(path, sep="\t", header=True)
