"""Meshes across scales are closed, with one vertex for each pair of voxels that the surface parts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from voxelspark.operators import dual_mesh

from .cost import shuffled_rows

VOXELS = "scale int, vx int, vy int, vz int, value double"


def blocks(scales: dict[tuple[int, int, int], int], value) -> list[tuple]:
    rows = []
    for (bx, by, bz), s in scales.items():
        step = 1 << s
        for x in range(bx * 8, bx * 8 + 8, step):
            for y in range(by * 8, by * 8 + 8, step):
                for z in range(bz * 8, bz * 8 + 8, step):
                    rows.append((s, x, y, z, float(value(np.array([x, y, z]) + step / 2, s))))
    return rows


def mixed(n: int, seed: int) -> dict[tuple[int, int, int], int]:
    rng = np.random.default_rng(seed)
    return {(x, y, z): int(rng.integers(0, 4)) for x in range(n) for y in range(n) for z in range(n)}


def triangles(faces) -> list[list[tuple]]:
    return [[(r[n]["low"], r[n]["high"]) for n in "abc"] for r in faces.collect()]


def assert_closed(faces: list[list[tuple]]) -> None:
    """Every directed edge is walked the other way as often."""
    edges = Counter((t[k], t[(k + 1) % 3]) for t in faces for k in range(3))
    assert faces and all(edges[b, a] == n for (a, b), n in edges.items())


def test_a_ball_over_blocks_of_all_scales(spark):
    centre, radius = np.array([12.2, 11.6, 12.4]), 6.9
    rows = blocks(mixed(3, 4), lambda p, s: np.linalg.norm(p - centre) - radius)
    faces = dual_mesh.dual_mesh(spark.createDataFrame(rows, VOXELS).repartition(3))
    found = triangles(faces)
    assert_closed(found)
    at = {(r["low"], r["high"]): np.array([r["x"], r["y"], r["z"]]) for r in dual_mesh.vertices(faces).collect()}
    assert set(at) == {v for t in found for v in t}
    # All of one orientation: the volume between the surface and its centre is about the ball's.
    volume = sum(np.dot(at[a] - centre, np.cross(at[b] - centre, at[c] - centre)) for a, b, c in found) / 6
    assert abs(abs(volume) / (4 / 3 * np.pi * radius**3) - 1) < 0.35
    assert all(abs(np.linalg.norm(p - centre) - radius) < 5 for p in at.values())
    sizes = {low % 4 for low, high in at} | {high % 4 for low, high in at}
    assert len(sizes) >= 3 and any(low % 4 != high % 4 for low, high in at)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_values_give_a_closed_mesh(spark, seed):
    """Ambiguous cells and faces between scales too; the outermost blocks are outside."""
    rng, scales = np.random.default_rng(seed), mixed(3, seed)
    rows = blocks(scales, lambda p, s: rng.normal() if (abs(p - 12) < 7).all() else 1.0)
    faces = triangles(dual_mesh.dual_mesh(spark.createDataFrame(rows, VOXELS)))
    assert_closed(faces)
    assert all(len(set(t)) == 3 for t in faces)


def test_one_scale_has_the_cells_of_plain_marching_cubes(spark):
    from voxelspark.operators import mesh

    rows = blocks({(0, 0, 0): 0}, lambda p, s: np.linalg.norm(p - 4.1) - 2.4)
    voxels = spark.createDataFrame(rows, VOXELS)
    plain = mesh.marching_cubes(voxels.selectExpr("vx", "vy", "vz", "value AS tsdf", "1 AS weight"))
    want = sorted((r["vx"] + 1, r["vy"] + 1, r["vz"] + 1, r["face"]) for r in plain.filter("corner = 0").collect())
    got = sorted((r["px"], r["py"], r["pz"], r["face"]) for r in dual_mesh.dual_mesh(voxels).collect())
    assert got == want and got


def test_cells_need_all_octants(spark):
    assert dual_mesh.dual_mesh(spark.createDataFrame([], VOXELS)).collect() == []
    rows = blocks({(0, 0, 0): 3, (1, 0, 0): 2}, lambda p, s: p[0] - 7)
    assert dual_mesh.dual_cells(spark.createDataFrame(rows, VOXELS)).filter("px < 8 or py in (0, 8) or pz in (0, 8)").collect() == []
    rows = [*rows, (3, 0, 8, 0, None)]
    assert dual_mesh.dual_cells(spark.createDataFrame(rows, VOXELS)).filter("px < 8 or py in (0, 8) or pz in (0, 8)").collect() == []


def test_cells_shuffle_little_more_than_the_voxels(spark):
    """Not a row for each point that a voxel touches, eight at least."""
    rows = blocks(mixed(3, 4), lambda p, s: np.linalg.norm(p - 12) - 7.0)
    voxels = spark.createDataFrame(rows, VOXELS)
    assert shuffled_rows(dual_mesh.dual_cells(voxels)) < 3 * len(rows)


def test_cubes_that_batches_cut_are_whole(spark):
    rows = blocks(mixed(3, 4), lambda p, s: np.linalg.norm(p - 12.1) - 7.0)
    voxels = spark.createDataFrame(rows, VOXELS)
    want = sorted(map(tuple, dual_mesh.cell_indices(voxels).collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, dual_mesh.cell_indices(voxels).collect())) == want != []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
