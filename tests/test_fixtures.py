"""Literal cases with known answers, and round trips of files."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.functions import morton, rigid, sensors, strings
from voxelspark.operators import association, fusion, icp, images, keysets, mesh, octree, pyramid, raycast, voxels
from voxelspark.sources import config, readers, sinks

from .cost import shuffled_rows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_key_round_trip(spark):
    rows = spark.range(3000).select(*[((F.col("id") * k) % 524288).alias(c) for c, k in (("x", 7919), ("y", 104729), ("z", 131))])
    back = morton.decode_code(morton.encode_code(F.col("x"), F.col("y"), F.col("z")))
    assert rows.filter((back[0] != F.col("x")) | (back[1] != F.col("y")) | (back[2] != F.col("z"))).count() == 0


@pytest.mark.parametrize(("scale", "want"), [(0, 0x1FFFFFFFFFFFFE0), (1, 0x1FFFFFFFFFFFF00), (2, 0x1FFFFFFFFFFF800), (3, 0x1FFFFFFFFFFC000)])
def test_key_at_coarser_scales(spark, scale, want):
    code = F.lit(0x1FFFFFFFFFFFFE0 >> 5)
    assert one(spark, morton.code_at_scale(code, F.lit(scale))) << 5 == want


def test_unique_allocation_is_the_set_without_ancestors(spark):
    rng = np.random.default_rng(0)
    for _ in range(4):
        raw = [(int(c), int(s)) for c, s in zip(rng.integers(0, 1 << 15, 60), rng.integers(3, 14, 60), strict=True)]
        keys = {(c >> 3 * s << 3 * s, s) for c, s in raw}
        leaf = {(c, s) for c, s in keys if not any(t < s and (d >> 3 * s << 3 * s) == c for d, t in keys)}
        df = spark.createDataFrame([((c << 5) | s,) for c, s in keys], "key long")
        for at in (4, 12):
            got = {(r["key"] >> 5, r["key"] & 31) for r in keysets.unique_allocation(df, partitions_scale=at).collect()}
            assert got == leaf


def test_allocation(spark):
    code = lambda x, y, z: one(spark, morton.encode_code(F.lit(x), F.lit(y), F.lit(z)))
    keys = spark.createDataFrame([(((code(x, y, z) >> 9 << 9) << 5) | 3,) for x, y, z in ((33, 104, 55), (113, 144, 155), (233, 44, 255))], "key long")
    have = octree.allocate(keys, 8)
    assert octree.allocate(keys, 8, existing=have, only_allocated=True).count() == 0
    blocks = octree.with_children(have).filter("is_block").select(*[c.alias(n) for c, n in zip(morton.key_coord(F.col("key")), "xyz", strict=True)])
    assert sorted(map(tuple, blocks.collect())) == [(32, 104, 48), (112, 144, 152), (232, 40, 248)]


def test_map_sizes():
    cases = {(12.8, 0.1): 128, (25.6, 0.1): 256, (51.2, 0.1): 512, (10.24, 0.01): 1024, (20.48, 0.01): 2048, (10.24, 0.02): 512, (20.48, 0.02): 1024, (10, 0.05): 256, (100, 0.05): 2048}
    assert {k: octree.map_size(*k) for k in cases} == cases


def test_interpolation_between_eight_blocks(spark):
    rows = [(8 * (i & 1) + x, 8 * (i >> 1 & 1) + y, 8 * (i >> 2) + z, float(i), 1) for i in range(8) for x in range(8) for y in range(8) for z in range(8)]
    vox = spark.createDataFrame(rows, "vx int, vy int, vz int, tsdf double, weight int")
    points = [(2, 2, 2), (8, 2, 2), (2, 8, 2), (8, 8, 2), (2, 2, 8), (8, 2, 8), (2, 8, 8), (8, 8, 8), (16, 16, 16)]
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "id int, x double, y double, z double")
    got = {r["id"]: r["value"] for r in voxels.interpolate(df, vox).collect()}
    assert [got[k] for k in range(9)] == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, None]


def test_numeric_strings(spark):
    s = ["42", "-2", "12.42", ".1", "-3.7", "-0.5f", "0-1", "1.3.", "0xD8", "7A", "abc.", ""]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(s)], "k int, s string").orderBy("k")
    c = F.col("s")
    pick = lambda col: [int(r[0]) for r in df.select(col).collect()]
    assert pick(strings.is_int(c)) == [1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert pick(strings.is_float(c)) == [1, 1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0]
    assert pick(strings.is_int(c, non_negative=True)) == [1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert pick(strings.is_float(c, non_negative=True)) == [1, 0, 1, 1, 0, 0, 0, 0, 1, 0, 0, 0]


def test_clamped_mean_is_the_running_fold(spark):
    rng = np.random.default_rng(1)
    rows = [(g, k, float(v)) for g, n in enumerate((1, 4, 5, 30)) for k, v in enumerate(rng.random(n))]
    got = {r["g"]: r for r in fusion.clamped_mean(spark.createDataFrame(rows, "g int, k int, v double"), ["g"], "k", "v", 5).collect()}
    for g in range(4):
        mean, w = 0.0, 0
        for _, _, v in (r for r in rows if r[0] == g):
            w = min(w + 1, 5)
            mean = (mean * (w - 1) + v) / w
        assert abs(got[g]["mean"] - mean) < 1e-12 and got[g]["weight"] == w


def test_wall_four_metres_away(spark):
    """A flat wall allocates a slab of the band's thickness around its distance."""
    camera = sensors.Pinhole(100.0, 100.0, 49.5, 49.5, 100, 100, near=0.1, far=10.0)
    vmap = fusion.VoxelMap(dim=12.8, res=0.1, truncation=8.0)
    pixels = spark.range(10000).select(F.lit(0).cast("long").alias("frame"), (F.col("id") % 100).cast("int").alias("x"), F.floor(F.col("id") / 100).cast("int").alias("y"), F.lit(4.0).alias("depth"))
    poses = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "frame long, tx double, ty double, tz double")
    blocks = fusion.surface_blocks(pixels, poses, camera, vmap)
    low, high = blocks.agg(F.min("bz"), F.max("bz")).first()
    edge = 0.8
    assert low * edge - 6.4 <= 4 - 0.8 + 1e-9 and high * edge - 6.4 + edge >= 4 + 0.7
    fused = fusion.fuse(pixels, poses, camera, vmap, few=True)
    centre = fused.filter("vx = 64 and vy = 64").select(((F.col("vz") + 0.5) * 0.1 - 6.4).alias("z"), "tsdf").collect()
    for r in centre:
        if abs(r["z"] - 4) < 0.7:
            assert abs(r["tsdf"] - (4 - r["z"]) / 0.8) < 0.02


def test_wall_before_a_turned_camera(spark):
    """The same wall, the camera mounted so that it looks along x with its image's y down: the slab is on x."""
    camera = sensors.Pinhole(100.0, 100.0, 49.5, 49.5, 100, 100, near=0.1, far=10.0)
    vmap = fusion.VoxelMap(dim=12.8, res=0.1, truncation=8.0)
    pixels = spark.range(10000).select(F.lit(0).cast("long").alias("frame"), (F.col("id") % 100).cast("int").alias("x"), F.floor(F.col("id") / 100).cast("int").alias("y"), F.lit(4.0).alias("depth"))
    # Camera x to world -y, y to -z, z to x; of twice the unit length, which changes nothing.
    poses = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, -1.0, 1.0, -1.0)], "frame long, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    row = fusion.posed(poses).first()
    assert np.allclose([[row[f"r{i}{j}"] for j in range(3)] for i in range(3)], [[0, 0, 1], [-1, 0, 0], [0, -1, 0]])
    low, high, y0, y1, z0, z1 = fusion.surface_blocks(pixels, poses, camera, vmap).agg(*[f(f"b{c}") for c in "xyz" for f in (F.min, F.max)]).first()
    assert low * 0.8 - 6.4 <= 4 - 0.8 + 1e-9 and high * 0.8 - 6.4 + 0.8 >= 4 + 0.7 and low >= 12
    assert y0 + y1 == 15 and z0 + z1 == 15
    plain = pixels.sparkSession.createDataFrame([(0, 0.0, 0.0, 0.0)], "frame long, tx double, ty double, tz double")
    straight = {(r["vx"], r["vy"], r["vz"]): r["tsdf"] for r in fusion.fuse(pixels, plain, camera, vmap, few=True).collect()}
    fused = {(r["vx"], r["vy"], r["vz"]): r["tsdf"] for r in fusion.fuse(pixels, poses, camera, vmap, few=True).collect()}
    # World (x, y, z) is the unturned camera's (-y, -z, x), which mirrors the voxels' numbers. On seams between
    # blocks the mirrored sample falls into the next block, so the sets may differ there, but no value does.
    turned = {(127 - y, 127 - z, x): t for (x, y, z), t in fused.items()}
    both = turned.keys() & straight.keys()
    assert len(both) > 0.9 * len(straight) and all(abs(turned[k] - straight[k]) < 1e-6 for k in both)


def test_fusion_makes_no_row_of_an_observation(spark):
    """Folded visits give the running mean of the observations, in one go or over an earlier map, and only visits are shuffled."""
    camera = sensors.Pinhole(8.0, 8.0, 3.5, 3.5, 8, 8, near=0.1, far=6.0)
    vmap = fusion.VoxelMap(dim=12.8, res=0.4, truncation=2.0, max_weight=4)
    rng = np.random.default_rng(3)
    images = [(f, [None if rng.random() < 0.1 else float(1.5 + rng.random()) for _ in range(64)], 0.1 * (f % 5), 0.0, 0.0, 3.0, 1.0 * (f % 2), 2.0, -1.0) for f in range(40)]
    frames = fusion.posed(spark.createDataFrame(images, "frame long, depth array<double>, tx double, ty double, tz double, qw double, qx double, qy double, qz double"))
    seen = fusion.visits(fusion.surface_samples(frames, camera, vmap), frames, camera, vmap)
    rows = fusion.clamped_mean(fusion.observations(seen, frames, camera, vmap), ["v"], "frame", "u", 4).select(*fusion.voxel_of(F.col("v"), vmap), F.col("mean").alias("tsdf"), "weight")
    plain = lambda d: {tuple(r)[:3]: (round(r["tsdf"], 9), r["weight"]) for r in d.collect()}
    want = plain(rows)
    whole = fusion.fuse_frames(frames, camera, vmap)
    assert plain(whole) == want and max(w for _, w in want.values()) == 4
    first = fusion.fold_visits(seen.filter("frame < 17"), frames, camera, vmap)
    assert plain(fusion.fold_visits(seen.filter("frame >= 17"), frames, camera, vmap, first)) == want
    assert "Window" not in whole._jdf.queryExecution().executedPlan().toString()


def test_block_fusion_follows_turned_cameras(spark):
    from voxelspark.streaming import blocks

    camera = sensors.Pinhole(8.0, 8.0, 3.5, 3.5, 8, 8, near=0.1, far=6.0)
    vmap = fusion.VoxelMap(dim=12.8, res=0.4, truncation=2.0)
    rng = np.random.default_rng(0)
    rows = [(f, x, y, float(1.5 + 0.3 * rng.random())) for f in range(3) for x in range(8) for y in range(8)]
    px = spark.createDataFrame(rows, "frame long, x int, y int, depth double")
    po = spark.createDataFrame([(f, 0.1 * f, 0.0, 0.0, 3.0, 1.0 * f, 2.0, -1.0) for f in range(3)], "frame long, tx double, ty double, tz double, qw double, qx double, qy double, qz double")
    got = {(r["vx"], r["vy"], r["vz"]): (round(r["value"], 9), r["weight"]) for r in blocks.fuse(px, po, camera, vmap, occupancy=False).filter("scale = 0").collect()}
    want = {tuple(r)[:3]: (round(r["tsdf"], 9), r["weight"]) for r in fusion.fuse(px, po, camera, vmap).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_images_are_packed_by_rows(spark):
    camera = sensors.Pinhole(8.0, 8.0, 1.0, 1.0, 3, 2)
    px = spark.createDataFrame([(0, 2, 1, 6.0), (0, 0, 0, 1.0), (0, 1, 0, 2.0), (0, 1, 0, 9.0), (1, 0, 1, 4.0), (1, 7, 0, 5.0)], "frame long, x int, y int, depth double")
    po = spark.createDataFrame([(f, 0.0, 0.0, 0.0) for f in range(3)], "frame long, tx double, ty double, tz double")
    got = {r["frame"]: r["depth"] for r in fusion.packed(px, po, camera).collect()}
    assert got == {0: [1.0, 2.0, None, None, None, 6.0], 1: [None, None, None, 4.0, None, None]}


def test_blocks_on_a_ray_are_all_found(spark):
    rng = np.random.default_rng(4)
    rays = [(0, 7.9, 7.85, 3.5, 2**-0.5, 2**-0.5, 0.0)]
    for k in range(1, 40):
        d = rng.normal(size=3)
        rays.append((k, *(float(x) for x in rng.random(3) * 60), *(float(x) for x in d / np.linalg.norm(d))))
    df = spark.createDataFrame(rays, "id int, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {}
    for r in raycast.blocks_on_ray(df, 30.0).orderBy("id", "n").collect():
        got.setdefault(r["id"], []).append((r["bx"], r["by"], r["bz"]))
    assert got[0][:3] == [(0, 0, 0), (1, 0, 0), (1, 1, 0)]
    for k, *ray in rays:
        o, d = np.array(ray[:3]), np.array(ray[3:])
        dense = [tuple(b) for b in np.floor((o + np.arange(0, 30, 0.002)[:, None] * d) / 8).astype(int).tolist()]
        assert set(dense) <= set(got[k]) and all(np.abs(np.subtract(a, b)).sum() == 1 for a, b in zip(got[k], got[k][1:], strict=False) if k)


def test_frames_are_dropped_while_one_is_worked_on(spark):
    cost = {0: 0.45, 7: 0.15, 9: 0.31}
    rows = [(s, f, cost.get(f, 0.05)) for s in (0, 1) for f in range(s, 16)]
    df = spark.createDataFrame(rows, "s int, frame long, cost double").repartition(3)
    got = {(r["s"], r["frame"]): r["keep"] for r in association.paced(df, 10.0, F.col("cost"), ["s"]).collect()}
    for s in (0, 1):
        free = float("-inf")
        for f in range(s, 16):
            keep = f / 10 >= free - 1e-9
            assert got[s, f] == keep, (s, f)
            free = f / 10 + cost.get(f, 0.05) if keep else free
    assert [f for f in range(6) if got[0, f]] == [0, 5]


def test_interpolated_poses_turn_on_the_arc(spark):
    columns = ["px", "qx", "qy", "qz", "qw"]
    half = float(np.sin(np.pi / 4))
    poses = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 100, 1.0, 0.0, 0.0, -half, -half)], "id int, ts long, px double, qx double, qy double, qz double, qw double")
    items = spark.createDataFrame([(7, 25)], "id int, ts long")
    r = association.at_times(items, poses, columns, 100).first()
    want = (0.25, 0.0, 0.0, np.sin(np.pi / 16), np.cos(np.pi / 16))
    assert np.allclose([r[c] for c in columns], want, atol=1e-12)


def test_step_field_gives_a_plane(spark):
    rows = [(x, y, z, 1.0 if x < 4 else -1.0, 1) for x in range(8) for y in range(8) for z in range(8)]
    faces = mesh.marching_cubes(spark.createDataFrame(rows, "vx int, vy int, vz int, tsdf double, weight int"))
    whole = mesh.face_rows(faces)
    assert whole.count() == 2 * 49 and faces.filter("abs(x - 4) > 1e-9").count() == 0
    assert mesh.edge_ids(faces).select("vertex").distinct().count() == 64
    n = mesh.vertex_normals(faces).select("nx", "ny", "nz").distinct().collect()
    assert all(abs(abs(r["nx"]) - 1) < 1e-9 for r in n) and len({round(r["nx"]) for r in n}) == 1


@pytest.mark.parametrize("case", range(256))
def test_surfaces_part_every_cell(case):
    """Each crossing edge is used, and inner edges of the surface are used once in each direction."""
    tris = mesh.triangles(case)
    crossing = {k for k, (a, b) in enumerate(mesh.EDGES) if (case >> a & 1) != (case >> b & 1)}
    assert {e for t in tris for e in t} == crossing
    sides = [(t[i], t[(i + 1) % 3]) for t in tris for i in range(3)]
    assert len(set(sides)) == len(sides)
    border = [s for s in sides if s[::-1] not in sides]
    assert sorted(a for a, _ in border) == sorted(b for _, b in border) == sorted(crossing)


def test_parents_bound_children(spark):
    rng = np.random.default_rng(2)
    rows = [(x, y, z, float(rng.normal()), int(rng.integers(0, 3)), True) for x in range(8) for y in range(8) for z in range(8)]
    df = spark.createDataFrame(rows, "vx int, vy int, vz int, occupancy double, weight int, observed boolean")
    up = {(r["vx"], r["vy"], r["vz"]): r for r in pyramid.extremes(df).collect()}
    for x, y, z, o, w, _ in rows:
        if w:
            p = up[x // 2, y // 2, z // 2]
            assert p["low_value"] * p["low_weight"] <= o * w <= p["high_value"] * p["high_weight"]


def test_free_space_is_free(spark):
    ism = lambda d: one(spark, fusion.inverse_sensor_model(F.lit(d), F.lit(0.2), F.lit(0.1)))
    assert ism(-1.0) == -5.015 and ism(0.0) == 0 and ism(0.3) is None
    assert abs(ism(0.1) - ism(0.15)) < 1e-12 and fusion.occupancy_max_weight() == 20


def test_rays_through_a_step(spark):
    rows = [(x, y, z, 1.0 if x < 8 else -1.0, 1) for x in range(16) for y in range(4) for z in range(4)]
    vox = spark.createDataFrame(rows, "vx int, vy int, vz int, tsdf double, weight int")
    rays = spark.createDataFrame([(0, 1.0, 2.0, 2.0, 1.0, 0.0, 0.0), (1, 15.0, 2.0, 2.0, 1.0, 0.0, 0.0)], "id int, ox double, oy double, oz double, dx double, dy double, dz double")
    hit = raycast.cast_surface(raycast.samples(rays, vox, 26, 0.5), 0.5).collect()
    assert [(r["id"], round(r["t"], 6)) for r in hit] == [(0, 7.0)]


def test_rays_reach_a_far_step(spark):
    # Ray 0 meets a step at 60; ray 1 goes from outside to inside over a gap, where no change of sign is seen.
    rows = [(x, y, z, 1.0 if x < 60 else -1.0, 1) for x in range(72) for y in range(4) for z in range(4)]
    rows += [(x, y, z, 1.0 if x < 8 else -1.0, 1) for x in (*range(8), *range(32, 48)) for y in range(16, 20) for z in range(4)]
    vox = spark.createDataFrame(rows, "vx int, vy int, vz int, tsdf double, weight int")
    rays = spark.createDataFrame([(0, 1.0, 2.0, 2.0, 1.0, 0.0, 0.0), (1, 1.0, 18.0, 2.0, 1.0, 0.0, 0.0)], "id int, ox double, oy double, oz double, dx double, dy double, dz double")
    for near in (24, 117, 118, 119, 400):  # also where the rounds part at the step
        hit = raycast.march(lambda along: raycast.cast_surface(along, 0.5), rays, vox, 400, 0.5, near).collect()
        assert [(r["id"], round(r["t"], 6)) for r in hit] == [(0, 59.0)]


def test_alignment_recovers_a_small_motion(spark):
    camera = sensors.Pinhole(40.0, 40.0, 15.5, 15.5, 32, 32)
    depth = lambda t: F.lit(2.0) + F.sin((F.col("x") + t) / 5) * 0.2 + F.cos(F.col("y") / 4) * 0.2
    grid = spark.range(1024).select(F.lit(0).alias("frame"), (F.col("id") % 32).cast("int").alias("x"), F.floor(F.col("id") / 32).cast("int").alias("y"))
    cloud = images.point_cloud(grid.withColumn("depth", depth(0.0)), camera)
    points = cloud.join(images.normals(cloud), ["frame", "x", "y"]).cache()
    moved = points.withColumn("pz", F.col("pz") - 0.02)
    pose, good = icp.align([(moved, points, camera, 6)], np.eye(4), distance=0.2, cosine=0.7)
    assert good and abs(pose[2, 3] - 0.02) < 5e-3 and np.abs(pose[:2, 3]).max() < 1e-2


def test_half_median_and_sigma(spark):
    px = spark.createDataFrame([(0, x, y, d) for (x, y), d in {(0, 0): 1.0, (1, 0): 3.0, (0, 1): 0.0, (1, 1): 2.0, (2, 0): 0.0, (3, 0): 0.0, (2, 1): 0.0, (3, 1): 0.0}.items()], "frame int, x int, y int, depth double")
    got = {(r["x"], r["y"]): (r["depth"], r["idx"]) for r in images.downsample(px, 4, 2).collect()}
    assert got == {(0, 0): (2.0, 5), (1, 0): (0.0, 2)}
    assert one(spark, images.depth_sigma(F.lit(2.0), 0.05, 0.005, 0.08)) == 0.08


def test_association_and_status(spark):
    a = spark.createDataFrame([(1, 100), (2, 200), (3, 999)], "id int, ts long")
    b = spark.createDataFrame([(7, 95), (8, 105), (9, 230)], "id int, ts long")
    assert sorted(map(tuple, association.nearest(a, b, 30).collect())) == [(1, 7, 5), (2, 9, 30)]
    rows = spark.createDataFrame([(1, "ok"), (1, "skip"), (2, "eof"), (2, "ok")], "g int, status string")
    assert sorted(map(tuple, association.merge_status(rows, ["g"]).collect())) == [(1, "skip", True), (2, "eof", False)]


def test_text_readers(spark, tmp_path):
    (tmp_path / "depth.txt").write_text("# a comment\n0.5 a.png\n1.25 b.png\n")
    assert [tuple(r)[1:] for r in readers.image_list(spark, str(tmp_path / "depth.txt")).orderBy("id").collect()] == [(0.5, "a.png"), (1.25, "b.png")]
    (tmp_path / "bad.txt").write_text("0.5 a.png\n-1 b.png\n")
    assert readers.image_list(spark, str(tmp_path / "bad.txt")).count() == 0
    (tmp_path / "gt.txt").write_text("0 1 2 3 0 0 0 1\n1 1 2 3 0 0 1 0\n")
    assert readers.pose_list(spark, str(tmp_path / "gt.txt")).filter("tx = 1 and tz = 3").count() == 2
    (tmp_path / "a.txt").write_text("7 x 1 2 3 0 0 0 1\n8 y 1 2 3 0 0 0 2\n1 2\n9 z nan 2 3 0 0 0 1\n")
    assert [r["status"] for r in readers.association(spark, str(tmp_path / "a.txt")).orderBy("id").collect()] == ["ok", "skip", "error", "skip"]
    (tmp_path / "data.csv").write_text("#timestamp,filename\r\n10,x.png\r\n")
    assert readers.image_csv(spark, str(tmp_path / "data.csv")).first()["file"] == "x.png"
    (tmp_path / "cam.ccam").write_text("#\n600 320 240 0 0 0 1 0 0 0 5 6 7 640 480\nshort line\n")
    assert tuple(readers.camera_poses(spark, str(tmp_path / "cam.ccam")).first())[1:] == (5.0, 6.0, 7.0, 0.0, 1.0, 0.0, 0.0)
    (tmp_path / "lidar.csv").write_text("t,x,y,z,i\n100,1,2,3,4\n300,1,2,3,4\n")
    (tmp_path / "trajectory.csv").write_text("id,t,x,y,z,w,x,y,z\n0,200,0,0,0,1,0,0,0\n")
    rays = readers.create("LEICA", spark, str(tmp_path / "lidar.csv"))
    assert [r["ts"] for r in readers.after_first_pose(rays, readers.trajectory_csv(spark, str(tmp_path / "trajectory.csv"))).collect()] == [300]
    with pytest.raises(ValueError):
        readers.create("openni", spark, "x")


def test_binary_readers(spark, tmp_path):
    depth, rgb = np.arange(12, dtype="<u2").reshape(3, 4) * 100, np.arange(36, dtype=np.uint8)
    frame = struct.pack("<II", 4, 3) + depth.tobytes() + struct.pack("<II", 4, 3) + rgb.tobytes()
    (tmp_path / "scene.raw").write_bytes(frame * 2 + b"cut off")
    got = readers.raw(spark, str(tmp_path / "scene.raw"))
    assert got.count() == 24 and got.filter("frame = 1 and x = 1 and y = 2 and abs(depth - 0.9) < 1e-9 and r = 27").count() == 1
    image = np.where(np.subtract.outer(np.arange(64), np.arange(64)) < 0, 0, np.where(np.eye(64, dtype=bool), 32767, 65535)).astype(np.uint16)
    assert (readers.decode_png(readers.encode_png(image)) == image).all()
    px = spark.createDataFrame([(x, y, float(image[y, x]) / 5000) for y in range(64) for x in range(64)], "x int, y int, depth double")
    for kind in ("png", "pgm"):
        path = str(tmp_path / f"pattern.{kind}")
        sinks.save_depth(px, path, 64, 64, 5000)
        back = readers.depth_images(spark, path).select("x", "y", F.round(F.col("depth") * 5000).cast("int").alias("d")).collect()
        assert all(image[r["y"], r["x"]] == r["d"] for r in back) and len(back) == 4096
    (tmp_path / "cloud_1583836591_182590976.pcd").write_text("VERSION 0.7\nDATA ascii\n" + "".join(f"{k} 0 0\n" for k in range(128)))
    scan = readers.scans(spark, str(tmp_path)).orderBy("y", "x").collect()
    assert len(scan) == 128 and {(r["x"], r["y"], r["range"]) for r in scan} >= {(0, 0, 0.0), (1, 0, 64.0), (0, 1, 1.0)}


@pytest.mark.parametrize("kind", ["ply", "vtk", "obj"])
def test_mesh_files(spark, tmp_path, kind):
    rows = [(0, 0, 0, k, (0.0, 0.0, float(k)), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)) for k in range(3)]
    place = "struct<x: double, y: double, z: double>"
    faces = spark.createDataFrame(rows, f"vx int, vy int, vz int, face int, a {place}, b {place}, c {place}")
    path = str(tmp_path / f"m.{kind}")
    sinks.save_mesh(faces, path, 2.0, (1.0, 0.0, 0.0))
    text = open(path).read()
    assert text.count("3.000000 0.000000 0.000000") == 3
    assert {"ply": "element vertex 9", "vtk": "POLYGONS 3 12", "obj": "f 7 8 9"}[kind] in text
    with pytest.raises(ValueError):
        sinks.save_mesh(faces, str(tmp_path / "m.stl"))


def test_turned_mesh_and_points(spark, tmp_path):
    """Half a turn about z, then a metre along y; points in the order of id."""
    pose = rigid.pose_matrix((0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 2.0))
    place = "struct<x: double, y: double, z: double>"
    faces = spark.createDataFrame([((1.0, 0.0, 0.0), (2.0, 3.0, 0.0), (0.0, 0.0, 5.0))], f"a {place}, b {place}, c {place}")
    sinks.save_mesh(faces, str(tmp_path / "m.obj"), 2.0, pose=pose)
    assert (tmp_path / "m.obj").read_text().replace("-0.000000", "0.000000").splitlines()[:3] == ["v -2.000000 1.000000 0.000000", "v -4.000000 -5.000000 0.000000", "v 0.000000 1.000000 10.000000"]
    points = spark.createDataFrame([(2, 1.0, 1.0, 1.0), (1, 0.0, 0.0, 0.0), (3, None, 0.0, 0.0)], "id int, x double, y double, z double").filter("x is not null")
    sinks.save_points(points, str(tmp_path / "p.vtk"), pose=pose)
    assert (tmp_path / "p.vtk").read_text().replace("-0.000000", "0.000000").splitlines()[-2:] == ["0.000000 1.000000 0.000000", "-1.000000 0.000000 1.000000"]


def test_rigid_motions(spark):
    """Columns against the driver's matrices, at small angles too; powers of two and fractions."""
    rows = [(0.3, -0.2, 0.1, a * 0.6, a * -0.48, a * 0.64, 1.0, 2.0, 3.0) for a in (0.0, 1e-9, 5e-4, 2e-3, 0.5, 3.0)]
    names = ["tx", "ty", "tz", "wx", "wy", "wz", "px", "py", "pz"]
    cols = lambda k: tuple(F.col(f"{k}{c}") for c in "xyz")
    at = rigid.moved(cols("t"), cols("w"), cols("p"))
    for r in spark.createDataFrame(rows, names).select("*", *[v.alias(f"o{c}") for c, v in zip("xyz", at, strict=True)]).collect():
        want = icp.exp(np.array(r[:6])) @ np.array([*r[6:9], 1.0])
        assert np.allclose([r["ox"], r["oy"], r["oz"]], want[:3], atol=1e-8)
    up = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (float(2**29),), (2.0**29 + 1,)], ["x"]).select(rigid.power_two_up(F.col("x"))).collect()
    assert [r[0] for r in up] == [1, 1, 2, 2, 2**29, 2**30]
    part = spark.createDataFrame([(-0.25,), (1.5,)], ["x"]).select(rigid.fraction(F.col("x")), rigid.plane_normal((F.col("x"), F.lit(0.0), F.lit(0.0)), (F.col("x"), F.lit(1.0), F.lit(0.0)), (F.col("x"), F.lit(1.0), F.lit(1.0)))[0]).collect()
    assert [tuple(r) for r in part] == [(0.75, 1.0), (0.5, 1.0)]


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("%YAML:1.2\nmap:\n  dim: [1, 2, 3]\n  res: 0.05\nreader:\n  reader_type: tum\n  fps: fast\n  sequence_path: data\nsensor: {}\ndata: {}\ntracker: {}\napp: {}\n")
    with pytest.warns(UserWarning, match="fps"):
        c = config.load(str(tmp_path / "c.yaml"))
    assert c.map.dim == (1.0, 2.0, 3.0) and c.reader.fps == 0.0 and c.reader.sequence_path == str(tmp_path / "data")


def test_ranked_orders_every_row_over_many_ranges(spark):
    keys = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("key"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are one range
    try:
        rows = keysets.ranked(keys, F.desc("key"))
        assert rows.rdd.getNumPartitions() > 1
        got = sorted((r["rank"], r["key"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    want = sorted((k * 7919 % 5003 for k in range(5000)), reverse=True)
    assert got == list(enumerate(want, 1))
    assert keysets.ranked(keys.limit(0), F.asc("key")).collect() == []


def test_points_meet_cubes_of_voxels_by_one_sorted_join(spark):
    """A stencil is one lookup however small the tables seem: no point is sent to all tasks, none is multiplied before it is joined."""
    from voxelspark.operators import raycast

    rng = np.random.default_rng(4)
    at = [(x, y, z) for x in range(-3, 18) for y in range(-2, 12) for z in range(9)]
    field = {p: (float(rng.random()), int(rng.random() > 0.02)) for p in at}
    vox = spark.createDataFrame([(*p, *v) for p, v in field.items()], "vx int, vy int, vz int, tsdf double, weight int")
    pts = [(k, *(float(v) for v in rng.random(3) * (20, 13, 9) - (2.5, 1.5, 0))) for k in range(400)]
    points = spark.createDataFrame([*pts, (400, None, 1.0, 1.0)], "id int, x double, y double, z double")

    def want(p):
        b, total = np.floor(np.array(p) - 0.5).astype(int), 0.0
        f = np.array(p) - 0.5 - b
        for i in np.ndindex(2, 2, 2):
            v, w = field.get(tuple((b + i).tolist()), (0.0, 0))
            if not w:
                return None
            total += v * np.prod(np.where(i, f, 1 - f))
        return total

    out = voxels.interpolate(points, vox)
    got = {r["id"]: r["value"] for r in out.collect()}
    expected = {k: want(p) for k, *p in pts}
    assert got.pop(400) is None and got.keys() == expected.keys() and 50 < sum(v is None for v in expected.values()) < 350
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in expected.items())
    rays = points.filter("x is not null").selectExpr("id", "x AS ox", "y AS oy", "z AS oz", "1D AS dx", "0D AS dy", "0D AS dz")
    along = raycast.samples(rays, vox, 6, 0.5)
    assert {(r["id"], r["k"]): round(r["value"], 9) for r in along.collect()} == {(k, n): round(v, 9) for k, x, y, z in pts for n in range(7) if (v := want((x + n * 0.5, y, z))) is not None}
    for rows in (out, voxels.gradient(points, vox), voxels.interpolate_scales(points, [vox]), along):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        physical = rows._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in physical and physical.count("SortMergeJoin") == 1 and plan.count("Join") == 1


def test_nearest_shuffles_no_row_for_each_neighbour(spark):
    """Many equal and near times: one walk through each bin, not each row with each."""
    rng = np.random.default_rng(3)
    left, right = ([(k, int(t)) for k, t in enumerate(rng.integers(0, 3000, n))] for n in (400, 300))
    a, b = (spark.createDataFrame(rows, "id long, ts long") for rows in (left, right))
    for tolerance in (7, 100):
        want = {i: min((abs(t - at), at, m) for m, at in right) for i, t in left}
        got = {r["id"]: (r["match"], r["delta"]) for r in association.nearest(a, b, tolerance).collect()}
        assert got == {i: (m, d) for i, (d, _, m) in want.items() if d <= tolerance}
    plan = association.nearest(a, b, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_cameras_try_only_cells_around_blocks(spark):
    at = [F.lit(v).cast("long") for v in (40, 48, 8)]
    keys = spark.range(1).select(morton.encode_key(morton.encode_code(*at), F.lit(3)).alias("key"))
    octants = octree.with_children(keys)
    poses = spark.range(30).selectExpr("id AS frame", "-11.0D AS tx", "-10.0D AS ty", "-16.0D AS tz")
    camera, wide = sensors.Pinhole(8.0, 8.0, 3.5, 3.5, 8, 8, near=0.1, far=10.0), fusion.VoxelMap(dim=25.6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = octree.in_frustum(octants, poses, camera, wide)
        assert found.count() == 30 and shuffled_rows(found) <= 5 * 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rays_leave_their_samples_where_they_are(spark, monkeypatch):
    """Only rays, their pieces in regions, voxels and hits are shuffled, however many samples a ray has; regions that many rays pass are copied."""
    rng = np.random.default_rng(8)
    rows = [(x, y, z, float(rng.random() - 0.3), int(rng.random() > 0.01)) for x in range(-20, 60) for y in range(28, 40) for z in range(4)]
    vox = spark.createDataFrame(rows, "vx int, vy int, vz int, tsdf double, weight int").persist()
    turn = rng.random(300) * 2 * np.pi
    some = [(k, *(float(v) for v in rng.random(3) * (100, 14, 2) + (-30, 27, 1)), float(np.cos(t)), float(np.sin(t) / 4), 0.0) for k, t in enumerate(turn)]
    names = ("ox", "oy", "oz", "dx", "dy", "dz")
    rays = spark.createDataFrame([*some, (300, None, 30.0, 2.0, 1.0, 0.0, 0.0), (301, 5.0, 34.0, 2.0, 0.0, 0.0, 0.0)], f"id long, {', '.join(f'{c} double' for c in names)}").persist()
    blocks = raycast.occupied_blocks(vox).persist()
    casts = (
        (raycast.surface_hits, lambda along: raycast.cast_surface(along, 0.5)),
        (raycast.known_hits, lambda along: raycast.first_known(along, 0.5)),
        (raycast.occupied_hits, lambda along: raycast.cast_occupied(along, 0.5)),
    )
    found = lambda df: {r["id"]: round(r["t"], 9) for r in df.collect()}
    for open_, which in ((None, casts), (blocks, casts[2:])):
        along = raycast.samples(rays, vox, 120, 0.5, blocks=open_).persist()
        for (whole, cast), (near, share) in zip(which, ((24, 7), (120, 1 << 15), (24, 1 << 15))):
            monkeypatch.setattr(raycast, "PER_COPY", share)
            want = found(cast(along))
            assert len(want) > 50 and max(want.values()) > 12
            assert found(whole(rays=rays, voxels=vox, steps=120, step=0.5, near=near, blocks=open_)) == want
    monkeypatch.setattr(raycast, "PER_COPY", 1 << 15)
    one = lambda before, value: value > 9
    short, long = (shuffled_rows(raycast.first_hits(rays, vox, 40, step, one, near=40)) for step in (0.5, 0.125))
    assert long <= short < 10_000
    with pytest.raises(Exception, match="length of 1"):
        raycast.known_hits(rays=rays.withColumn("dx", F.lit(2.0)), voxels=vox, steps=9, step=0.5).collect()


def test_images_are_cut_in_a_stream_of_frames(spark):
    """Parts of images are cut where a frame's image passes its visits: no join, no whole image in a visit's row; images are dealt out before they are worked on."""
    from voxelspark.plans import fusion as plans

    rng = np.random.default_rng(5)
    camera, vmap = sensors.Pinhole(8.0, 8.0, 3.5, 3.5, 8, 8, near=0.1, far=10.0), fusion.VoxelMap()
    images = {f: None if f == 3 else [None if v < 0.1 else float(v) for v in rng.random(64) * 4] for f in range(7)}
    frames = spark.createDataFrame([(f, i, f * 0.1, 0.0, -0.2) for f, i in images.items() if f != 5], "frame long, depth array<double>, tx double, ty double, tz double")
    at = [(*(int(v) for v in rng.integers((10, 10, 15), (22, 22, 24))), f) for f in range(7) for _ in range(40)]
    seen = spark.createDataFrame([(*a, a[3] * 0.1, 0.0, -0.2) for a in at], "bx int, by int, bz int, frame long, tx double, ty double, tz double")
    out = fusion.cropped(seen, frames, camera, vmap)
    rows = out.collect()
    assert sorted((r["bx"], r["by"], r["bz"], r["frame"]) for r in rows) == sorted(a for a in at if a[3] != 5)
    sizes = set()
    for r in rows:
        got = np.frombuffer(r["depth"], float)
        sizes.add(len(got))
        whole = np.array([np.nan if v is None else v for v in images[r["frame"]] or [None] * 64], dtype=float).reshape(8, 8)
        want = whole[r["y0"] : r["y0"] + len(got) // r["wide"], r["x0"] : r["x0"] + r["wide"]].reshape(-1) if len(got) else got
        np.testing.assert_array_equal(got, want)
        known = got[~np.isnan(got)]
        assert r["most"] == (known.max() if len(known) else None)
        # Every voxel that projects into the image finds its pixel in the part.
        p = [(r[f"b{c}"] * 8 + rng.random(20) * 8) * vmap.res - vmap.dim / 2 - r[f"t{c}"] for c in "xyz"]
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (np.floor(p[k] * 8.0 / p[2] + 4.0) for k in (0, 1))
        ok = (p[2] > 0) & (u >= 0) & (u < 8) & (v >= 0) & (v < 8)
        if images[r["frame"]] and ok.any():
            assert len(got) and (u[ok] >= r["x0"]).all() and (u[ok] < r["x0"] + r["wide"]).all() and (v[ok] >= r["y0"]).all() and (v[ok] < r["y0"] + len(got) / r["wide"]).all()
    assert 0 in sizes and 64 in sizes and len(sizes) > 4
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    # The frames that see the map are found after the table's rows are dealt out.
    plan = fusion.sighted(plans.frames(spark, "/root/testdata/sf0.001"), camera, vmap)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("exists(") < plan.index("RepartitionByExpression")


def test_projection_finds_what_plain_projection_finds():
    """Also where images reach to their borders, pixels are missing or too near and voxels are behind the camera."""
    rng = np.random.default_rng(6)
    camera, vmap = sensors.Pinhole(8.0, 8.0, 3.5, 3.5, 8, 8, near=0.1, far=3.0), fusion.VoxelMap()
    n, total = 20, 0
    image = np.where(rng.random((n, 64)) < 0.1, np.nan, rng.random((n, 64)) * 3)
    for turned in (False, True):
        for corner in ((128, 124, 124), (128, 130, 140), (130, 128, 176)):
            q = np.linalg.qr(rng.normal(size=(n, 3, 3)) * 0.2 + np.eye(3))[0]
            turn = q * np.sign(np.einsum("nii->ni", q))[:, None, :] if turned else None
            pose, zero = rng.random((n, 3)) * 0.3, np.zeros(n, dtype=int)
            row, k, u = fusion.distances(np.array(corner), pose, turn, fusion.depths(image.reshape(-1), camera), np.arange(n) * 64 + 1, zero, zero, zero + 8, camera, vmap)
            got, want = {(int(r), int(i)): v for r, i, v in zip(row, k, u, strict=True)}, {}
            for r in range(n):
                for i in range(512):
                    p = (np.array(corner) + (i % 8, i // 8 % 8, i // 64) + 0.5) * vmap.res - vmap.dim / 2 - pose[r]
                    x, y, z = p if turn is None else turn[r].T @ p
                    if not 0 < z <= camera.far:
                        continue
                    a, b = np.floor(x * 8.0 / z + 4.0), np.floor(y * 8.0 / z + 4.0)
                    d = image[r, int(b) * 8 + int(a)] if 0 <= a < 8 and 0 <= b < 8 else np.nan
                    sdf = (d - z) / z * np.sqrt(x * x + y * y + z * z)
                    if d >= camera.near and sdf >= -vmap.boundary:
                        want[r, i] = min(sdf / vmap.boundary, 1.0)
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
            total += len(want)
    assert total > 5000
