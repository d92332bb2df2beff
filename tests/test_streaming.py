"""Streams give what batches give; blocks change scale as described; refinement keeps what is needed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelspark.functions.sensors import Lidar, Pinhole
from voxelspark.operators import carve, fusion, ray_fusion, ray_map
from voxelspark.streaming import blocks, fuse, rays

from .cost import shuffled_rows

CAMERA = Pinhole(8.0, 8.0, 3.5, 3.5, 8, 8, near=0.1, far=6.0)
MAP = fusion.VoxelMap(dim=12.8, res=0.1, truncation=4.0, max_weight=4)


def sequence(spark, frames=6):
    rng = np.random.default_rng(0)
    rows = [(f, x, y, float(1.5 + 0.3 * rng.random()), 0.05 * f, 0.0, 0.0) for f in range(frames) for x in range(8) for y in range(8)]
    return spark.createDataFrame(rows, "frame long, x int, y int, depth double, tx double, ty double, tz double")


def test_batches_take_one_ray_past_the_interval():
    ts = np.array([0, 4, 10, 11, 15, 22, 23, 24])
    assert rays.cut(ts, 10, keep_tail=False).tolist() == [0, 0, 0, 0, 1, 1, 1, 1][:4] + [-1] * 4
    assert rays.cut(ts, 5, keep_tail=True).tolist() == [0, 0, 0, 1, 1, 1, 2, 2]


def test_ray_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, k, int(t)) for s in range(3) for k, t in enumerate(np.sort(rng.integers(0, 1000, 50)))]
    df = spark.createDataFrame(rows, "scan long, seq long, ts long")
    for part in range(2):
        df.filter((F.col("ts") >= 500) == bool(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rays.stream_batches(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 40)
    run = stream.writeStream.format("memory").queryName("ray_batches").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    got = sorted(map(tuple, spark.sql("select * from ray_batches").collect()))
    assert got == sorted(map(tuple, rays.batches(df, 40).collect())) and got


def test_map_stream_equals_fusing_at_once(spark, tmp_path):
    frames = sequence(spark)
    for part in range(3):
        frames.filter(F.floor(F.col("frame") / 2) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = fuse.MapStream(str(tmp_path / "map"), CAMERA, MAP)
    names = sorted(p.name for p in (tmp_path / "in").glob("*.parquet"))
    assert len(names) == 3
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source).awaitTermination(180)
    got = {tuple(r)[:3]: (round(r["tsdf"], 9), r["weight"]) for r in stream.voxels(spark, 2).collect()}
    px, po = frames.select("frame", "x", "y", "depth"), frames.select("frame", "tx", "ty", "tz").distinct()
    want = {tuple(r)[:3]: (round(r["tsdf"], 9), r["weight"]) for r in fusion.fuse(px, po, CAMERA, MAP).collect()}
    assert got == want and max(w for _, w in want.values()) == 4


def test_a_small_batch_writes_little_and_a_repeated_one_does_no_harm(spark, tmp_path):
    stream = fuse.MapStream(str(tmp_path / "map"), CAMERA, MAP, compact_every=2)
    frames = sequence(spark, 4).cache()
    one = lambda f: frames.filter(F.col("frame") == f)
    whole = lambda v: sorted(map(tuple, stream.voxels(spark, v).collect()))
    stream.update(one(0), 0)
    # A single pixel changes few of the blocks that one frame of 64 has.
    stream.update(one(1).filter("x = 4 and y = 4"), 1)
    count = lambda v: spark.read.parquet(f"{tmp_path}/map/voxels/changes/version={v:010d}").select("bx", "by", "bz").distinct().count()
    assert 0 < count(1) < count(0) / 4
    before = whole(1)
    stream.update(one(1).filter("x = 4 and y = 4"), 1)
    assert whole(1) == before
    stream.update(one(2), 2)
    after = whole(2)
    assert (tmp_path / "map/voxels/base/version=0000000002").exists()
    stream.update(one(2), 2)
    assert whole(2) == after and whole(1) == before


def ray_rows(spark, n=60):
    rng = np.random.default_rng(7)
    rows = []
    for scan in range(3):
        for seq in range(n):
            d = rng.normal(size=3)
            x, y, z = (d / np.linalg.norm(d) * rng.uniform(0.5, 6.0)).tolist()
            rows.append((scan, seq, x, y, z, 1.5 * scan - 1.5, 0.0, 0.0))
    return spark.createDataFrame(rows, "scan long, seq long, x double, y double, z double, tx double, ty double, tz double")


def test_ray_map_stream_equals_its_batches(spark, tmp_path):
    frame = ray_rows(spark)
    for scan in range(3):
        frame.filter(F.col("scan") == scan).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    how = ray_map.RayMap(lidar=Lidar.leica(3.5, 3.5))
    stream = rays.RayMapStream(str(tmp_path / "stream"), how, per_segment=16, compact_every=1)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source).awaitTermination(180)
    batches = rays.RayMapStream(str(tmp_path / "batches"), how)
    for scan in (0, 1, 1, 2):
        batches.update(frame.filter(F.col("scan") == scan), scan)
    told = lambda s: sorted((r["scale"], r["v"], round(r["occupancy"], 9), r["weight"]) for r in s.voxels(spark, 2).collect())
    got = told(stream)
    assert got == told(batches)
    assert {r[0] for r in got} == {0, 1, 2, 3} and len({r[1] for r in got}) == len(got)
    # Octants above bound what is below them, level by level.
    up = {(r["scale"], r["v"]): r for r in ray_map.levels(stream.voxels(spark, 2), how).collect()}
    below = {(r[0], r[1]): (r[2] * r[3], r[2] * r[3]) for r in got} | {k: (r["low"], r["high"]) for k, r in up.items()}
    n = how.vmap.size
    for (scale, v), (low, high) in below.items():
        if scale < n.bit_length() - 1:
            step = 2 << scale
            x, y, z = (c // step * step for c in (v % n, v // n % n, v // n**2))
            parent = up[scale + 1, (z * n + y) * n + x]
            assert parent["low"] <= low + 1e-6 and high <= parent["high"] + 1e-6


def test_a_single_ray_takes_the_scales_of_its_distances(spark, tmp_path):
    """All scales along one ray: by the block's distance, and not the finest in free space."""
    how = ray_map.RayMap(vmap=fusion.VoxelMap(dim=25.6), lidar=Lidar.leica(1.0, 1.0), model=ray_fusion.RayModel(near=0.2, far=30.0))
    stream = rays.RayMapStream(str(tmp_path / "map"), how)
    stream.update(spark.createDataFrame([(0, 0, 10.0, 0.0, 0.0)], "scan long, seq long, x double, y double, z double"), 0)
    n, got = how.vmap.size, {}
    for r in stream.voxels(spark, 0).collect():
        x = r["v"] % n // 8
        assert got.setdefault(x, r["scale"]) == r["scale"] and r["v"] // n % n // 8 == n // 16
    three = 3 * min(max(0.052 * 10, 1.5 * 0.05), 6 * 0.05)
    for x, scale in got.items():
        centre = np.array([(x * 8 + 4) * 0.05 - 12.8, 0.2, 0.2])
        ratio = np.linalg.norm(centre) * np.radians(1.0) / 0.05
        want = sum(ratio >= s for s in (1.5, 3.0, 6.0))
        free = (x * 8 + 8) * 0.05 - 12.8 < 10 - three
        assert scale == (max(want, 1) if free else want)
    assert len(got) >= 24 and set(got.values()) == {1, 2}


def test_buffer_takes_over_after_enough_rounds():
    block = blocks.Block(8, True, 20)
    see = lambda scale: np.full((8 >> scale,) * 3, -5.015)
    block.integrate(0, see)
    for k in range(blocks.BUFFER_ROUNDS):
        assert block.scale == 0 and (k == 0 or block.buffer == 1)
        block.integrate(1, see)
    assert block.scale == 1 and block.buffer is None
    mean, weight = block.levels[1]
    assert np.allclose(mean, -5.015) and (weight >= 20).all()


def test_distances_pass_on_changes_to_finer_scales():
    block = blocks.Block(8, False, 100)
    block.integrate(0, lambda s: np.full((8,) * 3, 0.5))
    block.integrate(1, lambda s: np.full((4,) * 3, 0.1))
    assert block.scale == 1 and np.allclose(block.levels[1][0], 0.3)
    block.integrate(0, lambda s: np.full((8,) * 3, np.nan))
    assert block.scale == 0 and np.allclose(block.levels[0][0], 0.3) and (block.levels[0][1] == 2).all()


def test_one_scale_blocks_equal_plain_fusion(spark):
    near = Pinhole(8.0, 8.0, 3.5, 3.5, 8, 8, near=0.1, far=6.0)
    vmap = fusion.VoxelMap(dim=12.8, res=0.4, truncation=2.0)
    frames = sequence(spark, 3)
    px, po = frames.select("frame", "x", "y", "depth"), frames.select("frame", "tx", "ty", "tz").distinct()
    got = {(r["vx"], r["vy"], r["vz"]): (round(r["value"], 9), r["weight"]) for r in blocks.fuse(px, po, near, vmap, occupancy=False).filter("scale = 0").collect()}
    want = {tuple(r)[:3]: (round(r["tsdf"], 9), r["weight"]) for r in fusion.fuse(px, po, near, vmap).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_refinement_keeps_the_surface_and_frees_the_space_before_it(spark):
    rows = [(0, x, y, 3.0) for x in range(8) for y in range(8)]
    px = spark.createDataFrame(rows, "frame long, x int, y int, depth double")
    po = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "frame long, tx double, ty double, tz double")
    out = carve.carve(px, po, CAMERA, MAP).collect()
    z = lambda r: (r["z"] * 0.1 - 6.4, (r["z"] + (1 << r["scale"])) * 0.1 - 6.4)
    assert all(z(r)[0] <= 3.2 + 1e-9 for r in out)
    assert all(z(r)[1] < 3.0 for r in out if r["state"] == "constant")
    on = {(r["x"], r["y"]) for r in out if r["scale"] == 3 and z(r)[0] <= 3.0 < z(r)[1]}
    assert (64, 64) in on


def test_visits_of_a_block_are_projected_together(monkeypatch):
    rng, n = np.random.default_rng(5), 40
    wide, depth = np.full(n, 8), rng.uniform(0.3, 4.0, (n, 64))
    depth[7] = 0.0
    args = (np.tile([6, 6, 9], (n, 1)), rng.uniform(-0.3, 0.3, (n, 3)), None, depth.reshape(-1), np.arange(n) * 64, np.zeros(n, dtype=int), np.zeros(n, dtype=int), wide, CAMERA, MAP)
    calls, project = [], blocks.Sight._project
    monkeypatch.setattr(blocks.Sight, "_project", lambda self, rows, scale: calls.append(len(rows)) or project(self, rows, scale))
    for occupancy in (True, False):
        sight = blocks.Sight(*args, occupancy, 0.05, 0.2)
        together = [sight.at(k, n)(0) for k in range(n)]
        assert calls == [n] and sum(len(i) for i, _ in together) > 0 == len(together[7][0])
        alone = [blocks.Sight(*args, occupancy, 0.05, 0.2).at(k, k + 1)(0) for k in range(n)]
        assert all((a == b).all() for x, y in zip(together, alone, strict=True) for a, b in zip(x, y, strict=True))
        calls.clear()


def test_carving_shuffles_frames_only(spark):
    """Octants find their depths in the image beside them; no row is made for a pixel of a box. Poses without pixels keep what reaches to the camera."""
    frames = spark.range(6).selectExpr("id AS frame", "transform(sequence(1, 64), i -> 1.0D + (i * 7 + id) % 11 / 4) AS depth", "id * 0.1D AS tx", "0.0D AS ty", "0.0D AS tz")
    assert shuffled_rows(carve.carve_frames(frames, CAMERA, MAP)) <= 6
    pixels = frames.selectExpr("frame", "posexplode(depth) AS (i, depth)").selectExpr("frame", "i % 8 AS x", "CAST(floor(i / 8) AS INT) AS y", "depth")
    poses = frames.drop("depth")
    want = sorted(map(tuple, carve.carve_frames(frames, CAMERA, MAP).collect()))
    got = carve.carve(pixels.filter("frame < 5"), poses, CAMERA, MAP).collect()
    assert sorted(tuple(r) for r in got if r["frame"] < 5) == [r for r in want if r[0] < 5]
    blind = {tuple(r)[1:] for r in got if r["frame"] == 5}
    assert blind and all(scale == 3 and state == "gradient" for _, _, _, scale, state in blind)
