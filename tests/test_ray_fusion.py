"""Occupancy from rays: literal rays, poses, and large groups folded by segments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxelspark.operators import fusion, ray_fusion

MAP, MODEL = fusion.VoxelMap(), ray_fusion.RayModel()
RAYS = "scan long, seq long, x double, y double, z double"


def fused(spark, rows, schema=RAYS, **how):
    out = ray_fusion.fuse(spark.createDataFrame(rows, schema), MAP, **how).collect()
    return {(r["vx"], r["vy"], r["vz"]): (r["occupancy"], r["weight"]) for r in out}


def test_one_ray_is_free_then_occupied(spark):
    got = fused(spark, [(0, 1, 3.0, 0.0, 0.0)])
    assert {k[1:] for k in got} == {(128, 128)} and all(w == 1 for _, w in got.values())
    tau, three_sigma = 0.3, 3 * 0.052 * 3.0
    for (vx, _, _), (value, _) in got.items():
        lo, hi = (vx * 0.05 - 6.4 - 3.0), ((vx + 1) * 0.05 - 6.4 - 3.0)
        if hi < -three_sigma:
            assert value == fusion.LOG_ODD_MIN
        elif lo > tau / 2:
            assert math.isclose(value, -fusion.LOG_ODD_MIN * tau / (2 * three_sigma))
        elif lo > 0.01:
            assert value > 0
        elif hi < -0.01:
            assert value < 0
    # Near plane to 0.3 m behind the end, nothing left out between.
    xs = sorted(k[0] for k in got)
    assert xs == list(range(xs[0], xs[-1] + 1)) and xs[0] in (129, 130) and xs[-1] in (193, 194)


def test_rays_that_give_nothing(spark):
    rows = [(0, 1, 0.05, 0.0, 0.0), (0, 2, 0.0, 0.0, 0.0), (0, 3, None, 1.0, 0.0), (0, 4, float("nan"), 1.0, 0.0), (0, 5, float("inf"), 1.0, 0.0)]
    assert fused(spark, rows) == {} and fused(spark, []) == {}


def test_rays_end_at_the_far_plane_and_at_the_maps_border(spark):
    near = ray_fusion.RayModel(far=1.0)
    assert max(k[0] for k in fused(spark, [(0, 1, 3.0, 0.0, 0.0)], model=near)) in (147, 148)
    assert max(k[0] for k in fused(spark, [(0, 1, 9.0, 0.0, 0.0)])) == 255


def test_turned_and_moved_sensor(spark):
    """A quarter turn about z, x becomes y; the pose's position moves all voxels."""
    at = RAYS + ", tx double, ty double, tz double, qw double, qx double, qy double, qz double"
    got = fused(spark, [(0, 1, 2.0, 0.0, 0.0, 1.01, -1.0, 0.51, 2.0, 0.0, 0.0, 2.0)], at)
    assert {(k[0], k[2]) for k in got} == {(148, 138)}
    ys = [k[1] for k in got]
    assert min(ys) in (109, 110, 111) and max(ys) in (153, 154)
    assert fused(spark, [(0, 1, 2.0, 0.0, 0.0, 9.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], at) == {}


def test_segments_give_the_plain_fold(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("v"), F.floor(F.col("id") / 900).alias("scan"), F.col("id").alias("seq"), F.sin(F.col("id").cast("double")).alias("value"))
    rows = rows.filter("v < 2 or seq < 40")
    for per in (1, 7, 64, 5000):
        parts = rows.withColumn("part", F.floor(F.col("seq") / per))
        got = {r["v"]: (r["mean"], r["weight"]) for r in ray_fusion.segmented_mean(parts, "v", ["scan", "part"], "seq", "value", 20).collect()}
        for v in range(3):
            mean, w = 0.0, 0
            for i in range(3000):
                if i % 3 == v and (v < 2 or i < 40):
                    w = min(w + 1, 20)
                    mean += (math.sin(i) - mean) / w
            assert math.isclose(got[v][0], mean, abs_tol=1e-12) and got[v][1] == w


def test_every_ray_passes_the_sensors_voxels(spark):
    """The order of the rays, not of the partitions, decides: repeated and shuffled input give the same map."""
    rows = [(s, q, 2.0 + 0.01 * q, 0.1 * s, 0.0) for s in range(4) for q in range(30)]
    assert fused(spark, rows, per_segment=8) == fused(spark, rows[::-1], per_segment=8)
    near = [w for k, (_, w) in fused(spark, rows, per_segment=8).items() if k[0] == 130]
    assert max(near) == fusion.occupancy_max_weight()


def test_rays_without_length_are_skipped_by_length_alone(spark):
    rows = [(0, 1, 0.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 0.2), (0, 3, 0.0, 0.0, 0.0), (0, 4, 0.0, 0.0, 2.0), (0, 5, 0.0, 0.0, 0.0), (0, 6, 0.0, 0.0, 0.0)]
    out = fusion.too_close(spark.createDataFrame(rows, "scan long, seq long, x double, y double, z double"), 0.5, 0.5)
    assert [r["skip"] for r in out.orderBy("seq").collect()] == [False, True, True, False, False, True]
