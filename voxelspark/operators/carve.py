"""Allocation of occupancy maps: octants refined level by level against pooled depth."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sensors import Pinhole
from .fusion import VoxelMap, packed, pose_columns, posed, settle, to_camera, variance_state
from .images import pool_arrays


def carve(pixels: DataFrame, poses: DataFrame, camera: Pinhole, vmap: VoxelMap, sigma: float = 0.05, tau: float = 0.2, block_scale: int = 3) -> DataFrame:
    """carve_frames() of pixels (frame, x, y, depth) and poses; a pose without pixels keeps what reaches to its camera."""
    return carve_frames(packed(pixels, poses, camera, every=True), camera, vmap, sigma, tau, block_scale)


def carve_frames(frames: DataFrame, camera: Pinhole, vmap: VoxelMap, sigma: float = 0.05, tau: float = 0.2, block_scale: int = 3) -> DataFrame:
    """(frame, x, y, z, scale, state): what each of frames (frame, pose, depth as an array by rows) needs.

    From the root down: octants out of view, without known depth, or wholly behind the
    surface are dropped; those wholly before it are free as they are (constant); the others
    split until they are blocks (gradient); octants that reach to the camera split without a
    test. A frame needs nothing but its own image, so its octants keep that beside them and
    all levels follow in the same task: only the frames are dealt out.
    """
    top = vmap.size.bit_length() - 1
    frames = posed(frames)
    pose = ["frame", *pose_columns(frames), "depth"]
    parts = 4 * int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("string")
    rows = frames.select(*pose).repartition(parts, "frame").select(*pose, *[F.lit(0).alias(c) for c in "xyz"], F.lit(top).alias("scale"), none.alias("state"))
    for scale in range(top, block_scale - 1, -1):
        # Rows with a state are done; they only pass.
        todo, keep, half = F.col("state").isNull(), rows.columns, (1 << scale) * vmap.res / 2
        middle = to_camera(rows, tuple(F.col(c) * F.lit(vmap.res) + F.lit(half - vmap.dim / 2) for c in "xyz"))
        rows = settle(rows.withColumns({f"c{c}": v for c, v in zip("xyz", middle, strict=True)}), "cx", "cy", "cz")
        rows = rows.filter(~todo | camera.sees_sphere((F.col("cx"), F.col("cy"), F.col("cz")), math.sqrt(3) * half))
        # Half the octant's extent along each of the camera's axes: its edges are turned against them.
        size = {c: F.lit(half) if "r00" not in rows.columns else F.lit(half) * sum(F.abs(F.col(f"r{i}{j}")) for i in range(3)) for j, c in enumerate("xyz")}
        near, far = F.col("cz") - size["z"], F.col("cz") + size["z"]
        tried = todo & (near > camera.near)
        rows = settle(rows.withColumns({"tried": tried, "near": F.when(tried, near).otherwise(F.lit(1.0)), "far": F.when(tried, far).otherwise(F.lit(1.0))}), "tried", "near", "far")
        box = {}
        for c, f, m, n in (("x", camera.fx, camera.cx, camera.width), ("y", camera.fy, camera.cy, camera.height)):
            low, high = F.col(f"c{c}") - size[c], F.col(f"c{c}") + size[c]
            ends = [e * F.lit(f) / d + F.lit(m) for e in (low, high) for d in (F.col("near"), F.col("far"))]
            box |= {f"{c}0": F.floor(F.least(*ends) + 0.5).cast("int"), f"{c}1": F.floor(F.greatest(*ends) + 0.5).cast("int")}
        rows = pool_arrays(settle(rows.withColumns(box), *box), F.col("tried"), camera.width, camera.height)
        state = variance_state(F.col("near") - F.col("high"), F.col("far") - F.col("low"), F.lit(tau), F.lit(3 * sigma))
        partly = F.col("unknown") | F.col("crossing")
        state = F.when(partly & (state == "constant"), F.lit("gradient")).otherwise(state)
        seen = F.coalesce(F.col("near") <= F.col("high") + tau, F.lit(False))
        rows = rows.filter(~F.col("tried") | seen)
        state = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("tried"), state).otherwise(F.lit("gradient"))
        rows = settle(rows.select(*keep[:-1], state.alias("state")), "state")
        if scale > block_scale:
            step = 1 << (scale - 1)
            child = lambda k: F.struct(*[(F.col(c) + (step if k >> j & 1 else 0)).alias(c) for j, c in enumerate("xyz")], F.lit(scale - 1).alias("scale"), none.alias("state"))  # noqa: E731, B023
            own = F.struct("x", "y", "z", "scale", "state")
            rows = rows.select(*pose, F.inline(F.when(F.col("state") == "constant", F.array(own)).otherwise(F.array(*[child(k) for k in range(8)]))))
    return rows.select("frame", "x", "y", "z", "scale", "state")


def set_data(octants: DataFrame, updates: DataFrame) -> DataFrame:
    """octants with the data of updates (same columns, key first): existing rows replaced, new ones added."""
    return octants.join(updates.select("key"), "key", "left_anti").unionByName(updates)
