"""Maps of rays at all scales: what a batch of many rays shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.functions.sensors import Lidar
from voxelspark.operators import ray_map

from .cost import shuffled_rows


def test_rays_are_folded_before_they_are_shuffled(spark):
    """Many scans of the same directions: rows shuffled grow with rays and voxels, not with samples. Runs of any length give one map."""
    i = F.col("id")
    x, y = ((i % 7) - 3) * 0.3, ((i % 5) - 2) * 0.3
    rays = spark.range(8000).select(F.floor(i / 16).alias("scan"), (i % 16).alias("seq"), x.alias("x"), y.alias("y"), (F.lit(1.0) + i % 3 * 0.2).alias("z"))
    how, state = ray_map.RayMap(lidar=Lidar.leica(3.5, 3.5)), ray_map.empty(spark)
    out = ray_map.changes(state, rays, how)
    assert shuffled_rows(out) < 60_000
    told = lambda d: sorted((r["scale"], r["v"], round(r["occupancy"], 9), r["weight"]) for r in d.collect())
    got = told(out)
    assert len(got) > 500 and got == told(ray_map.changes(state, rays, how, 100)) == told(ray_map.changes(state, rays.repartition(3, "seq"), how, 7))
