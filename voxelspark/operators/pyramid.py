"""Hierarchies of voxels: parents from children, level by level, as aggregates on coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("vx", "vy", "vz")


def parents(voxels: DataFrame) -> DataFrame:
    """voxels with their parent's coordinates in place of theirs, and child: x + 2y + 4z."""
    child = sum((F.col(c) % 2 * 2**k for k, c in enumerate(XYZ)), F.lit(0))
    return voxels.withColumn("child", child.cast("int")).withColumns({c: F.floor(F.col(c) / 2).cast("int") for c in XYZ})


def mean(voxels: DataFrame, value: str = "tsdf") -> DataFrame:
    """Parents' mean over observed children and the mean weight rounded up; parents without any are left out."""
    rows = parents(voxels).filter("weight > 0")
    return rows.groupBy(*XYZ).agg(F.avg(value).alias(value), F.ceil(F.avg("weight")).cast("int").alias("weight"))


def mean_of_rays(voxels: DataFrame, value: str = "occupancy") -> DataFrame:
    """The variant of ray integration: the weight is the rounded-up sum over the number of children."""
    rows = parents(voxels).filter("weight > 0")
    return rows.groupBy(*XYZ).agg(F.avg(value).alias(value), (F.ceil(F.sum("weight")) / F.count("*")).alias("weight"))


def extremes(voxels: DataFrame, value: str = "occupancy") -> DataFrame:
    """Parents' least and greatest child by value times weight, the first of equal ones; observed: all eight are."""
    rows = parents(voxels)
    seen = rows.filter("weight > 0").withColumn("field", F.col(value) * F.col("weight"))
    pick = F.struct(F.col(value).alias("value"), "weight", "child")
    out = seen.groupBy(*XYZ).agg(
        F.min_by(pick, F.struct("field", "child")).alias("low"),
        F.max_by(pick, F.struct("field", -F.col("child"))).alias("high"),
        (F.count_if("observed") == 8).alias("observed"),
    )
    return out.select(*XYZ, *[F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in ("low", "high") for x in ("value", "weight", "child")], "observed")


def mean_colour(voxels: DataFrame) -> DataFrame:
    """Parents' colour: whole-number means of the children's channels, weights' mean rounded up."""
    rows = parents(voxels).filter("weight > 0")
    whole = lambda c: F.floor(F.sum(c) / F.count("*")).cast("int").alias(c)
    return rows.groupBy(*XYZ).agg(whole("r"), whole("g"), whole("b"), F.ceil(F.avg("weight")).cast("int").alias("weight"))


def propagate(voxels: DataFrame, step: Callable[[DataFrame], DataFrame], levels: int) -> DataFrame:
    """All levels up to levels, with scale: each made from the one below by step."""
    out, level = voxels.withColumn("scale", F.lit(0)), voxels
    for k in range(1, levels + 1):
        level = step(level)
        out = out.unionByName(level.withColumn("scale", F.lit(k)), allowMissingColumns=True)
    return out


def rollup(voxels: DataFrame, levels: int, *aggregates: Column) -> DataFrame:
    """Aggregates over all voxels below each octant of every level, in one pass over the voxels."""
    rows = voxels.withColumn("scale", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    rows = rows.withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("scale"))).cast("int") for c in XYZ})
    return rows.groupBy("scale", *XYZ).agg(*aggregates)


def down(parents_: DataFrame, children: DataFrame, values: list[str]) -> DataFrame:
    """Children that have no value of their own take their parent's."""
    rows = children.withColumns({f"p{c}": F.floor(F.col(c) / 2).cast("int") for c in XYZ})
    up = parents_.select(*[F.col(c).alias(f"p{c}") for c in XYZ], *[F.col(v).alias(f"up_{v}") for v in values])
    rows = rows.join(up, [f"p{c}" for c in XYZ], "left")
    return rows.select(*XYZ, *[F.coalesce(F.col(v), F.col(f"up_{v}")).alias(v) for v in values])
