"""Fusing a stream of depth frames into a map that is kept as versions of its changed blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sensors import Pinhole
from ..operators import fusion
from .store import BlockStore

BLOCK = ("bx", "by", "bz")
VOXELS, BLOCKS = "bx int, by int, bz int, vx int, vy int, vz int, tsdf double, weight int", "bx int, by int, bz int, born long"


def changed_means(state: DataFrame, rows: DataFrame, vmap: fusion.VoxelMap) -> DataFrame:
    """The voxels of the observations u of rows, in order, over what state (vx, vy, vz, tsdf, weight) has of them.

    The state counts as its weight's many values before the first of rows.
    """
    v, max_weight = ["vx", "vy", "vz"], vmap.max_weight
    rows = rows.select(*fusion.voxel_of(F.col("v"), vmap), "frame", "u")
    w = Window.partitionBy(*v)
    new = rows.withColumns({"i": F.row_number().over(w.orderBy("frame")), "n": F.count("*").over(w)})
    old = state.select(*v, F.col("tsdf").alias("t0"), F.col("weight").alias("n0"))
    new = new.join(old, v, "left").withColumn("n0", F.coalesce("n0", F.lit(0)))
    total, at = F.col("n0") + F.col("n"), F.col("n0") + F.col("i")
    fade = lambda k: F.pow(F.lit((max_weight - 1) / max_weight), F.greatest(total - F.greatest(k, F.lit(max_weight)), F.lit(0)))
    full = F.least(total, F.lit(max_weight))
    share = F.sum(F.col("u") * fade(at) / full)
    before = F.first(F.when(F.col("n0") > 0, F.col("t0") * F.col("n0") * fade(F.col("n0")) / full).otherwise(0.0))
    return new.groupBy(*v).agg((share + before).alias("tsdf"), F.least(F.first(total), F.lit(max_weight)).cast("int").alias("weight"))


def merge_means(state: DataFrame, rows: DataFrame, vmap: fusion.VoxelMap) -> DataFrame:
    """state with changed_means() in place of what it has of these voxels."""
    changed = changed_means(state, rows, vmap)
    return state.join(changed.select("vx", "vy", "vz"), ["vx", "vy", "vz"], "left_anti").unionByName(changed)


@dataclass
class MapStream:
    """A map fused from micro-batches; version n is written by batch n and reads the versions before it, so a repeated batch does no harm.

    A batch writes the blocks whose voxels it changes and the blocks that it finds new. Every
    compact_every batches the merged map becomes the base of later reads.
    """

    path: str
    camera: Pinhole
    vmap: fusion.VoxelMap
    compact_every: int = 50

    @property
    def _voxels(self) -> BlockStore:
        return BlockStore(f"{self.path}/voxels", VOXELS, BLOCK)

    @property
    def _blocks(self) -> BlockStore:
        return BlockStore(f"{self.path}/blocks", BLOCKS, BLOCK)

    def voxels(self, spark: SparkSession, version: int) -> DataFrame:
        return self._voxels.read(spark, version).drop(*BLOCK)

    def update(self, frames: DataFrame, batch: int) -> None:
        """Fuse the frames (frame, x, y, depth, tx, ty, tz, and qw to qz of turned cameras) of one batch, each later than all before."""
        spark = frames.sparkSession
        pose = [c for c in frames.columns if c not in ("x", "y", "depth")]
        images = fusion.packed(frames.select("frame", "x", "y", "depth"), frames.select(*pose).distinct(), self.camera)
        known = self._blocks.read(spark, batch - 1)
        fresh = fusion.surface_samples(images, self.camera, self.vmap)
        new = fresh.join(known.select(*BLOCK), list(BLOCK), "left_anti").groupBy(*BLOCK).agg(F.min("frame").alias("born"))
        self._blocks.write(new, batch)
        # A frame counts if any of its samples is in the map, in a known block too.
        every = known.withColumnRenamed("born", "frame").unionByName(fresh)
        seen = fusion.visits(every, images, self.camera, self.vmap)
        rows = fusion.observations(seen, images, self.camera, self.vmap)
        state, v, edge = self._voxels.read(spark, batch - 1), ["vx", "vy", "vz"], self.vmap.block
        changed = changed_means(state, rows, self.vmap)
        changed = changed.select(*[F.floor(F.col(f"v{c}") / edge).cast("int").alias(f"b{c}") for c in "xyz"], *changed.columns)
        # The changed voxels are used twice: written once, with their version.
        at = f"{self.path}/changed/{batch}"
        changed.write.mode("overwrite").parquet(at)
        changed = spark.read.schema(VOXELS).parquet(at)
        rest = state.join(changed.select(*BLOCK).distinct(), list(BLOCK), "left_semi").join(changed.select(*v), v, "left_anti")
        self._voxels.write(changed.unionByName(rest), batch)
        if batch and batch % self.compact_every == 0:
            self._voxels.compact(spark, batch)
            self._blocks.compact(spark, batch)

    def start(self, frames: DataFrame, **options) -> StreamingQuery:
        """Fuse a stream of frames; rate is set by the source (maxFilesPerTrigger) and the trigger."""
        writer = frames.writeStream.foreachBatch(self.update).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**(options or {"availableNow": True})).start()
