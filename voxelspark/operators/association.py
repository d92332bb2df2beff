"""Associating images, poses and rays by time, and merging read results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .keysets import ranked

#: Results of reading one item, from best to worst; a stream goes on while it is ok or skip.
STATUS = ("ok", "skip", "eof", "error")


def nearest(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """(id, match, delta): for each left (id, ts) the right (id, ts) nearest in time, within tolerance.

    Ties go to the earlier ts, then the smaller id; rows without a match are left out.
    Times fall into bins of the tolerance, and each bin also gets the last match of the bin
    before and the first of the bin after it. The matches on either side of a time are then
    the last ones seen when the bin is walked in both directions, however many there are.
    """
    of_bin = F.floor(F.col("ts") / F.lit(tolerance))
    a = left.select(of_bin.alias("bin"), "ts", F.lit(1).alias("side"), F.struct("id").alias("own"))
    b = right.filter("ts is not null").groupBy("ts").agg(F.min(F.struct("id"))["id"].alias("match"))
    b = b.select(of_bin.alias("bin"), F.struct(F.col("ts").alias("at"), "match").alias("near"))
    ends = b.groupBy("bin").agg(F.min("near").alias("first"), F.max("near").alias("last"))
    ends = ends.select(F.inline(F.array(F.struct((F.col("bin") - 1).alias("bin"), F.col("first").alias("near")), F.struct((F.col("bin") + 1).alias("bin"), F.col("last").alias("near")))))
    b = b.unionByName(ends).select("bin", F.col("near.at").alias("ts"), F.lit(0).alias("side"), "near")
    rows = a.filter("ts is not null").unionByName(b, allowMissingColumns=True)
    walk = Window.partitionBy("bin")
    # On its way back the walk meets what is at a row's own time after it, on its way there before.
    rows = rows.withColumns({"before": F.last("near", ignorenulls=True).over(walk.orderBy("ts", "side")), "after": F.last("near", ignorenulls=True).over(walk.orderBy(F.desc("ts"), F.desc("side")))})
    found = rows.filter("side = 1").select("own.id", F.explode(F.array(*[F.struct(F.abs(F.col("ts") - F.col(f"{c}.at")).alias("delta"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.match").alias("match")) for c in ("before", "after")])).alias("b"))
    found = found.filter(F.col("b.delta") <= tolerance).groupBy("id").agg(F.min("b").alias("b"))
    return found.select("id", F.col("b.match").alias("match"), F.col("b.delta").alias("delta"))


def intervals(poses: DataFrame, columns: list[str], gap: int) -> DataFrame:
    """Each pose with the next, if that is gap away at most: t0, t1 and both ends' columns (c_0, c_1).

    Poses fall into bins of gap, so the next one is in the same bin or first in the one
    after; no window spans all poses.
    """
    here = F.struct("ts", "id", *columns)
    rows = poses.withColumn("bin", F.floor(F.col("ts") / F.lit(gap)))
    firsts = rows.groupBy((F.col("bin") - 1).alias("bin")).agg(F.min(here).alias("first"))
    rows = rows.withColumn("next", F.lead(here).over(Window.partitionBy("bin").orderBy("ts", "id")))
    rows = rows.join(firsts, "bin", "left").withColumn("next", F.coalesce("next", "first"))
    ends = rows.select(F.col("ts").alias("t0"), F.col("next.ts").alias("t1"), *[F.col(c).alias(f"{c}_0") for c in columns], *[F.col(f"next.{c}").alias(f"{c}_1") for c in columns])
    return ends.filter((F.col("t1") - F.col("t0") <= gap) & (F.col("t1") > F.col("t0")))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Spherical interpolation of unit quaternions, along the shorter arc."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    near = F.abs(dot) > 1 - 1e-12
    wa = F.when(near, F.lit(1.0) - t).otherwise(F.sin((F.lit(1.0) - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    return [wa * x + wb * y for x, y in zip(a, b, strict=True)]


QUATERNION = ("qx", "qy", "qz", "qw")


def at_times(items: DataFrame, poses: DataFrame, columns: list[str], gap: int) -> DataFrame:
    """(id, columns): poses interpolated to each item's ts between the poses around it.

    Items outside the trajectory, or between poses further apart than gap, are left out.
    A time on a pose takes that pose. Where columns has qx to qw they turn together, along
    the shorter arc; the others move on a line. Intervals and items meet in bins of gap.
    """
    ends = intervals(poses, columns, gap)
    ends = ends.withColumn("bin", F.explode(F.sequence(F.floor(F.col("t0") / F.lit(gap)), F.floor(F.col("t1") / F.lit(gap)))))
    rows = items.select("id", "ts").withColumn("bin", F.floor(F.col("ts") / F.lit(gap)))
    rows = rows.join(ends, "bin").filter((F.col("t0") <= F.col("ts")) & (F.col("ts") < F.col("t1")))
    t = (F.col("ts") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    turned = {}
    if set(QUATERNION) <= set(columns):
        ends = [[F.col(f"{c}_{k}") for c in QUATERNION] for k in (0, 1)]
        turned = dict(zip(QUATERNION, slerp(*ends, t), strict=True))
    return rows.select("id", *[turned.get(c, lerp(F.col(f"{c}_0"), F.col(f"{c}_1"), t)).alias(c) for c in columns])


def by_position(*lists: DataFrame) -> DataFrame:
    """Lists (ts, id, value...) joined by their place in the order of ts: columns position, and each list's.

    Places come from a range-partitioned sort and the sizes of its partitions, so no task holds a list.
    """
    out = None
    for k, df in enumerate(lists):
        rows = ranked(df, F.asc("ts"), F.asc("id"))
        rows = rows.select(F.col("rank").cast("int").alias("position"), *[F.col(c).alias(f"{c}_{k}") for c in df.columns])
        out = rows if out is None else out.join(rows, "position")
    return out


def merge_status(rows: DataFrame, by: list[str]) -> DataFrame:
    """The worst status of each group, and whether the stream goes on."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS]), F.col("status"))
    out = rows.groupBy(*by).agg(F.max(rank).alias("r"))
    return out.select(*by, F.element_at(F.array(*[F.lit(s) for s in STATUS]), F.col("r").cast("int")).alias("status"), (F.col("r") <= 2).alias("good"))


def paced(frames: DataFrame, fps: float, budget: Column, by: list[str] | None = None) -> DataFrame:
    """frames with keep: which a reader at fps works on, if each takes budget seconds and late ones drop.

    With fps 0 all are kept. Frame k arrives at k / fps and is kept if the frame kept before
    it is done by then. Each decision rests on the one before, so a sequence (by; all rows
    without) is folded in the order of frame, in one pass that holds one row at a time.
    """
    if fps == 0:
        return frames.withColumn("keep", F.lit(True))
    by = by or []
    rows = frames.withColumns({"_key": F.xxhash64(*by) if by else F.lit(0), "_cost": budget.cast("double")})
    own, names = frames.columns, [*frames.columns, "keep"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, free = None, 0.0
        for batch in batches:
            kept = []
            for key, frame, cost in zip(*(batch.column(c).to_pylist() for c in ("_key", "frame", "_cost")), strict=True):
                # A billionth of a frame's time allows for the rounding of the quotient.
                keep = key != last or frame / fps >= free - 1e-9 / fps
                last, free = key, frame / fps + cost if keep else free
                kept.append(keep)
            yield pa.record_batch([*(batch.column(c) for c in own), pa.array(kept, pa.bool_())], names=names)

    rows = rows.repartition(*(F.col(c) for c in by)) if by else rows.repartition(1)
    schema = StructType([*frames.schema.fields, StructField("keep", BooleanType())])
    return rows.sortWithinPartitions("_key", *by, "frame").mapInArrow(fold, schema)
