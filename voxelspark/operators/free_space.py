"""Free space in octants of any size: leaves that are freed, split and pruned, with bounds up to the root.

A visit (key, frame, value) gives an octant a log-odds value as a whole; without a value it
only asks that the octant be there. Octants split into all eight children, which start with
what their parent held, so a leaf holds the fold of all visits to itself and to its
ancestors, in the order of frames. Visits are shuffled once: those below one octant of scale
HOST come together, sorted so that octants come before what lies in them, and each leaf is
folded from its own visits and those of the octants around it. The state is a table of leaves
(key, occupancy, weight), weight 0 where nothing was observed; octants beyond the deepest
visit are not split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import morton as m
from .fusion import LOG_ODD_MIN, MIN_LOG_ODDS, VoxelMap, occupancy_max_weight, settle
from .octree import BLOCK_SCALE, allocate_children, ancestors, locate

STATE = "key long, occupancy double, weight int"
#: Octants of this scale have their visits dealt to one task; visits to coarser ones go to each of those below.
HOST = BLOCK_SCALE + 2


def visits_of(carved: DataFrame) -> DataFrame:
    """(key, frame, value) of carve.carve()'s rows: constant octants are free, gradient ones only have to be there."""
    key = m.encode_key(m.encode_code(F.col("x"), F.col("y"), F.col("z")), F.col("scale"))
    return carved.select(key.alias("key"), "frame", F.when(F.col("state") == "constant", F.lit(LOG_ODD_MIN)).alias("value"))


def leaves(keys: DataFrame, top: int) -> DataFrame:
    """The leaves (key) of the smallest octree with root scale top that holds these keys, where siblings come together."""
    keys = keys.select("key").filter("key is not null").distinct()
    inner = settle(ancestors(keys, top, include_self=False).select(F.col("ancestor").alias("key")), "key").distinct()
    root = keys.filter(m.key_scale(F.col("key")) == top)
    return settle(allocate_children(inner), "key").unionByName(root).join(inner, "key", "left_anti")


def history(of: DataFrame, visits: DataFrame, top: int) -> DataFrame:
    """(key, frame, value): for each octant in of the visits to it and to its ancestors."""
    up = settle(ancestors(of.select("key"), top).select("key", "ancestor"), "key", "ancestor")
    return up.join(visits.select(F.col("key").alias("ancestor"), "frame", "value"), "ancestor").select("key", "frame", "value")


class Visited:
    """An octant's visits in the order of frames, and all of its ancestors' among them; frames and values of the last that count.

    A value with so many after it that its share is 0 as a double is counted, but not kept.
    """

    def __init__(self, end: int, above: Visited | None, kept: int):
        self.end, self.above, self.kept = end, above, kept
        self.n, self.parts, self._all = 0, [], None

    def add(self, frame: np.ndarray, value: np.ndarray) -> None:
        """Later visits to the octant itself."""
        self.n += len(frame)
        self.parts.append((frame[-self.kept :], value[-self.kept :]))
        if sum(len(f) for f, _ in self.parts) > 2 * self.kept:
            self.parts = [self._own()]

    def _own(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([p[k] for p in self.parts])[-self.kept :] for k in (0, 1))

    def all(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Their number, frames and values; after the last add()."""
        if self._all is None:
            rows = ([(self.n, *self._own())] if self.n else []) + ([self.above.all()] if self.above else [])
            rows = [r for r in rows if r[0]] or [(0, np.empty(0, dtype=np.int64), np.empty(0))]
            n, frame, value = sum(r[0] for r in rows), *(np.concatenate([r[k] for r in rows]) for k in (1, 2))
            if len(rows) > 1:
                order = np.lexsort((value, frame))[-self.kept :]
                frame, value = frame[order], value[order]
            self._all, self.parts = (n, frame, value), []
        return self._all


def _hosted(key: Column) -> Column:
    return m.encode_key(m.key_code(key), F.greatest(m.key_scale(key), F.lit(HOST)))


def fold(start: DataFrame, visits: DataFrame, top: int) -> DataFrame:
    """Leaves (key, occupancy, weight) that start with this state after visits with values, none above the root.

    A leaf's state counts as its weight's many values before the first.
    """
    w = occupancy_max_weight()
    fade = (w - 1) / w
    # fade to the power of dead is 0 as a double.
    dead = math.ceil(1076 * math.log(2) / -math.log(fade))
    first = F.lit(-(2**63)).cast("long")
    seen = visits.filter("key is not null and value is not null").select("key", F.coalesce(F.col("frame").cast("long"), first).alias("frame"), F.col("value").cast("double").alias("value"))
    coarse = m.key_scale(F.col("key")) > HOST
    start = settle(start.withColumn("host", _hosted(F.col("key"))), "host")
    above = ancestors(start.select(F.col("host").alias("key")).distinct(), top).filter(F.col("at") > HOST)
    above = settle(above.select(F.col("key").alias("host"), F.col("ancestor")), "ancestor").withColumnRenamed("ancestor", "key")
    dealt = settle(seen.filter(~coarse).withColumn("host", _hosted(F.col("key"))), "host").unionByName(seen.filter(coarse).join(above, "key"))
    none = F.lit(None).cast("int").alias("weight")
    dealt = dealt.select("host", "key", "frame", "value", none).unionByName(start.select("host", "key", first.alias("frame"), F.col("occupancy").alias("value"), "weight"))
    # Octants before what lies in them, an octant's visits before itself as a leaf.
    rows = dealt.select("host", F.col("key").bitwiseXOR(F.lit(31)).alias("place"), "weight", "frame", "value")
    rows = rows.repartition(int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions")), "host")
    rows = rows.sortWithinPartitions("host", "place", "weight", "frame", "value")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        faded = fade ** np.arange(dead + 1)
        around: list[Visited] = []
        last = None
        for batch in batches:
            host, place, frame = (batch.column(c).to_numpy() for c in ("host", "place", "frame"))
            value, leaf = batch.column("value").to_numpy(zero_copy_only=False), batch.column("weight").is_valid().to_numpy(zero_copy_only=False)
            weight = batch.column("weight").fill_null(0).to_numpy()
            out: list[tuple[int, float, int]] = []
            changed = (host[1:] != host[:-1]) | (place[1:] != place[:-1]) | leaf[1:] | leaf[:-1]
            bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), len(host)]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if i == j:
                    continue
                at = int(place[i])
                if last != (host[i], at):
                    if last is None or last[0] != host[i]:
                        around = []
                    code = at >> m.SCALE_BITS
                    while around and around[-1].end <= code:
                        around.pop()
                    around.append(Visited(code + (1 << 3 * (31 - at % 32)), around[-1] if around else None, dead + w))
                    last = (host[i], at)
                if not leaf[i]:
                    around[-1].add(frame[i:j], value[i:j])
                    continue
                n, _, x = around[-1].all()
                held, whole = int(weight[i]), int(weight[i]) + n
                # Values after each: whole - its number, which counts as w at least.
                after = np.minimum(np.arange(len(x) - 1, -1, -1), max(whole - w, 0))
                total = float((x * faded[np.minimum(after, dead)]).sum()) + (held * float(value[i]) * faded[min(max(whole - w, 0), dead)] if held else 0.0)
                out.append((at ^ 31, total / min(whole, w) if whole else 0.0, min(whole, w)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["key", "occupancy", "weight"])

    return rows.mapInArrow(folded, STATE)


def update(state: DataFrame, visits: DataFrame, top: int) -> DataFrame:
    """The leaves after a batch of visits, whose frames come after those that state has seen.

    Leaves of state that a visit lies below are split, and their children start with what
    they held. Visits in the order of frames; of one frame an octant may get several, in the
    order of their values. Visits are read several times, so they had better be a table.
    """
    new = leaves(state.select("key").unionByName(visits.select("key")), top)
    start = locate(new, m.key_code(F.col("key")), m.key_scale(F.col("key")), state.select("key", F.lit(0).alias("child_mask")), top)
    start = start.join(state.withColumnRenamed("key", "found"), "found", "left")
    start = start.select("key", F.coalesce("occupancy", F.lit(0.0)).alias("occupancy"), F.coalesce("weight", F.lit(0)).alias("weight"))
    return fold(start, visits, top)


def summary(state: DataFrame) -> DataFrame:
    """(key, low, high, observed, data) of leaves: their log-odds times weight twice, and what they hold."""
    held = F.when(F.col("weight") > 0, F.col("occupancy") * F.col("weight"))
    return state.select("key", held.alias("low"), held.alias("high"), (F.col("weight") > 0).alias("observed"), F.struct("occupancy", "weight").alias("data"))


def block_summary(voxels: DataFrame, vmap: VoxelMap) -> DataFrame:
    """(key, low, high, observed, data) of the blocks of voxels (vx, vy, vz, scale, value, weight), as blocks.fuse_frames() gives them.

    data is that of the voxel of greatest log-odds times weight; a block is observed if all its voxels are.
    """
    key = m.encode_key(m.encode_code(F.col("vx"), F.col("vy"), F.col("vz")), F.lit(BLOCK_SCALE))
    held = F.col("value") * F.col("weight")
    rows = voxels.filter("weight > 0").select(key.alias("key"), held.alias("held"), F.col("value").alias("occupancy"), "weight", F.pow(F.lit(8.0), F.col("scale")).alias("n"))
    best = F.max(F.struct("held", "occupancy", "weight"))
    out = rows.groupBy("key").agg(F.min("held").alias("low"), F.max("held").alias("high"), (F.sum("n") == float(vmap.block**3)).alias("observed"), best.alias("d"))
    return out.select("key", "low", "high", "observed", F.struct("d.occupancy", "d.weight").alias("data"))


def bounds(leaf: DataFrame, top: int) -> DataFrame:
    """(key, low, high, observed) of every octant from these leaves (see summary) up to the root.

    low and high are the least and greatest log-odds times weight of what was observed below,
    null if nothing was; observed says that all of it was. One aggregate, combined before its shuffle.
    """
    rows = ancestors(leaf, top)
    size = lambda s: m._shl(F.lit(1), 3 * s)
    seen = F.when(F.col("observed"), size(m.key_scale(F.col("key")))).otherwise(F.lit(0))
    out = rows.withColumn("seen", seen).groupBy("ancestor").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("seen").alias("seen"))
    return out.select(F.col("ancestor").alias("key"), "low", "high", (F.col("seen") == size(m.key_scale(F.col("ancestor")))).alias("observed"))


def prune(leaf: DataFrame, top: int) -> DataFrame:
    """The leaves (key, occupancy, weight) after octants that are free as a whole became leaves.

    An octant below the root is free as a whole if all of it was observed and its greatest
    log-odds times weight is near the least possible; it keeps the data that has it. What
    lies below such an octant is free as a whole too, so the coarsest one decides, and only
    leaves that are free themselves look for one.
    """
    least = 0.95 * MIN_LOG_ODDS
    free = F.coalesce(F.col("observed") & (F.col("high") <= least), F.lit(False))
    whole = bounds(leaf, top).filter(free & (m.key_scale(F.col("key")) < top)).select(F.col("key").alias("ancestor"))
    up = ancestors(leaf.filter(free), top - 1).join(whole, "ancestor", "left_semi")
    merged = up.groupBy("key", "high", "data").agg(F.max_by("ancestor", "at").alias("into"))
    merged = merged.groupBy("into").agg(F.max(F.struct("high", "data")).alias("d")).select(F.col("into").alias("key"), "d.data")
    # A free leaf at the root's scale has no ancestor below the root and stays.
    stay = leaf.filter(~free | (m.key_scale(F.col("key")) >= top)).select("key", "data")
    return stay.unionByName(merged).select("key", "data.occupancy", "data.weight")
