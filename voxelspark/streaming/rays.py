"""Streams of LiDAR rays: time-window batches anchored at the first ray of each, and maps that batches of rays update."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ray_map
from .store import BlockStore


def cut(ts: np.ndarray, interval: int, keep_tail: bool) -> np.ndarray:
    """The batch of each ray, -1 for a last batch that isn't full and isn't kept.

    A batch begins at its first ray and takes rays until one lies more than interval after
    that; this ray is still part of it.
    """
    out, start, batch = np.full(len(ts), -1, dtype=np.int64), 0, 0
    while start < len(ts):
        end = int(np.searchsorted(ts, ts[start] + interval, side="right"))
        if end == len(ts):
            if keep_tail:
                out[start:] = batch
            break
        out[start : end + 1] = batch
        start, batch = end + 1, batch + 1
    return out


def batches(rays: DataFrame, interval: int, keep_tail: bool = False) -> DataFrame:
    """rays (scan, seq, ts, ...) as (scan, seq, batch), one fold in the order of ts for each scan."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "seq"])
        rows["batch"] = cut(rows["ts"].to_numpy(), interval, keep_tail)
        return rows.loc[rows["batch"] >= 0, ["scan", "seq", "batch"]]

    return rays.select("scan", "seq", "ts").groupBy("scan").applyInPandas(fold, "scan long, seq long, batch long")


def stream_batches(rays: DataFrame, interval: int) -> DataFrame:
    """The same for a stream whose rays arrive in order; a scan's open batch is its state.

    Rows come out when their batch is full.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, seqs, times = state.get if state.exists else (0, [], [])
        seqs, times = list(seqs), list(times)
        for part in parts:
            part = part.sort_values(["ts", "seq"])
            seqs += part["seq"].tolist()
            times += part["ts"].tolist()
        batch = cut(np.array(times, dtype=np.int64), interval, keep_tail=False)
        full = int((batch >= 0).sum())
        if full:
            yield pd.DataFrame({"scan": key[0], "seq": seqs[:full], "batch": batch[:full] + done})
            done += int(batch.max()) + 1
        state.update((done, seqs[full:], times[full:]))

    out, kept = "scan long, seq long, batch long", "done long, seqs array<long>, times array<long>"
    return rays.select("scan", "seq", "ts").groupBy("scan").applyInPandasWithState(fold, out, kept, "append", GroupStateTimeout.NoTimeout)


@dataclass
class RayMapStream:
    """A map of rays at all scales (see ray_map); each micro-batch is one batch of rays.

    Version n holds the blocks that batch n changed and follows from the versions before it,
    so a repeated batch does no harm. Every compact_every batches the merged map becomes the
    base of later reads.
    """

    path: str
    how: ray_map.RayMap = field(default_factory=ray_map.RayMap)
    per_segment: int = ray_map.PER_SEGMENT
    compact_every: int = 50

    @property
    def store(self) -> BlockStore:
        return BlockStore(self.path, ray_map.STATE)

    def voxels(self, spark: SparkSession, version: int) -> DataFrame:
        return self.store.read(spark, version)

    def update(self, rays: DataFrame, batch: int) -> None:
        """Integrate the rays (scan, seq, x, y, z and poses) of one batch; one without rays changes nothing."""
        spark = rays.sparkSession
        self.store.write(ray_map.changes(self.store.read(spark, batch - 1), rays, self.how, self.per_segment), batch)
        if batch and batch % self.compact_every == 0:
            self.store.compact(spark, batch)

    def start(self, rays: DataFrame, **options) -> StreamingQuery:
        """Integrate a stream of rays; a batch's size is set by the source (maxFilesPerTrigger) and the trigger."""
        writer = rays.writeStream.foreachBatch(self.update).option("checkpointLocation", f"{self.path}/checkpoint")
        return writer.trigger(**(options or {"availableNow": True})).start()
