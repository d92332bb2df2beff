"""Free space in octants: against a recursion over a tree, and a map of a flat wall."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from voxelspark.functions import morton as m
from voxelspark.functions.sensors import Pinhole
from voxelspark.operators import free_space, fusion
from voxelspark.streaming import blocks

from .cost import shuffled_rows

TOP, FREE = 6, -5.015


class Tree:
    """The recursion: a leaf is updated, what lies below a node is reached through its children."""

    def __init__(self):
        self.leaf = {(0, 0, 0, TOP): (0.0, 0)}

    def split_to(self, x, y, z, s):
        for t in range(TOP, s, -1):
            k = (x >> t << t, y >> t << t, z >> t << t, t)
            if k in self.leaf:
                held, h = self.leaf.pop(k), 1 << (t - 1)
                for c in range(8):
                    self.leaf[k[0] + (c & 1) * h, k[1] + (c >> 1 & 1) * h, k[2] + (c >> 2) * h, t - 1] = held

    def visit(self, x, y, z, s, value):
        self.split_to(x, y, z, s)
        if value is None:
            return
        for k, (mean, w) in self.leaf.items():
            if k[3] <= s and all(a <= b < a + (1 << s) for a, b in zip((x, y, z), k, strict=False)):
                n = min(w + 1, 20)
                self.leaf[k] = ((mean * (n - 1) + value) / n, n)

    def free(self, x, y, z, s):
        below = [v for k, v in self.leaf.items() if k[3] <= s and all(a <= b < a + (1 << s) for a, b in zip((x, y, z), k, strict=False))]
        return bool(below) and all(w > 0 and mean * w <= -95 for mean, w in below)

    def pruned(self):
        out = set()
        for k in self.leaf:
            up = [(*[c >> t << t for c in k[:3]], t) for t in range(TOP - 1, k[3] - 1, -1)]
            out.add(next((u for u in up if self.free(*u)), k))
        return out


def test_free_space_is_the_recursion(spark):
    rng, tree, rows = random.Random(3), Tree(), []
    for frame in range(260):
        s = rng.choice((3, 4, 4, 5, 5, 5))
        at = [rng.choice((0, 0, rng.randrange(64))) >> s << s for _ in range(3)]
        value = FREE if frame % 12 or s > 3 else rng.choice((None, 2.0))
        rows.append((*at, s, frame, value))
        tree.visit(*at, s, value)
    df = spark.createDataFrame(rows, "x int, y int, z int, s int, frame long, value double")
    visits = df.select(m.encode_key(m.encode_code(F.col("x"), F.col("y"), F.col("z")), F.col("s")).alias("key"), "frame", "value")
    state = spark.createDataFrame([], free_space.STATE)
    for low, high in ((0, 130), (130, 260)):
        state = spark.createDataFrame(free_space.update(state, visits.filter(F.col("frame").between(low, high - 1)), TOP).collect(), free_space.STATE)
    x, y, z = m.key_coord(F.col("key"))
    named = lambda d: {(r.x, r.y, r.z, r.s): (round(r.occupancy, 9), r.weight) for r in d.select(x.alias("x"), y.alias("y"), z.alias("z"), m.key_scale(F.col("key")).alias("s"), "occupancy", "weight").collect()}
    assert named(state) == {k: (round(a, 9), w) for k, (a, w) in tree.leaf.items()}
    leaf = free_space.summary(state)
    pruned = named(free_space.prune(leaf, TOP))
    assert pruned.keys() == tree.pruned() and len(pruned) < len(tree.leaf)
    root = free_space.bounds(leaf, TOP).filter(m.key_scale(F.col("key")) == TOP).collect()
    held = [a * w for a, w in tree.leaf.values() if w]
    assert [(round(r.low, 9), round(r.high, 9), r.observed) for r in root] == [(round(min(held), 9), round(max(held), 9), len(held) == len(tree.leaf))]
    assert free_space.update(spark.createDataFrame([], free_space.STATE), visits.limit(0), TOP).collect() == []


def test_visits_meet_their_leaves_in_one_shuffle(spark):
    """Many visits to a node and to blocks in it: rows shuffled grow with the visits, not with visits times leaves."""
    n, many = 64, 36_000
    i = F.col("id")
    # All of one node, then blocks of it in turn, split down to n leaves; one block has more visits than are kept.
    node = spark.range(many).filter(i % 3 == 0).select(m.encode_key(F.lit(0).cast("long"), F.lit(5)).alias("key"), (i * 5000).alias("frame"), F.sin(i.cast("double")).alias("value"))
    block = F.when(i % 3 == 1, 0).otherwise(i % n)
    blocks_ = spark.range(many).filter(i % 3 > 0).select(m.encode_key(block.cast("long") * 512, F.lit(3)).alias("key"), (i * 5000).alias("frame"), F.when(i < many - 1, F.cos(i.cast("double"))).alias("value"))
    visits = node.unionByName(blocks_)
    out = free_space.update(spark.createDataFrame([], free_space.STATE), visits, TOP)
    assert shuffled_rows(out) < 1.5 * many
    got = {r.key: (r.occupancy, r.weight) for r in out.collect()}
    assert len(got) == n + 7
    for b in (0, 1, 8, 63):
        mean, w = 0.0, 0
        for k in range(many - 1):
            if k % 3 == 0 or (k % 3 == 1 and b == 0) or (k % 3 == 2 and k % n == b):
                w = min(w + 1, 20)
                mean += ((math.sin(k) if k % 3 == 0 else math.cos(k)) - mean) / w
        assert got[b * 512 * 32 + 3] == (pytest.approx(mean, abs=1e-12), 20)


def test_map_before_a_wall(spark, tmp_path):
    """Everything well before a wall at 4 m is free, in nodes and blocks; frames later split nodes of the first.

    Voxels are up to 0.8 m wide at the wall, so values reach as far behind it.
    """
    camera, vmap = Pinhole(width=16, height=16, fx=6.0, fy=6.0, cx=7.5, cy=7.5, near=0.1, far=8.0), fusion.VoxelMap(dim=12.8, res=0.1)
    frames = spark.createDataFrame([(k, 0.0, 0.0, -3.4, [4.0 - 1.5 * (k == 2 and i % 16 < 6) for i in range(256)]) for k in range(3)], "frame long, tx double, ty double, tz double, depth array<double>")
    nodes, voxels = blocks.fuse_carved(frames, camera, vmap, str(tmp_path), tau=0.8)
    nodes = [r for r in nodes.collect() if r.weight]
    assert nodes and all(abs(r.occupancy - FREE) < 1e-9 and r.weight <= 3 for r in nodes)
    z = (F.col("vz") + F.pow(F.lit(2.0), F.col("scale")) / 2) * 0.1 - 6.4
    rows = voxels.select("value", "weight", z.alias("z"), "scale").collect()
    near = [r for r in rows if r.z < -3.4 + 2.5 - 0.7]
    assert near and all(r.value == pytest.approx(FREE) for r in near)
    assert max(r.weight for r in rows) == 3 and any(r.value > 0 and 0.6 < r.z < 1.4 for r in rows)
    visited = spark.read.parquet(f"{tmp_path}/visits")
    assert visited.filter("value is null").count() and visited.filter("value is not null").count()
