"""Finest octants by ranges of codes: against a search by ancestors, hot points, missing coordinates, mixed scales."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from voxelspark.functions import morton as m
from voxelspark.operators import octree

TOP, SIZE = 6, 64


def mixed_tree(spark, seed):
    """Octants of mixed depth: of scale 3 to 5 with all their ancestors."""
    rng, keys = random.Random(seed), set()
    for _ in range(60):
        s = rng.choice((3, 3, 4, 5))
        keys.add(tuple(rng.randrange(SIZE) >> s << s for _ in range(3)) + (s,))
    rows = spark.createDataFrame(sorted(keys), "x int, y int, z int, s int")
    rows = rows.select(m.encode_key(m.encode_code(F.col("x"), F.col("y"), F.col("z")), F.col("s")).alias("key"))
    return octree.with_children(octree.allocate(rows, TOP))


def by_hand(tree, x, y, z, scale):
    """The octant at scale, else the first coarser one if it is a leaf."""
    for s in range(scale, TOP + 1):
        if (x >> s, y >> s, z >> s, s) in tree:
            key, mask = tree[x >> s, y >> s, z >> s, s]
            return key if s == scale or mask == 0 else None
    return None


def indexed(octants):
    x, y, z = m.key_coord(F.col("key"))
    rows = octants.select("key", "scale", "child_mask", x.alias("x"), y.alias("y"), z.alias("z")).collect()
    return {(r.x >> r.scale, r.y >> r.scale, r.z >> r.scale, r.scale): (r.key, r.child_mask) for r in rows}


def test_finest_octants(spark):
    octants = mixed_tree(spark, 1).persist()
    tree, rng = indexed(octants), random.Random(2)
    points = [(k, *[rng.randrange(SIZE) for _ in range(3)]) for k in range(600)]
    points += [(k, 7, 7, 7) for k in range(600, 1000)]  # one code with many points
    points += [(1000, 5, 6, 7), (1000, 5, 6, 7), (1001, None, 1, 1), (None, 60, 1, 1)]
    df = spark.createDataFrame(points, "id int, x int, y int, z int").withColumn("row", F.lit("own")).withColumn("part", F.lit(1))
    for scale in (3, 4):
        got = octree.finest(df, octants, scale, TOP)
        assert got.columns == ["id", "x", "y", "z", "row", "part", "key"]
        want = [(*p, "own", 1, None if p[1] is None else by_hand(tree, *p[1:], scale)) for p in points]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
        assert 0 < sum(r[-1] is not None for r in want) < len(want)
    none = octants.limit(0)
    assert {r.key for r in octree.finest(df, none, 3, TOP).collect()} == {None}
    assert octree.finest(df.limit(0), octants, 3, TOP).collect() == []
    octants.unpersist()


def test_neighbours_of_mixed_scales(spark):
    octants = mixed_tree(spark, 3).persist()
    tree = indexed(octants)
    want = []
    for (x, y, z, s), (key, _) in tree.items():
        for face, (dx, dy, dz) in enumerate(octree.FACES):
            at = [(x + dx) << s, (y + dy) << s, (z + dz) << s]
            if all(0 <= c < SIZE for c in at):
                want.append((key, face, by_hand(tree, *at, s)))
    got = octree.face_neighbours(octants, octants, SIZE, TOP).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r[2] is not None and r[2] & 31 > r[0] & 31 for r in want)
    octants.unpersist()


def test_rows_of_one_code_are_spread(spark):
    """Nine tenths of the points in one voxel: no part holds most of them."""
    octants = mixed_tree(spark, 5)
    points = spark.range(20000).select("id", *[F.when(F.col("id") % 10 == 0, F.col("id") * k % SIZE).otherwise(9).cast("int").alias(c) for k, c in ((3, "x"), (7, "y"), (11, "z"))])
    rows = octree.finest(points, octants, 3, TOP)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 10000


def test_ranks(spark):
    bounds = [1, 4, 4, 4, 9, 20, 20, 31]
    df = spark.range(35).select(F.col("id").alias("c"))
    for inclusive in (False, True):
        for k in range(len(bounds) + 1):
            got = df.select("c", octree._rank(bounds[:k], F.col("c"), inclusive).alias("r")).collect()
            assert all(r.r == sum(b <= r.c if inclusive else b < r.c for b in bounds[:k]) for r in got)


def test_codes_stay_out_of_grouping_keys(spark):
    """Methods beyond 8,000 bytes are never compiled: reading keys was ten times as slow with a code's expression copied into them."""
    from voxelspark.operators import keysets
    from voxelspark.plans import fixtures as fx

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for rows in (keysets.unique_at_scale(fx.keys(spark, "/root/testdata/sf0.001"), 2), fx.tree(spark, "/root/testdata/sf0.001")):
            stages = rows._jdf.queryExecution().debug().codegenToSeq()
            assert 0 < max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
