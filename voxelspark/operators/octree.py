"""The octree as a table octants(key, scale, is_block, ts, child_mask): scans, fetches, allocation, deletion."""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import morton as m
from ..functions.sensors import Pinhole
from .fusion import frustum_cells, in_view, posed

if TYPE_CHECKING:
    from .fusion import VoxelMap

BLOCK_SCALE = 3
#: The six neighbours across a face.
FACES = ((-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0))


def ancestors(keys: DataFrame, top: int, include_self: bool = True) -> DataFrame:
    """key, and one row for each ancestor up to scale top as (ancestor, at)."""
    low = m.key_scale(F.col("key")) + (0 if include_self else 1)
    rows = keys.withColumn("at", F.explode(F.when(low <= top, F.sequence(low, F.lit(top)))))
    return rows.withColumn("ancestor", m.encode_key(m.key_code(F.col("key")), F.col("at")))


def allocate(keys: DataFrame, top: int, existing: DataFrame | None = None, only_allocated: bool = False) -> DataFrame:
    """Keys of all octants needed for these: the keys and their ancestors up to scale top.

    With existing octants, only_allocated leaves out those that are there already.
    """
    needed = ancestors(keys.select("key").distinct(), top).select(F.col("ancestor").alias("key")).distinct()
    if existing is None:
        return needed
    if only_allocated:
        return needed.join(existing.select("key"), "key", "left_anti")
    return needed.unionByName(existing.select("key")).distinct()


def with_children(keys: DataFrame, block_scale: int = BLOCK_SCALE) -> DataFrame:
    """Octants (key, scale, is_block, child_mask) from a table of keys that holds all ancestors."""
    child = keys.filter(F.col("key").isNotNull()).select(m.parent_key(F.col("key")).alias("key"), m.child_index(m.key_code(F.col("key")), m.key_scale(F.col("key"))).alias("i"))
    masks = child.groupBy("key").agg(F.bit_or(m._shl(F.lit(1), F.col("i"))).cast("int").alias("child_mask"))
    scale = m.key_scale(F.col("key"))
    return keys.join(masks, "key", "left").select("key", scale.alias("scale"), (scale == block_scale).alias("is_block"), F.coalesce("child_mask", F.lit(0)).alias("child_mask"))


def allocate_children(keys: DataFrame) -> DataFrame:
    """The eight children of each key."""
    return keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("child")).select(m.child_key(F.col("key"), F.col("child")).alias("key"))


def delete_children(octants: DataFrame, parents: DataFrame, top: int) -> DataFrame:
    """Octants without the subtrees below parents; the parents stay."""
    own = octants.select("key", F.explode(F.sequence(F.least(m.key_scale(F.col("key")) + 1, F.lit(top)), F.lit(top))).alias("at"))
    own = own.filter(F.col("at") > m.key_scale(F.col("key"))).withColumn("ancestor", m.encode_key(m.key_code(F.col("key")), F.col("at")))
    gone = own.join(parents.select(F.col("key").alias("ancestor")).distinct(), "ancestor", "left_semi").select("key").distinct()
    return octants.join(gone, "key", "left_anti")


def nodes(octants: DataFrame) -> DataFrame:
    return octants.filter(~F.col("is_block"))


def blocks(octants: DataFrame) -> DataFrame:
    return octants.filter("is_block")


def in_frustum(octants: DataFrame, poses: DataFrame, camera: Pinhole, vmap: VoxelMap) -> DataFrame:
    """(frame, key) of the blocks that each camera of poses (frame, pose) may see, by the spheres around them.

    Poses and blocks meet by the cell of blocks that a block lies in: its sphere lies in the
    cell's, so no block is missed, and no pose meets blocks that are far from it.
    """
    cell, edge = 4, vmap.block
    places = dict(zip("xyz", m.key_coord(F.col("key")), strict=True))
    rows = blocks(octants).select("key", *[v.alias(c) for c, v in places.items()])
    rows = rows.withColumns({f"k{c}": F.floor(F.col(c) / (edge * cell)).cast("int") for c in "xyz"})
    # Few poses become many cells, so they are dealt out first, and only cells in the box around all blocks are tried.
    box = rows.agg(*[f(f"k{c}").alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))])
    dealt = posed(poses).repartition(4 * int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame")
    cells = frustum_cells(dealt.crossJoin(F.broadcast(box)), camera, vmap, cell, within=tuple((F.col(f"low_{c}"), F.col(f"high_{c}")) for c in "xyz"))
    both = rows.join(cells, ["kx", "ky", "kz"])
    centre = tuple((F.col(c) + F.lit(edge / 2)) * F.lit(vmap.res) - F.lit(vmap.dim / 2) for c in "xyz")
    return in_view(both, centre, math.sqrt(3) / 2 * vmap.res * edge, camera).select("frame", "key")


def leaves(octants: DataFrame) -> DataFrame:
    return octants.filter("child_mask = 0")


def updated_since(octants: DataFrame, ts: int) -> DataFrame:
    return octants.filter(F.col("is_block") & (F.col("ts") >= ts))


def fetch(points: DataFrame, octants: DataFrame, scale: int) -> DataFrame:
    """points (id, x, y, z) with the key of the octant at scale, null if it isn't there."""
    at = m.encode_key(m.encode_code(F.col("x"), F.col("y"), F.col("z")), F.lit(scale))
    rows = points.withColumn("want", at)
    return rows.join(octants.select(F.col("key"), F.col("key").alias("want")), "want", "left").drop("want")


#: Parts that codes are dealt to, for each shuffle partition and at most; only the spread depends on them.
PARTS, MOST_PARTS = 4, 4096


def _rank(bounds: list[int], code: Column, inclusive: bool) -> Column:
    """How many of the ascending bounds lie below code, or below or at it: among every n-th first, then within n."""
    step = max(1, math.isqrt(len(bounds)))
    reached = lambda b: b <= code if inclusive else b < code
    chunks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if not chunks:
        return F.lit(0)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    whole = F.size(F.filter(longs([c[-1] for c in chunks]), reached))
    inner = F.get(F.array(*[longs(c) for c in chunks]), whole)
    return whole * step + F.coalesce(F.size(F.filter(inner, reached)), F.lit(0)) - F.when(inner.isNull(), len(chunks) * step - len(bounds)).otherwise(0)


def locate(rows: DataFrame, code: Column, scale: Column, octants: DataFrame, top: int = m.MAX_SCALE) -> DataFrame:
    """rows with found, the key of the octant at scale that holds code, else of the coarser leaf that does, else null.

    For one scale these octants are disjoint ranges of codes. Rows and ranges are dealt to parts
    by quantiles of the rows' codes and meet in one exchange, sorted: a row's range is the last
    that begins at or before it. A range goes to every part that it reaches into, which adds no
    more rows than there are parts. Rows of one code that fill several parts are spread over them
    by hash, and rows without a code, which nothing holds, over all.
    """
    spark = rows.sparkSession
    n = min(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_PARTS)
    points = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), code.alias("code"), scale.cast("int").alias("at"))
    cuts, low = points.agg(F.percentile_approx("code", [k / n for k in range(1, n)], 10 * n), F.min("at")).first()
    cuts = cuts or []
    first, last = _rank(cuts, F.col("code"), False), _rank(cuts, F.col("code"), True)
    salt = F.xxhash64("row")
    part = F.when(F.col("code").isNull(), F.pmod(salt, F.lit(n))).otherwise(first + F.pmod(salt, last - first + 1))
    own = m.key_scale(F.col("key"))
    ranges = octants.filter((own <= top) & (own >= F.lit(low))).select("key", "child_mask", m.key_code(F.col("key")).alias("code"), own.alias("own"))
    # An octant answers rows of its own scale; a leaf also those of finer scales.
    ranges = ranges.withColumn("at", F.explode(F.when(F.col("child_mask") == 0, F.sequence(F.lit(low).cast("int"), "own")).otherwise(F.array("own"))))
    end = m.descendants_end(F.col("code"), F.col("own"))
    ranges = ranges.withColumn("part", F.explode(F.sequence(_rank(cuts, F.col("code"), False), _rank(cuts, end - 1, True))))
    ranges = ranges.select("code", "at", F.col("part").cast("long").alias("part"), F.struct("key", end.alias("end")).alias("range"))
    both = points.withColumn("part", part.cast("long")).unionByName(ranges, allowMissingColumns=True)
    so_far = Window.partitionBy("part", "at").orderBy("code", F.col("row").isNotNull())
    both = both.withColumn("range", F.last("range", ignorenulls=True).over(so_far)).filter("row is not null")
    return both.select("row.*", F.when(F.col("code") < F.col("range.end"), F.col("range.key")).alias("found"))


def finest(points: DataFrame, octants: DataFrame, scale: int, top: int) -> DataFrame:
    """points with the deepest octant (key) that holds them, down to scale.

    Where the octant at scale is missing, its ancestor counts only if that is a leaf. Points
    without coordinates are in no octant; repeated points each get their row.
    """
    return locate(points, m.encode_code(F.col("x"), F.col("y"), F.col("z")), F.lit(scale), octants, top).withColumnRenamed("found", "key")


def face_neighbours(octants: DataFrame, of: DataFrame, size: int, top: int) -> DataFrame:
    """For each octant in of and face: the same or a coarser octant beyond it, null if there is none.

    Faces on the border of the map are left out, and so are octants that hold the one asked for.
    """
    x, y, z = m.key_coord(F.col("key"))
    step = m.octant_size(m.key_scale(F.col("key")))
    rows = of.select("key", x.alias("x"), y.alias("y"), z.alias("z"), step.alias("step"))
    faces = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(f, ("dx", "dy", "dz"), strict=True)], F.lit(k).alias("face")) for k, f in enumerate(FACES)])
    rows = rows.withColumn("f", F.explode(faces))
    for c in "xyz":
        rows = rows.withColumn(c, F.col(c) + F.col(f"f.d{c}") * F.col("step"))
    inside = (F.least("x", "y", "z") >= 0) & (F.greatest("x", "y", "z") < size)
    rows = rows.filter(inside).select("key", F.col("f.face").alias("face"), m.encode_code(F.col("x"), F.col("y"), F.col("z")).alias("code"))
    rows = locate(rows, F.col("code"), m.key_scale(F.col("key")), octants, top)
    return rows.select("key", "face", F.when(~m.is_descendant(F.col("key"), F.col("found")), F.col("found")).alias("neighbour"))


def neighbours26(keys: DataFrame, size: int) -> DataFrame:
    """The up to 26 keys around each key at its own scale, inside the map."""
    x, y, z = m.key_coord(F.col("key"))
    step = m.octant_size(m.key_scale(F.col("key")))
    offsets = F.sequence(F.lit(0), F.lit(26))
    rows = keys.select("key", x.alias("x"), y.alias("y"), z.alias("z"), step.alias("s"), F.explode(offsets).alias("o")).filter("o <> 13")
    rows = rows.select("key", (F.col("x") + (F.col("o") % 3 - 1) * F.col("s")).alias("x"), (F.col("y") + ((F.col("o") / 3).cast("int") % 3 - 1) * F.col("s")).alias("y"), (F.col("z") + ((F.col("o") / 9).cast("int") - 1) * F.col("s")).alias("z"))
    rows = rows.filter((F.least("x", "y", "z") >= 0) & (F.greatest("x", "y", "z") < size))
    return rows.select("key", m.encode_key(m.encode_code(F.col("x"), F.col("y"), F.col("z")), m.key_scale(F.col("key"))).alias("neighbour"))


def siblings(keys: DataFrame) -> DataFrame:
    """The eight keys of each key's parent, the key itself among them."""
    parent = keys.select("key", m.parent_key(F.col("key")).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c"))
    return parent.select("key", m.child_key(F.col("p"), F.col("c")).alias("sibling"))


def bounds(octants: DataFrame) -> DataFrame:
    """One row: the smallest box (inclusive voxel coordinates) around all leaves."""
    x, y, z = m.key_coord(F.col("key"))
    size = m.octant_size(m.key_scale(F.col("key"))) - 1
    aggs = [f(e).alias(n) for c, e in zip("xyz", (x, y, z), strict=True) for f, e, n in ((F.min, e, f"min_{c}"), (F.max, e + size, f"max_{c}"))]
    return leaves(octants).agg(*aggs)


def map_size(dim: float, res: float, block_size: int = 8) -> int:
    """Edge of the cubic octree in voxels for a requested extent: a power of two, two blocks at least."""
    import math

    return 1 << math.ceil(math.log2(max(math.ceil(dim / res), 2 * block_size)))


def block_depth(size: int, block_size: int = 8) -> int:
    """Levels between the root and the blocks."""
    return (size // block_size).bit_length() - 1


def block_scales(blocks_: DataFrame, low: int) -> DataFrame:
    """blocks (key, curr_scale) with one row for each scale they hold, from the coarsest down to low."""
    return blocks_.withColumn("scale", F.explode(F.sequence(F.lit(low), F.lit(BLOCK_SCALE))))


def drop_scales(levels: DataFrame, up_to: int) -> DataFrame:
    """Block levels without those finer than up_to."""
    return levels.filter(F.col("scale") >= up_to)


def propagate_timestamps(octants: DataFrame, top: int) -> DataFrame:
    """octants with ts the latest of all blocks below, for every ancestor up to the root."""
    own = ancestors(octants.filter("is_block").select("key", "ts"), top)
    latest = own.groupBy(F.col("ancestor").alias("key")).agg(F.max("ts").alias("latest"))
    return octants.join(latest, "key", "left").withColumn("ts", F.coalesce("latest", "ts")).drop("latest")
