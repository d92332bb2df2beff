"""Queries over stateful fusion, ray batches and refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carve, fusion, octree
from ..streaming import blocks
from ..streaming import rays as ray_batches
from . import fixtures as fx
from . import sql as q
from .fusion import _RADIUS, _RO, _R, CAMERA, MAP, _clamped, _plane_sql, _seen, frames, micro, poses, turned
from .keys import _tree
from .registry import query


#: A batch ends with the first ray that lies more than the interval after its first one; an open last batch is left out.
@query(f"""WITH RECURSIVE {fx.RAYS}, o AS (SELECT scan, seq, ts, row_number() OVER (PARTITION BY scan ORDER BY ts, seq) AS i FROM ry),
e AS (SELECT a.scan, a.i, min(b.i) AS j FROM o a JOIN o b ON b.scan = a.scan AND b.ts > a.ts + 86400000000 GROUP BY a.scan, a.i),
bt AS (SELECT scan, i, j, 0::BIGINT AS batch FROM e WHERE i = 1 UNION ALL SELECT e.scan, e.i, e.j, bt.batch + 1 FROM bt JOIN e ON e.scan = bt.scan AND e.i = bt.j + 1)
SELECT o.scan, o.seq, bt.batch FROM o JOIN bt ON bt.scan = o.scan AND o.i BETWEEN bt.i AND bt.j""")
def r14_ray_batches(spark, sf_dir):
    return ray_batches.batches(fx.rays(spark, sf_dir).select("scan", "seq", "ts"), 86_400_000_000)


@query()
def f05_multires_tsdf(spark, sf_dir):
    return blocks.fuse_frames(frames(spark, sf_dir), CAMERA, MAP, occupancy=False)


@query()
def f08_multires_occupancy(spark, sf_dir):
    return blocks.fuse_frames(frames(spark, sf_dir), CAMERA, MAP)


@query(_clamped(MAP.max_weight))
def f12_incremental_fusion(spark, sf_dir):
    """The second half of a sequence fused into the map of the first."""
    fr = frames(spark, sf_dir)
    late = F.col("frame") >= fr.agg(F.max("frame")).first()[0] // 2
    first = fusion.fuse_frames(fr.filter(~late), CAMERA, MAP)
    seen = fusion.visits(fusion.surface_samples(fr, CAMERA, MAP), fr, CAMERA, MAP).filter(late)
    out = fusion.fold_visits(seen, fr.filter(late), CAMERA, MAP, first)
    return out.select("vx", "vy", "vz", micro(F.col("tsdf")).alias("tsdf_1e6"), "weight")


@query()
def a06_volume_carver(spark, sf_dir):
    return carve.carve_frames(frames(spark, sf_dir), CAMERA, MAP)


@query(f"WITH {q.TREE} SELECT key, CASE WHEN (code >> 9) % 3 = 0 THEN 7 ELSE CAST(scale AS INTEGER) END AS data FROM t")
def a10_set_data(spark, sf_dir):
    from ..functions import morton as m

    rows = _tree(spark, sf_dir).select("key", F.col("scale").alias("data"))
    new = rows.filter(m._shr(m.key_code(F.col("key")), 9) % 3 == 0).withColumn("data", F.lit(7))
    return carve.set_data(rows, new)


WIDE = fusion.VoxelMap(dim=25.6)
_AT = ", ".join(f"({q.decode('t.code', k)} + 4.0::DOUBLE) * 0.05::DOUBLE - 12.8::DOUBLE - {s} AS d{c}" for k, (c, s) in enumerate(zip("xyz", ("(tx - 8)", "(-12.0)::DOUBLE", "(-16.0)::DOUBLE"), strict=True)))


@query(f"""WITH {q.TREE}, {_RO}, po AS (SELECT vec_id AS frame, (vec_id % 16) * 0.1::DOUBLE AS tx FROM embeddings),
d AS (SELECT t.key, ro.frame, {", ".join(_R)}, {_AT} FROM t, po JOIN ro ON ro.frame = po.frame WHERE t.is_block)
SELECT frame, key FROM d WHERE {_plane_sql(_seen(0), _seen(1), _seen(2), _RADIUS)}""")
def t06_blocks_in_frustum(spark, sf_dir):
    before = poses(spark, sf_dir).withColumns({"tx": F.col("tx") - 8, "ty": F.lit(-12.0), "tz": F.lit(-16.0)})
    return octree.in_frustum(_tree(spark, sf_dir), turned(before), CAMERA, WIDE)
