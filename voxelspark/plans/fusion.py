"""Queries over fusion, sensors and ray models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rigid, sensors
from ..operators import fusion, ray_fusion
from . import fixtures as fx
from .registry import query, table

CAMERA = sensors.Pinhole(8.0, 8.0, 3.5, 3.5, 8, 8, near=0.1, far=10.0)
MAP = fusion.VoxelMap()
_PLANES = CAMERA.planes()
_RADIUS = math.sqrt(3) / 2 * MAP.res * MAP.block


def poses(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), ((F.col("vec_id") % 16) * 0.1).cast("double").alias("tx"))
    return rows.withColumns({"ty": F.lit(0.0), "tz": F.lit(0.0)})


def depth(spark, sf_dir):
    return fx.pixels(spark, sf_dir).select("frame", "x", "y", (F.col("depth_mm") / 1000.0).alias("depth"))


def frames(spark, sf_dir):
    """One row per frame: its pose, and its image as an array by rows.

    The table is one small file, so its rows are dealt out; images are settled, else what
    filters frames by them would be done before they are dealt, in the one task that reads them.
    """
    depths = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 10000).cast("int") / 1000.0)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "embedding").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "frame")
    rows = fusion.settle(rows.select("frame", depths.alias("depth")), "depth")
    return rows.withColumns({"tx": ((F.col("frame") % 16) * 0.1).cast("double"), "ty": F.lit(0.0), "tz": F.lit(0.0)})


def turned(rows):
    """rows with quaternions of whole numbers: cameras that look in many directions."""
    k = F.col("frame")
    q = {"qw": F.lit(8.0), "qx": (k % 5 - 2) * 1.0, "qy": (k % 3 - 1) * 2.0, "qz": (k % 7 - 3) * 1.0}
    return rows.withColumns(q)


_D = f"""{fx.PIXELS},
po AS (SELECT vec_id AS frame, (vec_id % 16) * 0.1::DOUBLE AS tx FROM embeddings),
d AS (SELECT px.frame, x, y, depth_mm / 1000.0::DOUBLE AS depth, tx FROM px JOIN po ON po.frame = px.frame)"""
_HALF, _RES = f"{MAP.dim / 2}::DOUBLE", f"{MAP.res}::DOUBLE"
_ALLOC = f"""{_D},
sp AS (SELECT frame, tx, (x - 3.5::DOUBLE) / 8.0::DOUBLE * depth AS px, (y - 3.5::DOUBLE) / 8.0::DOUBLE * depth AS py, 1.0::DOUBLE * depth AS pz
       FROM d WHERE depth >= 0.1::DOUBLE AND depth <= {10 + MAP.band / 2}::DOUBLE),
sn AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS n FROM sp),
sa AS (SELECT frame, tx + px * a AS sx, 0.0::DOUBLE + py * a AS sy, 0.0::DOUBLE + pz * a AS sz
       FROM (SELECT sn.*, 1.0::DOUBLE + ({MAP.band / 2}::DOUBLE - k * {MAP.band / MAP.samples}::DOUBLE) / n AS a FROM sn, range({MAP.samples}) r(k))),
ab AS (SELECT DISTINCT frame, CAST(floor(trunc((sx + {_HALF}) / {_RES}) / 8) AS INTEGER) AS bx, CAST(floor(trunc((sy + {_HALF}) / {_RES}) / 8) AS INTEGER) AS "by", CAST(floor(trunc((sz + {_HALF}) / {_RES}) / 8) AS INTEGER) AS bz
       FROM sa WHERE least(sx, sy, sz) + {_HALF} >= 0 AND sx + {_HALF} < {MAP.dim}::DOUBLE AND sy + {_HALF} < {MAP.dim}::DOUBLE AND sz + {_HALF} < {MAP.dim}::DOUBLE)"""


def _plane_sql(x: str, y: str, z: str, radius: float, planes=_PLANES) -> str:
    return " AND ".join(f"{x} * ({p[0]!r}::DOUBLE) + {y} * ({p[1]!r}::DOUBLE) + {z} * ({p[2]!r}::DOUBLE) + ({float(p[3])!r}::DOUBLE) >= {-radius!r}::DOUBLE" for p in planes.tolist())


_Q = "(SELECT frame, 8.0::DOUBLE AS w, (frame % 5 - 2)::DOUBLE AS x, ((frame % 3 - 1) * 2)::DOUBLE AS y, (frame % 7 - 3)::DOUBLE AS z FROM (SELECT vec_id AS frame FROM embeddings))"
_TURN = ["w * w + x * x - y * y - z * z", "2 * (x * y - w * z)", "2 * (x * z + w * y)", "2 * (x * y + w * z)", "w * w - x * x + y * y - z * z", "2 * (y * z - w * x)", "2 * (x * z - w * y)", "2 * (y * z + w * x)", "w * w - x * x - y * y + z * z"]
_R = [f"r{i}{j}" for i in range(3) for j in range(3)]
_RO = f"ro AS (SELECT frame, {', '.join(f'({e}) / (w * w + x * x + y * y + z * z) AS {r}' for e, r in zip(_TURN, _R, strict=True))} FROM {_Q})"


def _world(i: int) -> str:
    return f"(r{i}0 * px + r{i}1 * py + r{i}2 * pz)"


def _seen(i: int) -> str:
    return f"(r0{i} * dx + r1{i} * dy + r2{i} * dz)"


_TURNED_ALLOC = f"""{_D}, {_RO},
sp AS (SELECT frame, tx, (x - 3.5::DOUBLE) / 8.0::DOUBLE * depth AS px, (y - 3.5::DOUBLE) / 8.0::DOUBLE * depth AS py, 1.0::DOUBLE * depth AS pz
       FROM d WHERE depth >= 0.1::DOUBLE AND depth <= {10 + MAP.band / 2}::DOUBLE),
sn AS (SELECT sp.*, {", ".join(_R)}, sqrt(px * px + py * py + pz * pz) AS n FROM sp JOIN ro USING (frame)),
sa AS (SELECT frame, tx + {_world(0)} * a AS sx, 0.0::DOUBLE + {_world(1)} * a AS sy, 0.0::DOUBLE + {_world(2)} * a AS sz
       FROM (SELECT sn.*, 1.0::DOUBLE + ({MAP.band / 2}::DOUBLE - k * {MAP.band / MAP.samples}::DOUBLE) / n AS a FROM sn, range({MAP.samples}) r(k))),
ab AS (SELECT DISTINCT frame, CAST(floor(trunc((sx + {_HALF}) / {_RES}) / 8) AS INTEGER) AS bx, CAST(floor(trunc((sy + {_HALF}) / {_RES}) / 8) AS INTEGER) AS "by", CAST(floor(trunc((sz + {_HALF}) / {_RES}) / 8) AS INTEGER) AS bz
       FROM sa WHERE least(sx, sy, sz) + {_HALF} >= 0 AND sx + {_HALF} < {MAP.dim}::DOUBLE AND sy + {_HALF} < {MAP.dim}::DOUBLE AND sz + {_HALF} < {MAP.dim}::DOUBLE)"""
_TURNED = f"""{_TURNED_ALLOC},
born AS (SELECT bx, "by", bz, min(frame) AS born FROM ab GROUP BY ALL),
bp AS (SELECT bx, "by", bz, born, po.frame, tx, {", ".join(_R)}, (bx * 8 + 4.0::DOUBLE) * {_RES} - {_HALF} - tx AS dx, ("by" * 8 + 4.0::DOUBLE) * {_RES} - {_HALF} AS dy, (bz * 8 + 4.0::DOUBLE) * {_RES} - {_HALF} AS dz FROM born, po JOIN ro ON ro.frame = po.frame WHERE po.frame IN (SELECT frame FROM ab)),
vi AS (SELECT * FROM bp WHERE frame = born OR (frame > born AND {_plane_sql(_seen(0), _seen(1), _seen(2), _RADIUS)})),
vd AS (SELECT frame, {", ".join(_R)}, bx * 8 + i AS vx, "by" * 8 + j AS vy, bz * 8 + l AS vz, (bx * 8 + i + 0.5::DOUBLE) * {_RES} - {_HALF} - tx AS dx, ("by" * 8 + j + 0.5::DOUBLE) * {_RES} - {_HALF} AS dy, (bz * 8 + l + 0.5::DOUBLE) * {_RES} - {_HALF} AS dz FROM vi, range(8) a(i), range(8) b(j), range(8) c(l)),
vc AS (SELECT frame, vx, vy, vz, {_seen(0)} AS cx, {_seen(1)} AS cy, {_seen(2)} AS cz FROM vd),
vp AS (SELECT *, cx * 8.0::DOUBLE / cz + 3.5::DOUBLE AS u, cy * 8.0::DOUBLE / cz + 3.5::DOUBLE AS v, sqrt(cx * cx + cy * cy + cz * cz) AS n FROM vc WHERE cz > 0 AND cz <= 10.0::DOUBLE),
vq AS (SELECT *, CAST(trunc(u + 0.5::DOUBLE) AS INTEGER) AS x, CAST(trunc(v + 0.5::DOUBLE) AS INTEGER) AS y FROM vp WHERE u >= -0.5 AND u < 7.5 AND v >= -0.5 AND v < 7.5),
ob AS (SELECT vx, vy, vz, vq.frame, (depth - cz) / cz * n AS sdf FROM vq JOIN d ON d.frame = vq.frame AND d.x = vq.x AND d.y = vq.y WHERE depth >= 0.1::DOUBLE),
us AS (SELECT vx, vy, vz, frame, least(sdf / {MAP.boundary}::DOUBLE, 1.0::DOUBLE) AS u FROM ob WHERE sdf >= -{MAP.boundary}::DOUBLE)"""


def _fused(frames: str) -> str:
    d = _ALLOC.replace("FROM px JOIN po ON po.frame = px.frame)", f"FROM px JOIN po ON po.frame = px.frame WHERE {frames.replace('frame', 'px.frame')})")
    centre = lambda c, t: f"((b{c} * 8 + 4.0::DOUBLE) * {_RES} - {_HALF} - {t})".replace("by ", '"by" ')
    return f"""{d},
born AS (SELECT bx, "by", bz, min(frame) AS born FROM ab GROUP BY ALL),
po2 AS (SELECT frame, tx FROM po WHERE {frames}),
vi AS (SELECT bx, "by", bz, frame, tx FROM born, po2 WHERE frame = born OR (frame > born AND {_plane_sql(centre("x", "tx"), centre("y", "0.0::DOUBLE"), centre("z", "0.0::DOUBLE"), _RADIUS)})),
vo AS (SELECT frame, tx, bx * 8 + i AS vx, "by" * 8 + j AS vy, bz * 8 + l AS vz FROM vi, range(8) a(i), range(8) b(j), range(8) c(l)),
vc AS (SELECT frame, vx, vy, vz, (vx + 0.5::DOUBLE) * {_RES} - {_HALF} - tx AS cx, (vy + 0.5::DOUBLE) * {_RES} - {_HALF} AS cy, (vz + 0.5::DOUBLE) * {_RES} - {_HALF} AS cz FROM vo),
vp AS (SELECT *, cx * 8.0::DOUBLE / cz + 3.5::DOUBLE AS u, cy * 8.0::DOUBLE / cz + 3.5::DOUBLE AS v, sqrt(cx * cx + cy * cy + cz * cz) AS n FROM vc WHERE cz > 0),
vq AS (SELECT *, CAST(trunc(u + 0.5::DOUBLE) AS INTEGER) AS x, CAST(trunc(v + 0.5::DOUBLE) AS INTEGER) AS y FROM vp WHERE u >= -0.5 AND u < 7.5 AND v >= -0.5 AND v < 7.5 AND n <= 10.0::DOUBLE * n / cz),
ob AS (SELECT vx, vy, vz, vq.frame, (depth - cz) / cz * n AS sdf FROM vq JOIN d ON d.frame = vq.frame AND d.x = vq.x AND d.y = vq.y WHERE depth >= 0.1::DOUBLE),
us AS (SELECT vx, vy, vz, frame, least(sdf / {MAP.boundary}::DOUBLE, 1.0::DOUBLE) AS u FROM ob WHERE sdf >= -{MAP.boundary}::DOUBLE)"""


_MICRO = "CAST(floor({} * 1000000 + 0.37::DOUBLE) AS BIGINT)"


def micro(c):
    """A double as millionths; cut where no simple fraction lies, so that the last bit of a sum decides nothing."""
    return F.floor(c * 1_000_000 + F.lit(0.37)).cast("long")


def _clamped(w: int, observed: str | None = None) -> str:
    """The running mean over all frames, with weights up to w, in SQL."""
    observed = observed or _fused("frame >= 0")
    mean = _MICRO.format(f"sum(u * pow({(w - 1) / w!r}::DOUBLE, greatest(n - greatest(i, {w}), 0)) / least(n, {w}))")
    return f"""WITH {observed}, r AS (SELECT vx, vy, vz, u, row_number() OVER w AS i, count(*) OVER (PARTITION BY vx, vy, vz) AS n FROM us WINDOW w AS (PARTITION BY vx, vy, vz ORDER BY frame))
SELECT vx, vy, vz, {mean} AS tsdf_1e6, CAST(least(count(*), {w}) AS INTEGER) AS weight FROM r GROUP BY vx, vy, vz"""


def _fuse(spark, sf_dir, vmap, pose=lambda rows: rows):
    out = fusion.fuse_frames(pose(frames(spark, sf_dir)), CAMERA, vmap)
    return out.select("vx", "vy", "vz", micro(F.col("tsdf")).alias("tsdf_1e6"), "weight")


@query(_clamped(MAP.max_weight))
def flagship_tsdf_fusion(spark, sf_dir):
    return _fuse(spark, sf_dir, MAP)


@query(_clamped(10))
def f04_clamped_fusion(spark, sf_dir):
    return _fuse(spark, sf_dir, fusion.VoxelMap(max_weight=10))


@query(_clamped(10, _TURNED))
def f04_rotated_fusion(spark, sf_dir):
    return _fuse(spark, sf_dir, fusion.VoxelMap(max_weight=10), turned)


@query(f'WITH {_TURNED_ALLOC} SELECT bx, "by", bz, min(frame) AS born FROM ab GROUP BY ALL')
def a05_rotated_blocks(spark, sf_dir):
    rows = fusion.surface_samples(fusion.posed(turned(frames(spark, sf_dir))), CAMERA, MAP)
    return rows.groupBy("bx", "by", "bz").agg(F.min("frame").alias("born"))


@query(f'WITH {_ALLOC} SELECT bx, "by", bz, min(frame) AS born FROM ab GROUP BY ALL')
def a05_surface_blocks(spark, sf_dir):
    rows = fusion.surface_samples(frames(spark, sf_dir), CAMERA, MAP)
    return rows.groupBy("bx", "by", "bz").agg(F.min("frame").alias("born"))


_EV = "SELECT event_id, user_id, event_type, value::DOUBLE AS value FROM events"


def _run(fade: float, w: int) -> str:
    mean = _MICRO.format(f"sum(value * pow({fade}::DOUBLE, greatest(n - greatest(i, {w}), 0)) / least(n, {w}))")
    return f"""WITH e AS ({_EV}), r AS (SELECT user_id, event_type, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT user_id, event_type, {mean} AS mean_1e6, CAST(least(count(*), {w}) AS INTEGER) AS weight"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").cast("double").alias("value"))


@query(_run(0.75, 4) + " FROM r GROUP BY user_id, event_type")
def f01_running_mean(spark, sf_dir):
    out = fusion.clamped_mean(_events(spark, sf_dir), ["user_id", "event_type"], "event_id", "value", 4)
    return out.select("user_id", "event_type", micro(F.col("mean")).alias("mean_1e6"), "weight")


@query(_run(0.95, 20) + ", true AS observed FROM r GROUP BY user_id, event_type")
def f02_occupancy_mean(spark, sf_dir):
    out = fusion.fuse_occupancy(_events(spark, sf_dir), ["user_id", "event_type"], "event_id", "value")
    return out.select("user_id", "event_type", micro(F.col("occupancy")).alias("mean_1e6"), "weight", "observed")


_MEAN = ", ".join(f"CAST(floor((f.{c} * (least(f.w + 1, 100) - 1) + e.{c}) / least(f.w + 1, 100)) AS BIGINT)" for c in "rgb")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, event_id * 7 % 256 AS r, event_id * 11 % 256 AS g, event_id * 13 % 256 AS b FROM events),
f AS (SELECT DISTINCT user_id, event_type, 0::BIGINT AS i, 0::BIGINT AS r, 0::BIGINT AS g, 0::BIGINT AS b, 0::BIGINT AS w FROM e
      UNION ALL SELECT f.user_id, f.event_type, f.i + 1, {_MEAN}, least(f.w + 1, 100) FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)
SELECT user_id, event_type, CAST(arg_max(r, i) AS INTEGER) AS r, CAST(arg_max(g, i) AS INTEGER) AS g, CAST(arg_max(b, i) AS INTEGER) AS b, CAST(arg_max(w, i) AS INTEGER) AS weight FROM f GROUP BY user_id, event_type""")
def f03_colour_mean(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_type", "event_id", *[(F.col("event_id") * k % 256).cast("int").alias(c) for c, k in (("r", 7), ("g", 11), ("b", 13))])
    return fusion.fuse_colour(rows, ["user_id", "event_type"], "event_id")


_ISM = "CASE WHEN x <= -s THEN -5.015::DOUBLE WHEN x < t / 2 THEN 5.015::DOUBLE * x / s WHEN x < t THEN 5.015::DOUBLE * t / (2.0::DOUBLE * s) END"


@query(f"WITH e AS (SELECT event_id, (value::DOUBLE - 100) / 100 AS x, 0.06::DOUBLE + (event_id % 5) / 50.0::DOUBLE AS t, 0.03::DOUBLE + (event_id % 3) / 100.0::DOUBLE AS s FROM events) SELECT event_id, {_MICRO.format(_ISM)} AS log_odds_1e6 FROM e")
def f06_inverse_sensor_model(spark, sf_dir):
    x, t, s = (F.col("value") - 100) / 100, F.lit(0.06) + (F.col("event_id") % 5) / F.lit(50.0), F.lit(0.03) + (F.col("event_id") % 3) / F.lit(100.0)
    return _events(spark, sf_dir).select("event_id", micro(fusion.inverse_sensor_model(x, t, s)).alias("log_odds_1e6"))


@query(f"WITH e AS ({_EV}) SELECT user_id, {_MICRO.format('-5.015::DOUBLE')} AS occupancy_1e6, CAST(least(count(*), 20) AS INTEGER) AS weight FROM e GROUP BY user_id")
def f07_free_voxels(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("free", F.lit(fusion.LOG_ODD_MIN))
    out = fusion.fuse_occupancy(rows, ["user_id"], "event_id", "free")
    return out.select("user_id", micro(F.col("occupancy")).alias("occupancy_1e6"), "weight")


@query("WITH e AS (SELECT event_id, (value::DOUBLE - 150) / 100 AS lo, (value::DOUBLE - 120) / 100 AS hi FROM events) SELECT event_id, CASE WHEN lo > 1.25::DOUBLE * 0.5::DOUBLE THEN 'undefined' WHEN hi < -1.25::DOUBLE * 0.3::DOUBLE THEN 'constant' ELSE 'gradient' END AS state FROM e")
def a08_variance_state(spark, sf_dir):
    state = fusion.variance_state((F.col("value") - 150) / 100, (F.col("value") - 120) / 100, F.lit(0.5), F.lit(0.3))
    return _events(spark, sf_dir).select("event_id", state.alias("state"))


@query("WITH e AS (SELECT event_id, value::DOUBLE / 100 AS d, (event_id % 400) / 100.0::DOUBLE AS n FROM events) SELECT event_id, CASE WHEN n + 0.4::DOUBLE < d - 0.3::DOUBLE THEN 'free' WHEN n < d + 0.5::DOUBLE / 2 THEN 'transition' WHEN n < d + 0.5::DOUBLE THEN 'occupied' ELSE 'undefined' END AS state FROM e")
def f11_ray_state(spark, sf_dir):
    near = (F.col("event_id") % 400) / F.lit(100.0)
    state = fusion.ray_state(F.col("value") / 100, near, near + F.lit(0.4), F.lit(0.5), F.lit(0.3))
    return _events(spark, sf_dir).select("event_id", state.alias("state"))


@query("SELECT event_id // 8 AS parent FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value::DOUBLE >= 1) = 8 AND max(-value::DOUBLE * 20) <= 0.95::DOUBLE * -100::DOUBLE")
def a09_prunable_nodes(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 8).alias("parent"), (F.col("value") >= 1).alias("observed"), (-F.col("value")).alias("occupancy"), F.lit(20).alias("weight"))
    return fusion.prunable(rows)


@query(f"""WITH {fx.RAYS}, l AS (SELECT *, sqrt(x * x + y * y + z * z) AS n, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM ry WINDOW w AS (PARTITION BY scan ORDER BY seq))
SELECT scan, seq, coalesce((x * px + y * py + z * pz) / (n * sqrt(px * px + py * py + pz * pz)) > {math.cos(0.5)!r}::DOUBLE AND abs(n - sqrt(px * px + py * py + pz * pz)) < 0.5::DOUBLE, false) AS skip FROM l""")
def f10_ray_skipping(spark, sf_dir):
    return fusion.too_close(fx.rays(spark, sf_dir).filter("abs(x) + abs(y) + abs(z) >= 0"), 0.5, 0.5)


@query(f"""WITH {fx.RAYS}, l AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM ry), s AS (SELECT *, CAST(floor((least(n + 0.2::DOUBLE, 3.0::DOUBLE) - 0.1::DOUBLE) / 0.05::DOUBLE) AS INTEGER) AS last FROM l WHERE n > 0),
k AS (SELECT scan, seq, x, y, z, n, unnest(generate_series(0, last)) AS k FROM s WHERE last >= 0)
SELECT DISTINCT scan, CAST(floor(x * ((0.1::DOUBLE + k * 0.05::DOUBLE) / n) / 0.4::DOUBLE) AS BIGINT) AS bx, CAST(floor(y * ((0.1::DOUBLE + k * 0.05::DOUBLE) / n) / 0.4::DOUBLE) AS BIGINT) AS "by", CAST(floor(z * ((0.1::DOUBLE + k * 0.05::DOUBLE) / n) / 0.4::DOUBLE) AS BIGINT) AS bz FROM k""")
def f09_ray_blocks(spark, sf_dir):
    rows = fusion.ray_samples(fx.rays(spark, sf_dir), 0.05, 0.1, 3.0, 0.2)
    return rows.select("scan", *[F.floor(F.col(f"s{c}") / F.lit(0.4)).cast("long").alias(f"b{c}") for c in "xyz"]).distinct()


_LIMIT = "greatest({}::DOUBLE, least({}::DOUBLE * n, {}::DOUBLE))"
_RAY = ray_fusion.RayModel()
_CELLS = ", ".join(f"CAST(floor(({c} / n * d + 6.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS v{c}" for c in "xyz")
_INSIDE = " AND ".join(f"{c} / n * d + 6.4::DOUBLE >= 0 AND {c} / n * d + 6.4::DOUBLE < 12.8::DOUBLE" for c in "xyz")


@query(f"""WITH {fx.RAYS}, l AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM ry),
m AS (SELECT *, {_LIMIT.format(*(repr(v) for v in (6.0 * 0.05, 0.026, 16.0 * 0.05)))} AS t, 3.0::DOUBLE * {_LIMIT.format(*(repr(v) for v in (1.5 * 0.05, 0.052, 6.0 * 0.05)))} AS s FROM l WHERE n >= 0.1),
k AS (SELECT *, unnest(generate_series(0, CAST(ceil((least(n + t, 10.0::DOUBLE) - 0.1::DOUBLE) / 0.025::DOUBLE) AS BIGINT) - 1)) AS k FROM m),
g AS (SELECT *, 0.1::DOUBLE + k * 0.025::DOUBLE AS d FROM k),
c AS (SELECT scan, seq, k, t, s, d - n AS x, {_CELLS} FROM g WHERE {_INSIDE}),
b AS (SELECT *, lag((vx, vy, vz)) OVER (PARTITION BY scan, seq ORDER BY k) AS before FROM c),
u AS (SELECT scan, seq, vx, vy, vz, least({_ISM}, 5.015::DOUBLE) AS value FROM b WHERE x < t AND (before IS NULL OR before <> (vx, vy, vz))),
r AS (SELECT vx, vy, vz, value, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY scan, seq) AS i, count(*) OVER (PARTITION BY vx, vy, vz) AS n FROM u)
SELECT CAST(vx AS INTEGER) AS vx, CAST(vy AS INTEGER) AS vy, CAST(vz AS INTEGER) AS vz,
       {_MICRO.format("sum(value * pow(0.95::DOUBLE, greatest(n - greatest(i, 20), 0)) / least(n, 20))")} AS occupancy_1e6, CAST(least(count(*), 20) AS INTEGER) AS weight
FROM r GROUP BY vx, vy, vz""")
def f09_ray_occupancy(spark, sf_dir):
    out = ray_fusion.fuse(fx.rays(spark, sf_dir), MAP, _RAY, per_segment=32)
    return out.select("vx", "vy", "vz", micro(F.col("occupancy")).alias("occupancy_1e6"), "weight")


_SMALL = CAMERA.downsampled(2)


@query(f"SELECT {_SMALL.fx!r}::DOUBLE AS fx, {_SMALL.cx!r}::DOUBLE AS cx, 4 AS width, false AS left_handed")
def p01_downsampled_camera(spark, sf_dir):
    return spark.createDataFrame([(_SMALL.fx, _SMALL.cx, _SMALL.width, _SMALL.left_handed)], "fx double, cx double, width int, left_handed boolean")


_PT = "e AS (SELECT event_id, ((event_id % 41) - 20) / 10.0::DOUBLE AS x, ((event_id % 31) - 15) / 10.0::DOUBLE AS y, value::DOUBLE / 20 - 1 AS z FROM events)"


def _space(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", (((F.col("event_id") % 41) - 20) / F.lit(10.0)).alias("x"), (((F.col("event_id") % 31) - 15) / F.lit(10.0)).alias("y"), (F.col("value") / 20 - 1).alias("z"))


def _xyz():
    return F.col("x"), F.col("y"), F.col("z")


@query(f"WITH {_PT}, p AS (SELECT *, x * 8.0::DOUBLE / nullif(z, 0) + 3.5::DOUBLE AS u, y * 8.0::DOUBLE / nullif(z, 0) + 3.5::DOUBLE AS v FROM e) SELECT event_id, CASE WHEN ok THEN CAST(trunc(u + 0.5::DOUBLE) AS INTEGER) END AS px, CASE WHEN ok THEN CAST(trunc(v + 0.5::DOUBLE) AS INTEGER) END AS py FROM (SELECT *, coalesce(z > 0 AND u >= -0.5 AND u < 7.5 AND v >= -0.5 AND v < 7.5, false) AS ok FROM p)")
def p02_project(spark, sf_dir):
    rows = _space(spark, sf_dir).withColumn("z", F.when(F.col("z") != 0, F.col("z")))
    u, v, ok = CAMERA.project(_xyz())
    return rows.select("event_id", F.when(ok, sensors.pixel(u)).alias("px"), F.when(ok, sensors.pixel(v)).alias("py"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(f'{float(round(v, 9))!r}::DOUBLE' for v in p)})" for k, p in enumerate(_PLANES.tolist())) + ") v(plane, a, b, c, d)")
def p03_frustum_planes(spark, sf_dir):
    return spark.createDataFrame([(k, *[round(v, 9) for v in p]) for k, p in enumerate(CAMERA.planes().tolist())], "plane int, a double, b double, c double, d double")


@query(f"WITH {_PT} SELECT event_id, ({_plane_sql('x', 'y', 'z', 0.0)}) AS seen, ({_plane_sql('x', 'y', 'z', 0.0, _PLANES[:5])}) AS seen_beyond FROM e")
def p04_points_in_frustum(spark, sf_dir):
    return _space(spark, sf_dir).select("event_id", CAMERA.sees_sphere(_xyz()).alias("seen"), CAMERA.sees_sphere(_xyz(), infinite=True).alias("seen_beyond"))


@query(f"WITH {_PT} SELECT event_id, ({_plane_sql('x', 'y', 'z', 0.5)}) AS seen, ({_plane_sql('x', 'y', 'z', 0.5, _PLANES[:5])}) AS seen_beyond FROM e")
def p05_spheres_in_frustum(spark, sf_dir):
    return _space(spark, sf_dir).select("event_id", CAMERA.sees_sphere(_xyz(), 0.5).alias("seen"), CAMERA.sees_sphere(_xyz(), 0.5, infinite=True).alias("seen_beyond"))


LIDAR = sensors.Lidar.ouster([-16.6, -8.0, 0.0, 8.0, 16.6], 1024, near=0.5, far=6.0)
_LO, _HI = math.radians(-16.6), math.radians(16.6)


@query(f"""WITH {_PT}, n AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM e WHERE x * x + y * y + z * z > 0), a AS (SELECT *, asin(z / r) AS el, greatest({_LO!r}::DOUBLE - asin(greatest(-1.0, least(1.0, z / r))), asin(greatest(-1.0, least(1.0, z / r))) - {_HI!r}::DOUBLE, 0.0::DOUBLE) AS miss FROM n)
SELECT event_id, r >= 0.5 AND el >= {_LO!r}::DOUBLE AND el <= {_HI!r}::DOUBLE AND r <= 6.0 AS point_seen, r + 0.3::DOUBLE >= 0.5 AND r - 0.3::DOUBLE <= 6.0 AND (r <= 0.3::DOUBLE OR sin(miss) * r <= 0.3::DOUBLE) AS sphere_seen FROM a""")
def p06_lidar_frustum(spark, sf_dir):
    rows = _space(spark, sf_dir).filter("x * x + y * y + z * z > 0")
    return rows.select("event_id", LIDAR.sees_point(_xyz()).alias("point_seen"), LIDAR.sees_sphere(_xyz(), 0.3).alias("sphere_seen"))


_PER = CAMERA.min_angle() / 0.05


def _ladder(r: str) -> str:
    return f"CASE WHEN {r} >= 6.0 THEN 3 WHEN {r} >= 3.0 THEN 2 WHEN {r} >= 1.5 THEN 1 ELSE 0 END"


@query(f"""WITH e AS (SELECT event_id, value::DOUBLE / 100 AS d, CAST(event_id % 5 AS INTEGER) - 1 AS last FROM events), l AS (SELECT *, {_ladder(f"(d * {CAMERA.min_angle()!r}::DOUBLE / 0.05::DOUBLE)")} AS now FROM e)
SELECT event_id, CAST(CASE WHEN last < 0 OR now = last THEN now ELSE {_ladder(f"((d + CASE WHEN now > last THEN -0.25::DOUBLE ELSE 0.25::DOUBLE END) * {_PER!r}::DOUBLE)")} END AS INTEGER) AS scale FROM l""")
def p07_integration_scale(spark, sf_dir):
    scale = CAMERA.scale(F.col("value") / 100, 0.05, (F.col("event_id") % 5).cast("int") - 1)
    return _events(spark, sf_dir).select("event_id", scale.alias("scale"))


@query(f"WITH {fx.PIXELS} SELECT DISTINCT x, y, {_MICRO.format('0.1::DOUBLE * sqrt(a * a + b * b + 1.0::DOUBLE) / 1.0::DOUBLE')} AS near_1e6, {_MICRO.format('10.0::DOUBLE * sqrt(a * a + b * b + 1.0::DOUBLE) / 1.0::DOUBLE')} AS far_1e6 FROM (SELECT x, y, (x - 3.5::DOUBLE) / 8.0::DOUBLE AS a, (y - 3.5::DOUBLE) / 8.0::DOUBLE AS b FROM px)")
def p08_near_far(spark, sf_dir):
    ray = CAMERA.ray(F.col("x"), F.col("y"))
    rows = fx.pixels(spark, sf_dir).select("x", "y").distinct()
    return rows.select("x", "y", micro(CAMERA.range_of(ray, CAMERA.near)).alias("near_1e6"), micro(CAMERA.range_of(ray, CAMERA.far)).alias("far_1e6"))


@query(f"SELECT 'ouster' AS sensor, {min(8.0, 360 / 1024)!r}::DOUBLE AS resolution UNION ALL SELECT 'leica', 0.25::DOUBLE")
def p09_lidar_angles(spark, sf_dir):
    leica = sensors.Lidar.leica(0.5, 0.25)
    return spark.createDataFrame([("ouster", LIDAR.resolution), ("leica", leica.resolution)], "sensor string, resolution double")


_TWIST = """tw AS (SELECT event_id, (event_id % 7 - 3) / 4.0::DOUBLE AS wx, (event_id % 5 - 2) / 3.0::DOUBLE AS wy, (event_id % 3) / 2.0::DOUBLE AS wz, (event_id % 11) / 5.0::DOUBLE AS tx, (event_id % 13) / 6.0::DOUBLE - 1 AS ty, 0.5::DOUBLE AS tz,
value::DOUBLE / 100 AS px, (event_id % 17) / 8.0::DOUBLE AS py, 1.0::DOUBLE AS pz FROM events)"""


def _twists(spark, sf_dir):
    e = F.col("event_id")
    w = ((e % 7 - 3) / F.lit(4.0), (e % 5 - 2) / F.lit(3.0), (e % 3) / F.lit(2.0))
    t = ((e % 11) / F.lit(5.0), (e % 13) / F.lit(6.0) - 1, F.lit(0.5))
    p = (F.col("value") / 100, (e % 17) / F.lit(8.0), F.lit(1.0))
    return _events(spark, sf_dir), t, w, p


_CIRCLE = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}


@query(f"""WITH {_TWIST}, an AS (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) AS a, wx * px + wy * py + wz * pz AS wp, wx * tx + wy * ty + wz * tz AS wt FROM tw),
qu AS (SELECT *, cos(a / 2) AS q, CASE WHEN a > 0 THEN sin(a / 2) / a ELSE 0.5::DOUBLE END AS f, CASE WHEN a > 0 THEN (1 - cos(a)) / (a * a) ELSE 0.5::DOUBLE END AS c, CASE WHEN a > 0 THEN (a - sin(a)) / (a * a * a) ELSE 0.0::DOUBLE END AS d FROM an)
SELECT event_id, {", ".join(_MICRO.format(f"(p{c} * (q * q - f * f * a * a) + 2 * f * f * w{c} * wp + 2 * q * f * (w{u} * p{v} - w{v} * p{u}) + t{c} + c * (w{u} * t{v} - w{v} * t{u}) + d * (w{c} * wt - t{c} * a * a))") + f" AS {c}_1e6" for c, (u, v) in _CIRCLE.items())} FROM qu""")
def p10_rigid_motion(spark, sf_dir):
    rows, t, w, p = _twists(spark, sf_dir)
    return rows.select("event_id", *[micro(v).alias(f"{c}_1e6") for c, v in zip("xyz", rigid.moved(t, w, p), strict=True)])


@query(f"""WITH {_TWIST}, n AS (SELECT *, {", ".join(f"(w{u} - t{u}) * (p{v} - w{v}) - (w{v} - t{v}) * (p{u} - w{u}) AS n{c}" for c, (u, v) in _CIRCLE.items())}, CAST(round(px * 100) AS BIGINT) AS k FROM tw), l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS n FROM n)
SELECT event_id, {", ".join("CASE WHEN n > 0 THEN " + _MICRO.format(f"(n{c} / n)") + f" END AS n{c}_1e6" for c in "xyz")}, CAST(greatest(1, pow(2, ceil(log2(greatest(k, 1))))) AS BIGINT) AS up, {_MICRO.format("(wx - floor(wx))")} AS part_1e6 FROM l""")
def p10_helpers(spark, sf_dir):
    rows, t, w, p = _twists(spark, sf_dir)
    normal = rigid.plane_normal(t, w, p)
    up = rigid.power_two_up(F.round(F.col("value") / 100 * 100))
    return rows.select("event_id", *[micro(v).alias(f"n{c}_1e6") for c, v in zip("xyz", normal, strict=True)], up.alias("up"), micro(rigid.fraction(w[0])).alias("part_1e6"))
