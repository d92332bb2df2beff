"""Queries over ray casting and pose alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import icp, images, raycast
from .fixtures import RES
from .fusion import CAMERA, micro
from .images import _CLOUD, _depth
from .registry import query, table
from .voxels import _VOX, _micros, grad_sql, vox

#: Half-voxel steps up to the camera's far plane.
STEPS = round(CAMERA.far / RES / 0.5)
_M = "CAST(floor({} * 1000000 + 0.37::DOUBLE) AS BIGINT)"
_RAY = """ra AS (SELECT event_id AS id, (event_id % 400)::DOUBLE AS ox, (event_id % 60)::DOUBLE AS oy, 3.5::DOUBLE AS oz, a / n AS dx, b / n AS dy, 0.0::DOUBLE AS dz FROM
(SELECT event_id, (event_id % 7 - 3)::DOUBLE AS a, (event_id % 5 + 1)::DOUBLE AS b, sqrt((event_id % 7 - 3) * (event_id % 7 - 3)::DOUBLE + (event_id % 5 + 1) * (event_id % 5 + 1)::DOUBLE) AS n FROM events))"""


def rays(spark, sf_dir):
    """A ray in voxels from every event."""
    e = F.col("event_id")
    a, b = (e % 7 - 3).cast("double"), (e % 5 + 1).cast("double")
    n = F.sqrt(a * a + b * b)
    rows = table(spark, sf_dir, "events")
    return rows.select(e.alias("id"), (e % 400).cast("double").alias("ox"), (e % 60).cast("double").alias("oy"), F.lit(3.5).alias("oz"), (a / n).alias("dx"), (b / n).alias("dy"), F.lit(0.0).alias("dz"))


def _slab(c: str) -> tuple[str, str]:
    return f"CASE WHEN d{c} <> 0 THEN least((0.0 - (o{c} - 100)) / nullif(d{c}, 0), (256.0 - (o{c} - 100)) / nullif(d{c}, 0)) ELSE 0.0 END", f"CASE WHEN d{c} <> 0 THEN greatest((0.0 - (o{c} - 100)) / nullif(d{c}, 0), (256.0 - (o{c} - 100)) / nullif(d{c}, 0)) ELSE 'infinity'::DOUBLE END"


@query(f"""WITH {_RAY}, m AS (SELECT id, ox, oy, 103.5::DOUBLE AS oz, dx, dy, dz FROM ra), s AS (SELECT *, greatest(0.0, {", ".join(_slab(c)[0] for c in "xyz")}) AS near, least({", ".join(_slab(c)[1] for c in "xyz")}) AS far FROM m)
SELECT id, CASE WHEN (dx <> 0 OR (ox >= 100 AND ox < 356)) AND near <= far AND near <= 150 THEN {_M.format('near')} END AS t_1e6 FROM s""")
def c01_map_entry(spark, sf_dir):
    moved = rays(spark, sf_dir).withColumns({"ox": F.col("ox") - 100, "oy": F.col("oy") - 100, "oz": F.lit(3.5)})
    return moved.select("id", micro(raycast.entry_distance(256.0, 150.0)).alias("t_1e6"))


_PLANES = " UNION ".join(f"SELECT * FROM (SELECT id, (m * 8 - o{c}) / nullif(d{c}, 0) AS t FROM ra, range(-40, 90) r(m)) WHERE t > 0 AND t < {STEPS * 0.5}" for c in "xyz")


@query(f"""WITH {_RAY}, c AS (SELECT id, 0.0::DOUBLE AS t FROM ra UNION SELECT id, {STEPS * 0.5}::DOUBLE FROM ra UNION {_PLANES}),
s AS (SELECT id, t, lead(t) OVER w AS u, CAST(row_number() OVER w AS INTEGER) AS n FROM c WINDOW w AS (PARTITION BY id ORDER BY t))
SELECT id, n, {", ".join(f'CAST(floor((o{c} + (t + u) / 2 * d{c}) / 8) AS INTEGER) AS "b{c}"' for c in "xyz")} FROM s JOIN ra USING (id) WHERE u IS NOT NULL""")
def t12_blocks_on_ray(spark, sf_dir):
    return raycast.blocks_on_ray(rays(spark, sf_dir), STEPS * 0.5)


_ALONG = f"""WITH {_VOX}, {_RAY}, sa AS (SELECT id, k, ox + k * 0.5::DOUBLE * dx AS x, oy + k * 0.5::DOUBLE * dy AS y, oz + k * 0.5::DOUBLE * dz AS z FROM ra, range({STEPS + 1}) r(k)),
ba AS (SELECT id, k, CAST(floor(x - 0.5) AS INTEGER) AS bx, CAST(floor(y - 0.5) AS INTEGER) AS by_, CAST(floor(z - 0.5) AS INTEGER) AS bz, x - 0.5 - floor(x - 0.5) AS fx, y - 0.5 - floor(y - 0.5) AS fy, z - 0.5 - floor(z - 0.5) AS fz FROM sa),
st AS (SELECT id, ba.k, (CASE a.i WHEN 1 THEN fx ELSE 1 - fx END) * (CASE b.i WHEN 1 THEN fy ELSE 1 - fy END) * (CASE c.i WHEN 1 THEN fz ELSE 1 - fz END) AS share, bx + a.i AS sx, by_ + b.i AS sy, bz + c.i AS sz FROM ba, range(2) a(i), range(2) b(i), range(2) c(i)),
it AS (SELECT id, k, sum(share * tsdf) AS value FROM st JOIN vox ON vx = sx AND vy = sy AND vz = sz WHERE weight > 0 GROUP BY id, k HAVING count(*) = 8),
al AS (SELECT sa.id, sa.k, value FROM sa LEFT JOIN it ON it.id = sa.id AND it.k = sa.k)"""


def _far(spark, sf_dir):
    return {"rays": rays(spark, sf_dir), "voxels": vox(spark, sf_dir), "steps": STEPS, "step": 0.5}


@query(f"{_ALONG} SELECT id, min(k) * 0.5::DOUBLE AS t FROM al WHERE value IS NOT NULL GROUP BY id")
def c03_first_known(spark, sf_dir):
    return raycast.known_hits(**_far(spark, sf_dir))


_CHANGE = f"{_ALONG}, ch AS (SELECT *, lag(value) OVER (PARTITION BY id ORDER BY k) AS before FROM al), hit AS (SELECT id, arg_min((k - 1) * 0.5::DOUBLE + before / (before - value) * 0.5::DOUBLE, k) AS t FROM ch WHERE before >= 0 AND value < 0 GROUP BY id)"


@query(f"{_CHANGE} SELECT id, {_M.format('t')} AS t_1e6 FROM hit")
def c04_raycast_surface(spark, sf_dir):
    surface = raycast.surface_hits(**_far(spark, sf_dir))
    return surface.select("id", micro(F.col("t")).alias("t_1e6"))


@query(f"{_ALONG} SELECT id, min(k) * 0.5::DOUBLE AS t FROM al WHERE value > 0.3137::DOUBLE GROUP BY id")
def c05_raycast_occupied(spark, sf_dir):
    return raycast.occupied_hits(level=0.3137, **_far(spark, sf_dir))


#: Two of three blocks hold nothing but free space.
_EMPTY = "vo AS (SELECT vx, vy, vz, CASE WHEN (vx // 8 + vy // 8 + vz // 8) % 3 <> 0 THEN -1.0::DOUBLE ELSE tsdf END AS tsdf, weight FROM vox)"


def emptied(spark, sf_dir):
    third = (F.floor(F.col("vx") / 8) + F.floor(F.col("vy") / 8) + F.floor(F.col("vz") / 8)) % 3
    return vox(spark, sf_dir).withColumn("tsdf", F.when(third != 0, F.lit(-1.0)).otherwise(F.col("tsdf")))


@query(_ALONG.replace(f"{_RAY}, ", f"{_EMPTY}, {_RAY}, ").replace("JOIN vox ON", "JOIN vo ON") + " SELECT id, min(k) * 0.5::DOUBLE AS t FROM al WHERE value > 0.3137::DOUBLE GROUP BY id")
def c02_skipped_space(spark, sf_dir):
    voxels = emptied(spark, sf_dir)
    return raycast.occupied_hits(level=0.3137, **_far(spark, sf_dir) | {"voxels": voxels, "blocks": raycast.occupied_blocks(voxels)})


_HITS = f"{_CHANGE}, pt AS (SELECT id, {', '.join(f'o{c} + t * d{c} AS {c}' for c in 'xyz')} FROM ra JOIN hit USING (id)), {grad_sql('vox', 0, 0.5)}, un AS (SELECT id, gx, gy, gz, sqrt(gx * gx + gy * gy + gz * gz) AS n FROM gr0)"


@query(f"{_HITS} SELECT pt.id, {', '.join(f'{_M.format(c)} AS {c}_1e6' for c in 'xyz')}, {', '.join(f'CASE WHEN n > 0 THEN {_M.format(f'g{c} / n')} END AS n{c}_1e6' for c in 'xyz')} FROM pt LEFT JOIN un ON un.id = pt.id")
def c06_raycast_volume(spark, sf_dir):
    surface = raycast.surface_hits(**_far(spark, sf_dir))
    return _micros(raycast.hits(rays(spark, sf_dir), surface, vox(spark, sf_dir)), "x", "y", "z", "nx", "ny", "nz")


POSE = np.eye(4)
POSE[:3, 3] = (0.01, -0.02, 0.03)


def _points(spark, sf_dir):
    cloud = images.point_cloud(_depth(spark, sf_dir), CAMERA)
    return cloud.join(images.normals(cloud), ["frame", "x", "y"])


def _tracked(spark, sf_dir):
    points = _points(spark, sf_dir)
    return icp.track(points, points, POSE, CAMERA, distance=0.3, cosine=0.5)


_NORMALS = f"""{_CLOUD}, nb AS (SELECT p.*, {", ".join(f"coalesce({f}({c}) OVER {w}, {c}) AS {k}{c}" for k, f, w in (("l", "lag", "a"), ("r", "lead", "a"), ("u", "lag", "b"), ("d", "lead", "b")) for c in ("px", "py", "pz"))}
FROM p WINDOW a AS (PARTITION BY frame, y ORDER BY x), b AS (PARTITION BY frame, x ORDER BY y)),
cv AS (SELECT *, rpx - lpx AS ax, rpy - lpy AS ay, rpz - lpz AS az, dpx - upx AS bx, dpy - upy AS by_, dpz - upz AS bz FROM nb),
cx AS (SELECT *, by_ * az - bz * ay AS cx, bz * ax - bx * az AS cy, bx * ay - by_ * ax AS cz FROM cv),
cn AS (SELECT frame, x, y, px, py, pz, CASE WHEN least(pz, lpz, rpz, upz, dpz) > 0 AND n > 0 THEN cx / n END AS nx, CASE WHEN least(pz, lpz, rpz, upz, dpz) > 0 AND n > 0 THEN cy / n END AS ny, CASE WHEN least(pz, lpz, rpz, upz, dpz) > 0 AND n > 0 THEN cz / n END AS nz FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS n FROM cx)),
mo AS (SELECT *, px + 0.01::DOUBLE AS mx, py - 0.02::DOUBLE AS my, pz + 0.03::DOUBLE AS mz, nx IS NOT NULL AND pz > 0 AS known FROM cn),
pr AS (SELECT *, mx * 8.0::DOUBLE / nullif(mz, 0) + 3.5::DOUBLE AS u, my * 8.0::DOUBLE / nullif(mz, 0) + 3.5::DOUBLE AS v FROM mo),
se AS (SELECT *, coalesce(known AND mz > 0 AND u >= -0.5 AND u < 7.5 AND v >= -0.5 AND v < 7.5, false) AS seen FROM pr),
jo AS (SELECT se.*, r.px - mx AS ex, r.py - my AS ey, r.pz - mz AS ez, r.nx AS rnx, r.ny AS rny, r.nz AS rnz FROM se LEFT JOIN cn r ON r.frame = se.frame AND seen AND r.x = CAST(trunc(u + 0.5::DOUBLE) AS INTEGER) AND r.y = CAST(trunc(v + 0.5::DOUBLE) AS INTEGER)),
tk AS (SELECT *, CASE WHEN NOT known THEN -1 WHEN NOT seen THEN -2 WHEN rnx IS NULL THEN -3 WHEN sqrt(ex * ex + ey * ey + ez * ez) > 0.3::DOUBLE THEN -4 WHEN nx * rnx + ny * rny + nz * rnz < 0.5 THEN -5 ELSE 1 END AS result, ex * rnx + ey * rny + ez * rnz AS error FROM jo)"""


@query(f"{_NORMALS} SELECT frame, x, y, result, CASE WHEN result = 1 THEN {_M.format('error')} END AS error_1e6 FROM tk")
def l02_track(spark, sf_dir):
    return _tracked(spark, sf_dir).select("frame", "x", "y", "result", micro(F.col("error")).alias("error_1e6"))


@query(f"{_NORMALS} SELECT frame, CAST(floor(coalesce(sum(error * error) FILTER (WHERE result = 1), 0) * 10000 + 0.37::DOUBLE) AS BIGINT) AS error2_1e4, CAST(floor(coalesce(sum(rnx * error) FILTER (WHERE result = 1), 0) * 10000 + 0.37::DOUBLE) AS BIGINT) AS e0_1e4, CAST(floor(coalesce(sum((my * rnz - mz * rny) * rnz) FILTER (WHERE result = 1), 0) * 10000 + 0.37::DOUBLE) AS BIGINT) AS a23_1e4, count(*) FILTER (WHERE result = 1) AS tracked, count(*) FILTER (WHERE result = -4) AS too_far, count(*) FILTER (WHERE result = -5) AS too_steep, count(*) FILTER (WHERE result IN (-1, -2, -3)) AS other FROM tk GROUP BY frame")
def l03_reduce(spark, sf_dir):
    sums = icp.reduce(_tracked(spark, sf_dir), ["frame"])
    part = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0.0)) * 10000 + F.lit(0.37)).cast("long").alias(f"{c}_1e4")
    return sums.select("frame", part("error2"), part("e0"), part("a23"), "tracked", "too_far", "too_steep", "other")


def _eliminated() -> str:
    """The normal equations as g0 (one row; column 6 holds J^T e) and Gauss-Jordan steps g1 to g6; positive definite, so no pivots."""
    jac = ["rnx", "rny", "rnz", "my * rnz - mz * rny", "mz * rnx - mx * rnz", "mx * rny - my * rnx"]
    out = [f"jc AS (SELECT error AS j6, {', '.join(f'{e} AS j{k}' for k, e in enumerate(jac))} FROM tk WHERE result = 1)"]
    out.append(f"g0 AS (SELECT {', '.join(f'sum(j{i} * j{j}) AS m{i}{j}' for i in range(6) for j in range(7))} FROM jc)")
    for p in range(6):
        cells = [f"m{p}{j} / m{p}{p} AS m{p}{j}" if i == p else f"m{i}{j} - m{i}{p} / m{p}{p} * m{p}{j} AS m{i}{j}" for i in range(6) for j in range(p + 1, 7)]
        out.append(f"g{p + 1} AS (SELECT {', '.join(cells)} FROM g{p})")
    return ", ".join(out)


@query(f"{_NORMALS}, {_eliminated()} {' UNION ALL '.join(f'SELECT CAST({k} AS INTEGER) AS k, {_M.format(f'm{k}6')} AS value_1e6 FROM g6' for k in range(6))}")
def l04_solve(spark, sf_dir):
    twist = icp.solve(icp.reduce(_tracked(spark, sf_dir)).first())
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(twist)], "k int, value double").select("k", micro(F.col("value")).alias("value_1e6"))


@query(f"{_NORMALS}, s AS (SELECT frame, sum(error * error) FILTER (WHERE result = 1) AS e, count(*) FILTER (WHERE result = 1) AS n FROM tk GROUP BY frame) SELECT frame, coalesce(n > 0 AND sqrt(e / n) <= 0.05::DOUBLE AND n / 64.0::DOUBLE >= 0.15::DOUBLE, false) AS good FROM s")
def l05_check_pose(spark, sf_dir):
    sums = icp.reduce(_tracked(spark, sf_dir), ["frame"])
    n = F.col("tracked")
    good = (n > 0) & (F.sqrt(F.try_divide(F.col("error2"), n)) <= 0.05) & (n / F.lit(64.0) >= 0.15)
    return sums.select("frame", F.coalesce(good, F.lit(False)).alias("good"))


_COL = " ".join(f"WHEN {c} THEN {{}}" for c in icp.COLOURS)


@query(f"{_NORMALS} SELECT frame, x, y, " + ", ".join(f"CASE result {_COL.format(*[rgb[k] for rgb in icp.COLOURS.values()])} END AS {n}" for k, n in enumerate("rgb")) + " FROM tk")
def l06_result_colours(spark, sf_dir):
    rgb = icp.result_colour(F.col("result"))
    return _tracked(spark, sf_dir).select("frame", "x", "y", *[v.alias(c) for c, v in zip("rgb", rgb, strict=True)])
