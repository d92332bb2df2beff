"""Queries over voxel tables: lookups, interpolation, pyramids and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morton as m
from ..functions import rigid
from ..operators import mesh, octree, pyramid, voxels
from . import fixtures as fx
from . import sql as q
from .fusion import micro
from .registry import query, table

_M = "CAST(floor({} * 1000000 + 0.37::DOUBLE) AS BIGINT)"
_VOX = f"""{q.TREE}, bl AS (SELECT {q.decode("code", 0)} AS x, {q.decode("code", 1)} AS y, {q.decode("code", 2)} AS z FROM t WHERE is_block),
vp AS (SELECT CAST(x + i AS INTEGER) AS vx, CAST(y + j AS INTEGER) AS vy, CAST(z + l AS INTEGER) AS vz FROM bl, range(8) a(i), range(8) b(j), range(8) c(l)),
vox AS (SELECT vx, vy, vz, ((vx * 7 + vy * 13 + vz * 29) % 41 - 20) / 20.0::DOUBLE AS tsdf, CAST(CASE WHEN (vx * 3 + vy * 5 + vz * 7) % 37 = 0 THEN 0 ELSE (vx + vy + vz) % 4 + 1 END AS INTEGER) AS weight FROM vp)"""


def vox(spark, sf_dir):
    """vx, vy, vz, tsdf, weight of every voxel of the blocks of all keys."""
    x, y, z = m.key_coord(F.col("key"))
    rows = octree.blocks(fx.tree(spark, sf_dir)).select(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x", "y", "z")
    for a, b in zip("xyz", "ijk", strict=True):
        rows = rows.withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn(f"v{a}", F.col(a) + F.col(b))
    c = [F.col(f"v{a}") for a in "xyz"]
    tsdf = ((c[0] * 7 + c[1] * 13 + c[2] * 29) % 41 - 20) / F.lit(20.0)
    weight = F.when((c[0] * 3 + c[1] * 5 + c[2] * 7) % 37 == 0, 0).otherwise((c[0] + c[1] + c[2]) % 4 + 1)
    return rows.select("vx", "vy", "vz", tsdf.alias("tsdf"), weight.alias("weight"))


_PT = """pt AS (SELECT o_orderkey AS id, o_custkey % 512 + (o_orderkey % 8) / 8.0::DOUBLE AS x, o_orderkey % 128 + (o_custkey % 8) / 8.0::DOUBLE AS y, o_orderkey % 7 + 0.25::DOUBLE AS z FROM orders)"""


def points(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), (c % 512 + (k % 8) / F.lit(8.0)).alias("x"), (k % 128 + (c % 8) / F.lit(8.0)).alias("y"), (k % 7 + F.lit(0.25)).alias("z"))


def _micros(df, *names):
    return df.select(*[c for c in df.columns if c not in names], *[micro(F.col(c)).alias(f"{c}_1e6") for c in names])


@query(f"WITH {_PT} SELECT id, (x - 100 >= 0 AND x - 100 < 300 AND y - 8 >= 0 AND y - 8 < 300 AND z >= 0 AND z < 300) AS inside FROM pt")
def q01_contains(spark, sf_dir):
    return points(spark, sf_dir).select("id", voxels.contains(300.0, F.col("x") - 100, F.col("y") - 8, F.col("z")).alias("inside"))


def _tv(c: str) -> str:
    return f"CAST(CASE WHEN {c} >= 0 AND {c} < 12.8::DOUBLE THEN trunc({c} / 0.05::DOUBLE) ELSE -1 END AS INTEGER)"


@query(f"WITH {_PT}, s AS (SELECT id, (x - 20) * 0.05::DOUBLE AS x, (y - 20) * 0.05::DOUBLE AS y FROM pt) SELECT id, {_tv('x')} AS vx, {_tv('y')} AS vy FROM s")
def q02_point_to_voxel(spark, sf_dir):
    at = lambda c: voxels.to_voxel((F.col(c) - 20) * F.lit(0.05), 0.05, 12.8)
    return points(spark, sf_dir).select("id", at("x").alias("vx"), at("y").alias("vy"))


_V3 = "SELECT vx, vy, vz FROM vox"


@query(f"WITH {_VOX}, v AS ({_V3}) SELECT vx, vy, vz, CAST(k AS INTEGER) AS corner, CAST(vx + k % 2 * 2 AS INTEGER) AS cx, CAST(vy + k // 2 % 2 * 2 AS INTEGER) AS cy, CAST(vz + k // 4 * 2 AS INTEGER) AS cz, {_M.format('(vx + 0.5::DOUBLE * 2) * 0.05::DOUBLE')} AS px_1e6 FROM v, range(8) r(k)")
def q03_voxel_corners(spark, sf_dir):
    rows = voxels.corners(vox(spark, sf_dir).select("vx", "vy", "vz"), stride=2)
    return rows.withColumn("px_1e6", micro(voxels.to_point(F.col("vx"), 0.05, 2)))


@query(f"WITH {_VOX}, {_PT} SELECT id, coalesce(tsdf, 1.0::DOUBLE) AS tsdf, coalesce(weight, 0) AS weight FROM pt LEFT JOIN vox ON vx = floor(x) AND vy = floor(y) AND vz = floor(z)")
def q04_lookup(spark, sf_dir):
    return voxels.lookup(points(spark, sf_dir), vox(spark, sf_dir))


def _mean_sql(src: str, name: str) -> str:
    return f"{name} AS (SELECT vx // 2 AS vx, vy // 2 AS vy, vz // 2 AS vz, avg(tsdf) AS tsdf, CAST(ceil(avg(weight)) AS INTEGER) AS weight FROM {src} WHERE weight > 0 GROUP BY 1, 2, 3)"


@query(f"WITH {_VOX}, {_PT}, {_mean_sql('vox', 'm1')} SELECT id, {_M.format('coalesce(tsdf, 1.0::DOUBLE)')} AS tsdf_1e6, coalesce(weight, 0) AS weight FROM pt LEFT JOIN m1 ON vx = floor(x / 2) AND vy = floor(y / 2) AND vz = floor(z / 2)")
def q05_lookup_at_scale(spark, sf_dir):
    half = points(spark, sf_dir).select("id", *[(F.col(c) / 2).alias(c) for c in "xyz"])
    return _micros(voxels.lookup(half, pyramid.mean(vox(spark, sf_dir))), "tsdf")


_OCC = "oc AS (SELECT vx, vy, vz, tsdf AS occupancy, weight, weight > 0 AS observed FROM vox)"
_EXT = """x AS (SELECT vx // 2 AS vx, vy // 2 AS vy, vz // 2 AS vz, CAST(vx % 2 + vy % 2 * 2 + vz % 2 * 4 AS INTEGER) AS child, occupancy, weight, observed, occupancy * weight AS field FROM oc),
lo AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY field, child) AS a, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY field DESC, child) AS b, count(*) OVER (PARTITION BY vx, vy, vz) AS n FROM x WHERE weight > 0),
ex AS (SELECT vx, vy, vz, max(CASE WHEN a = 1 THEN occupancy END) AS low_value, max(CASE WHEN a = 1 THEN weight END) AS low_weight, max(CASE WHEN a = 1 THEN child END) AS low_child, max(CASE WHEN b = 1 THEN occupancy END) AS high_value, max(CASE WHEN b = 1 THEN weight END) AS high_weight, max(CASE WHEN b = 1 THEN child END) AS high_child, max(n) = 8 AS observed FROM lo GROUP BY vx, vy, vz)"""


def occ(spark, sf_dir):
    return vox(spark, sf_dir).withColumnRenamed("tsdf", "occupancy").withColumn("observed", F.col("weight") > 0)


@query(f"WITH {_VOX}, {_OCC}, {_EXT}, {_PT} SELECT id, low_value * low_weight AS low, high_value * high_weight AS high FROM pt LEFT JOIN ex ON vx = floor(x / 2) AND vy = floor(y / 2) AND vz = floor(z / 2)")
def q06_min_max_at_scale(spark, sf_dir):
    half = points(spark, sf_dir).select("id", *[F.floor(F.col(c) / 2).cast("int").alias(f"v{c}") for c in "xyz"])
    rows = half.join(pyramid.extremes(occ(spark, sf_dir)), ["vx", "vy", "vz"], "left")
    return rows.select("id", (F.col("low_value") * F.col("low_weight")).alias("low"), (F.col("high_value") * F.col("high_weight")).alias("high"))


@query(f"WITH {_VOX} SELECT vx, vy, vz, CASE WHEN weight > 0 THEN tsdf END AS field, CASE WHEN weight > 0 THEN tsdf * weight END AS log_odds FROM vox")
def q07_field(spark, sf_dir):
    t, w = F.col("tsdf"), F.col("weight")
    return vox(spark, sf_dir).select("vx", "vy", "vz", voxels.field(t, w).alias("field"), voxels.occupancy_field(t, w).alias("log_odds"))


_BASE = "ba AS (SELECT id, CAST(floor(x - 0.5) AS INTEGER) AS bx, CAST(floor(y - 0.5) AS INTEGER) AS by_, CAST(floor(z - 0.5) AS INTEGER) AS bz, x - 0.5 - floor(x - 0.5) AS fx, y - 0.5 - floor(y - 0.5) AS fy, z - 0.5 - floor(z - 0.5) AS fz FROM pt)"
_INT = f"""{_BASE}, st AS (SELECT id, (CASE i WHEN 1 THEN fx ELSE 1 - fx END) * (CASE j WHEN 1 THEN fy ELSE 1 - fy END) * (CASE k WHEN 1 THEN fz ELSE 1 - fz END) AS share, bx + i AS sx, by_ + j AS sy, bz + k AS sz FROM ba, range(2) a(i), range(2) b(j), range(2) c(k)),
it AS (SELECT id, sum(share * {{value}}) AS value FROM st JOIN vox ON vx = sx AND vy = sy AND vz = sz WHERE weight > 0 GROUP BY id HAVING count(*) = 8)"""


@query(f"WITH {_VOX}, {_PT}, {_INT.format(value='tsdf')} SELECT pt.id, {_M.format('value')} AS value_1e6 FROM pt LEFT JOIN it ON it.id = pt.id")
def q08_trilinear(spark, sf_dir):
    return _micros(voxels.interpolate(points(spark, sf_dir), vox(spark, sf_dir)), "value")


@query(f"WITH {_VOX}, {_PT}, {_INT.format(value='(vx % 256)')} SELECT pt.id, CAST(floor(round(value, 9)) AS BIGINT) AS red FROM pt LEFT JOIN it ON it.id = pt.id")
def q09_colour_interpolation(spark, sf_dir):
    red = vox(spark, sf_dir).withColumn("red", (F.col("vx") % 256).cast("double"))
    rows = voxels.interpolate(points(spark, sf_dir), red, "red")
    return rows.select("id", F.floor(F.round("value", 9)).cast("long").alias("red"))


def _w(c: str, o: str, s: int) -> str:
    return f"(CASE {o} - ({s}) WHEN 0 THEN 1 - f{c} WHEN 1 THEN f{c} ELSE 0 END)"


def _slope(a: str) -> str:
    names = {"x": "i", "y": "j", "z": "k"}
    out = f"({_w(a, names[a], 1)} - {_w(a, names[a], -1)})"
    return out + "".join(f" * {_w(c, names[c], 0)}" for c in "xyz" if c != a)


@query(f"""WITH {_VOX}, {_PT}, {_BASE}, st AS (SELECT id, {", ".join(f"{_slope(c)} AS s{c}" for c in "xyz")}, bx + i AS px, by_ + j AS py, bz + k AS pz FROM ba, range(-1, 3) a(i), range(-1, 3) b(j), range(-1, 3) c(k)
WHERE CAST(i IN (0, 1) AS INTEGER) + CAST(j IN (0, 1) AS INTEGER) + CAST(k IN (0, 1) AS INTEGER) >= 2),
gr AS (SELECT id, {", ".join(f"sum(s{c} * tsdf) * 10.0::DOUBLE AS g{c}" for c in "xyz")} FROM st JOIN vox ON vx = px AND vy = py AND vz = pz WHERE weight > 0 GROUP BY id HAVING count(*) = 32)
SELECT pt.id, {", ".join(f"{_M.format(f'g{c}')} AS g{c}_1e6" for c in "xyz")} FROM pt LEFT JOIN gr ON gr.id = pt.id""")
def q10_gradient(spark, sf_dir):
    return _micros(voxels.gradient(points(spark, sf_dir), vox(spark, sf_dir), res=0.05), "gx", "gy", "gz")


def _int_sql(level: str, s: int) -> str:
    ba = _BASE.replace("ba AS", f"ba{s} AS").replace("FROM pt", f"FROM (SELECT id, x / {2**s} AS x, y / {2**s} AS y, z / {2**s} AS z FROM pt)")
    body = _INT.format(value="tsdf")[len(_BASE) :].replace("st AS", f"st{s} AS").replace("FROM ba,", f"FROM ba{s},").replace("it AS", f"it{s} AS").replace("FROM st JOIN vox", f"FROM st{s} JOIN {level}")
    return ba + body


@query(f"WITH {_VOX}, {_mean_sql('vox', 'm1')}, {_PT}, {_int_sql('vox', 0)}, {_int_sql('m1', 1)} SELECT pt.id, {_M.format('coalesce(it0.value, it1.value)')} AS value_1e6, CASE WHEN it0.value IS NOT NULL THEN 0 WHEN it1.value IS NOT NULL THEN 1 END AS scale FROM pt LEFT JOIN it0 ON it0.id = pt.id LEFT JOIN it1 ON it1.id = pt.id")
def q08_trilinear_scales(spark, sf_dir):
    rows = vox(spark, sf_dir)
    return _micros(voxels.interpolate_scales(points(spark, sf_dir), [rows, pyramid.mean(rows)]), "value")


def grad_sql(level: str, s: int, half: float) -> str:
    """gr{s} (id, gx, gy, gz) of the points pt where level has the whole stencil; half is 0.5 over a voxel's size."""
    ba = _BASE.replace("ba AS", f"gb{s} AS").replace("FROM pt", f"FROM (SELECT id, x / {2**s} AS x, y / {2**s} AS y, z / {2**s} AS z FROM pt)")
    return f"""{ba}, gs{s} AS (SELECT id, {", ".join(f"{_slope(c)} AS s{c}" for c in "xyz")}, bx + i AS px, by_ + j AS py, bz + k AS pz FROM gb{s}, range(-1, 3) a(i), range(-1, 3) b(j), range(-1, 3) c(k)
WHERE CAST(i IN (0, 1) AS INTEGER) + CAST(j IN (0, 1) AS INTEGER) + CAST(k IN (0, 1) AS INTEGER) >= 2),
gr{s} AS (SELECT id, {", ".join(f"sum(s{c} * tsdf) * {half}::DOUBLE AS g{c}" for c in "xyz")} FROM gs{s} JOIN {level} ON vx = px AND vy = py AND vz = pz WHERE weight > 0 GROUP BY id HAVING count(*) = 32)"""


@query(f"WITH {_VOX}, {_mean_sql('vox', 'm1')}, {_PT}, {grad_sql('vox', 0, 10.0)}, {grad_sql('m1', 1, 5.0)} SELECT pt.id, {', '.join(f'{_M.format(f'coalesce(gr0.g{c}, gr1.g{c})')} AS g{c}_1e6' for c in 'xyz')} FROM pt LEFT JOIN gr0 ON gr0.id = pt.id LEFT JOIN gr1 ON gr1.id = pt.id")
def q11_gradient_scales(spark, sf_dir):
    rows = vox(spark, sf_dir)
    return _micros(voxels.gradient_scales(points(spark, sf_dir), [rows, pyramid.mean(rows)], res=0.05), "gx", "gy", "gz")


@query(f"""WITH {_PT}, b AS (SELECT id % 100 AS cell, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM pt GROUP BY 1),
d AS (SELECT cell, greatest(10, least(400, ax - 2)) AS ax, greatest(10, least(400, bx + 2)) AS bx, greatest(10, least(400, ay - 2)) AS ay, greatest(10, least(400, by_ + 2)) AS by_, greatest(10, least(400, az - 2)) AS az, greatest(10, least(400, bz + 2)) AS bz FROM b)
SELECT cell, -by_ + 1 AS min_x, -ay + 1 AS max_x, ax + 2 AS min_y, bx + 2 AS max_y, az + 3 AS min_z, bz + 3 AS max_z FROM d""")
def q13_boxes(spark, sf_dir):
    box = voxels.box_of(points(spark, sf_dir).withColumn("cell", F.col("id") % 100), ["cell"])
    box = voxels.clamp(voxels.dilate(box, 2.0), 10.0, 400.0)
    return voxels.transformed(box, ((0, -1, 0), (1, 0, 0), (0, 0, 1)), (1, 2, 3))


_SLICE = "SELECT CAST(g.u AS INTEGER) AS u, CAST(g.v AS INTEGER) AS v, coalesce(tsdf, 1.0::DOUBLE) AS tsdf, coalesce(weight, 0) AS weight FROM (SELECT u, v FROM range({a}) x(u), range({b}) y(v)) g LEFT JOIN vox ON {u} = g.u AND {v} = g.v AND {w} = {at}"


@query(f"WITH {_VOX} " + " UNION ALL ".join(f"SELECT '{w}' AS axis, * FROM ({_SLICE.format(a=512, b=512, u=u, v=v, w='v' + w, at=at)})" for w, u, v, at in (("z", "vx", "vy", 3), ("y", "vx", "vz", 20), ("x", "vy", "vz", 100))))
def q14_slices(spark, sf_dir):
    rows = vox(spark, sf_dir)
    out = [voxels.plane(rows, axis, at, (512, 512)).select(F.lit(axis).alias("axis"), "*") for axis, at in (("z", 3), ("y", 20), ("x", 100))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {_VOX} {_SLICE.format(a=512, b=512, u='vx', v='vy', w='vz', at=5)}")
def w05_slice(spark, sf_dir):
    return voxels.plane(vox(spark, sf_dir), "z", 5, (512, 512))


@query(f"WITH {_VOX}, {_mean_sql('vox', 'm1')} SELECT vx, vy, vz, {_M.format('tsdf')} AS tsdf_1e6, weight FROM m1")
def h01_mip_mean(spark, sf_dir):
    return _micros(pyramid.mean(vox(spark, sf_dir)), "tsdf")


@query(f"WITH {_VOX}, {_mean_sql('vox', 'm1')} SELECT vx, vy, vz, {_M.format('tsdf')} AS occupancy_1e6, weight, false AS observed FROM m1")
def h02_occupancy_mean(spark, sf_dir):
    return _micros(pyramid.mean(occ(spark, sf_dir), "occupancy"), "occupancy").withColumn("observed", F.lit(False))


@query(f"WITH {_VOX}, {_OCC}, {_EXT} SELECT * FROM ex")
def h03_mip_min_max(spark, sf_dir):
    return pyramid.extremes(occ(spark, sf_dir))


@query(f"WITH {_VOX} SELECT vx // 2 AS vx, vy // 2 AS vy, vz // 2 AS vz, CAST(sum(vx % 256) // count(*) AS INTEGER) AS r, CAST(sum(vy % 256) // count(*) AS INTEGER) AS g, CAST(sum(vz * 9 % 256) // count(*) AS INTEGER) AS b, CAST(ceil(avg(weight)) AS INTEGER) AS weight FROM vox WHERE weight > 0 GROUP BY 1, 2, 3")
def h04_colour_mean(spark, sf_dir):
    rows = vox(spark, sf_dir).withColumns({"r": F.col("vx") % 256, "g": F.col("vy") % 256, "b": F.col("vz") * 9 % 256})
    return pyramid.mean_colour(rows)


_LEVELS = f"{_VOX}, {_mean_sql('vox', 'm1')}, {_mean_sql('m1', 'm2')}, {_mean_sql('m2', 'm3')}"


@query(f"WITH {_LEVELS} " + " UNION ALL ".join(f"SELECT vx, vy, vz, {k} AS scale, {_M.format('tsdf')} AS tsdf_1e6, weight FROM m{k}" for k in (1, 2, 3)))
def h05_propagate_up(spark, sf_dir):
    rows = pyramid.propagate(vox(spark, sf_dir), pyramid.mean, 3).filter("scale > 0")
    return _micros(rows, "tsdf")


@query(f"WITH {_VOX}, {_mean_sql('vox', 'm1')} SELECT vox.vx, vox.vy, vox.vz, {_M.format('coalesce(CASE WHEN vox.weight > 0 THEN vox.tsdf END, m1.tsdf)')} AS tsdf_1e6 FROM vox LEFT JOIN m1 ON m1.vx = vox.vx // 2 AND m1.vy = vox.vy // 2 AND m1.vz = vox.vz // 2")
def h05_propagate_down(spark, sf_dir):
    rows = vox(spark, sf_dir)
    own = rows.select("vx", "vy", "vz", F.when(F.col("weight") > 0, F.col("tsdf")).alias("tsdf"))
    return _micros(pyramid.down(pyramid.mean(rows), own, ["tsdf"]), "tsdf")


@query(f"WITH {_VOX} SELECT CAST(s AS INTEGER) AS scale, vx >> CAST(s AS INTEGER) AS vx, vy >> CAST(s AS INTEGER) AS vy, vz >> CAST(s AS INTEGER) AS vz, min(tsdf * weight) AS low, max(tsdf * weight) AS high, count(*) AS n FROM vox, range(4) r(s) WHERE weight > 0 GROUP BY 1, 2, 3, 4")
def h06_block_pyramid(spark, sf_dir):
    f = F.col("tsdf") * F.col("weight")
    return pyramid.rollup(vox(spark, sf_dir).filter("weight > 0"), 3, F.min(f).alias("low"), F.max(f).alias("high"), F.count("*").alias("n"))


@query(f"WITH {_VOX} SELECT CAST(s AS INTEGER) AS scale, vx >> CAST(s AS INTEGER) AS vx, vy >> CAST(s AS INTEGER) AS vy, vz >> CAST(s AS INTEGER) AS vz, max(tsdf * weight) AS high, count(*) FILTER (WHERE weight > 0) = any_value(1::BIGINT << CAST(3 * s AS INTEGER)) AS observed FROM vox, range(3, 10) r(s) GROUP BY 1, 2, 3, 4")
def h07_node_pyramid(spark, sf_dir):
    high = F.max(F.col("tsdf") * F.col("weight"))
    rows = pyramid.rollup(vox(spark, sf_dir), 9, high.alias("high"), F.count_if(F.col("weight") > 0).alias("seen")).filter("scale >= 3")
    full = F.col("seen") == F.pow(F.lit(8.0), F.col("scale"))
    return rows.select("scale", "vx", "vy", "vz", "high", full.alias("observed"))


@query(f"WITH {_VOX} SELECT vx // 2 AS vx, vy // 2 AS vy, vz // 2 AS vz, {_M.format('avg(tsdf)')} AS occupancy_1e6, {_M.format('(ceil(sum(weight)::DOUBLE) / count(*))')} AS weight_1e6 FROM vox WHERE weight > 0 GROUP BY 1, 2, 3")
def h09_ray_mean(spark, sf_dir):
    return _micros(pyramid.mean_of_rays(occ(spark, sf_dir)), "occupancy", "weight")


@query(f"WITH {_VOX}, l AS (SELECT vx // 2 AS vx, vy // 2 AS vy, vz // 2 AS vz, sum(weight) AS weight FROM vox GROUP BY 1, 2, 3), l2 AS (SELECT vx // 2 AS vx, vy // 2 AS vy, vz // 2 AS vz, sum(weight) AS weight FROM l GROUP BY 1, 2, 3) SELECT 1 AS scale, vx, vy, vz, CAST(weight AS BIGINT) AS weight FROM l UNION ALL SELECT 2, vx, vy, vz, CAST(weight AS BIGINT) FROM l2")
def h10_propagate_any(spark, sf_dir):
    step = lambda d: pyramid.parents(d).groupBy("vx", "vy", "vz").agg(F.sum("weight").alias("weight"))
    rows = vox(spark, sf_dir).select("vx", "vy", "vz", F.col("weight").cast("long").alias("weight"))
    return pyramid.propagate(rows, step, 2).filter("scale > 0").select("scale", "vx", "vy", "vz", "weight")


_CELL = f"""{_VOX}, co AS (SELECT CAST(vx - i AS INTEGER) AS vx, CAST(vy - j AS INTEGER) AS vy, CAST(vz - k AS INTEGER) AS vz, CAST(i + 2 * j + 4 * k AS INTEGER) AS corner, tsdf FROM vox, range(2) a(i), range(2) b(j), range(2) c(k) WHERE weight > 0),
ce AS (SELECT vx, vy, vz, count(*) AS n, CAST(sum(CASE WHEN tsdf < 0 THEN 1 << corner ELSE 0 END) AS INTEGER) AS index, {", ".join(f"max(CASE WHEN corner = {k} THEN tsdf END) AS t{k}" for k in range(8))} FROM co GROUP BY vx, vy, vz)"""


@query(f"WITH {_CELL} SELECT vx, vy, vz, CASE WHEN n = 8 THEN index ELSE 0 END AS index FROM ce")
def m01_cube_index(spark, sf_dir):
    return mesh.cube_index(vox(spark, sf_dir))


_TRI = ", ".join(f"({case}, {k}, {c}, {e}, {a}, {b})" for case in range(1, 255) for k, t in enumerate(mesh.triangles(case)) for c, e in enumerate(t) for a, b in (mesh.EDGES[e],))
_FACES = f"""{_CELL}, tr(index, face, corner, edge, a, b) AS (VALUES {_TRI}),
fe AS (SELECT vx, vy, vz, face, corner, edge, a, b, [t0, t1, t2, t3, t4, t5, t6, t7][a + 1] AS low, [t0, t1, t2, t3, t4, t5, t6, t7][b + 1] AS high FROM ce JOIN tr ON tr.index = ce.index WHERE n = 8),
fa AS (SELECT vx, vy, vz, face, corner, edge, a, b, {", ".join(f"v{c} + 0.5::DOUBLE + (a >> {k} & 1)::DOUBLE + ((b >> {k} & 1) - (a >> {k} & 1))::DOUBLE * (low / (low - high)) AS {c}" for k, c in enumerate("xyz"))} FROM fe)"""


@query(f"WITH {_FACES} SELECT vx, vy, vz, face, corner, edge, {', '.join(f'{_M.format(c)} AS {c}_1e6' for c in 'xyz')} FROM fa")
def m02_marching_cubes(spark, sf_dir):
    return _micros(mesh.marching_cubes(vox(spark, sf_dir)), "x", "y", "z")


_VID = "((((edge // 4)::BIGINT * 1048576 + vx + (a & 1)) * 1048576 + vy + (a >> 1 & 1)) * 1048576 + vz + (a >> 2 & 1))"


@query(f"WITH {_FACES} SELECT vertex, min(x) = max(x) OR max(x) - min(x) < 1e-9 AS one_place, count(*) AS faces FROM (SELECT *, {_VID} AS vertex FROM fa) GROUP BY vertex")
def m04_shared_vertices(spark, sf_dir):
    rows = mesh.edge_ids(mesh.marching_cubes(vox(spark, sf_dir)))
    return rows.groupBy("vertex").agg((F.max("x") - F.min("x") < 1e-9).alias("one_place"), F.count("*").alias("faces"))


_CROSS = ", ".join(f"(q{p} - p{p}) * (r{q_} - p{q_}) - (q{q_} - p{q_}) * (r{p} - p{p}) AS n{c}" for c, p, q_ in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")))
_UNIT = ", ".join(f"n{c} / sqrt(nx * nx + ny * ny + nz * nz) AS n{c}" for c in "xyz")


@query(f"""WITH {_FACES}, fv AS (SELECT *, {_VID} AS vertex FROM fa),
wh AS (SELECT vx, vy, vz, face, {", ".join(f"max(CASE WHEN corner = {k} THEN {c} END) AS {n}{c}" for k, n in enumerate("pqr") for c in "xyz")} FROM fa GROUP BY vx, vy, vz, face),
cr AS (SELECT vx, vy, vz, face, {_CROSS} FROM wh), un AS (SELECT vx, vy, vz, face, {_UNIT} FROM cr WHERE sqrt(nx * nx + ny * ny + nz * nz) > 0),
su AS (SELECT vertex, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM fv JOIN un USING (vx, vy, vz, face) GROUP BY vertex),
ve AS (SELECT vertex, {_UNIT} FROM su WHERE sqrt(nx * nx + ny * ny + nz * nz) > 0)
SELECT vertex, {", ".join(f"{_M.format(f'n{c}')} AS n{c}_1e6" for c in "xyz")} FROM ve""")
def m05_vertex_normals(spark, sf_dir):
    return _micros(mesh.vertex_normals(mesh.marching_cubes(vox(spark, sf_dir))), "nx", "ny", "nz")


@query("SELECT o_orderkey AS id, h AS half, o_orderkey * 4 AS v0, o_orderkey * 4 + 1 + h AS v1, o_orderkey * 4 + 2 + h AS v2 FROM orders, (SELECT CAST(range AS INTEGER) AS h FROM range(2))")
def m06_quads_to_triangles(spark, sf_dir):
    quads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(*[F.col("o_orderkey") * 4 + k for k in range(4)]).alias("corners"))
    return mesh.quads_to_triangles(quads)


_BOX = ", ".join(f"({k}, {c}, {v})" for k, f in enumerate(mesh.BOX_FACES) for c, v in enumerate(f))


@query(f"WITH {q.TREE}, f(face, corner, c) AS (VALUES {_BOX}), l AS (SELECT key, CAST(scale AS INTEGER) AS scale, {q.decode('code', 0)} AS x, {q.decode('code', 1)} AS y, {q.decode('code', 2)} AS z, 1 << CAST(scale AS INTEGER) AS s FROM t WHERE child_mask = 0) SELECT key, scale, face, corner, CAST(x + (c & 1) * s AS BIGINT) AS x, CAST(y + (c >> 1 & 1) * s AS BIGINT) AS y, CAST(z + (c >> 2 & 1) * s AS BIGINT) AS z FROM l, f")
def m07_structure_faces(spark, sf_dir):
    x, y, z = m.key_coord(F.col("key"))
    leaves = octree.leaves(fx.tree(spark, sf_dir)).select("key", "scale", x.alias("x"), y.alias("y"), z.alias("z"), m.octant_size(F.col("scale")).alias("size"))
    return mesh.structure(leaves)


@query(f"WITH {_PT} SELECT id, {', '.join(f'{_M.format(f'({c} * 0.05::DOUBLE + {t}::DOUBLE)')} AS {c}_1e6' for c, t in (('x', -6.4), ('y', -6.4), ('z', 0.5)))} FROM pt")
def m08_affine(spark, sf_dir):
    return _micros(mesh.affine(points(spark, sf_dir), 0.05, (-6.4, -6.4, 0.5)), "x", "y", "z")


#: The rotation of the quaternion (0.6, 0, 0.48, 0.64), by rows.
_TURN = ((-0.28, -0.768, 0.576), (0.768, 0.1808, 0.6144), (-0.576, 0.6144, 0.5392))
_TURNED = [f"(0.05::DOUBLE * ({a}::DOUBLE * x + {b}::DOUBLE * y + {c}::DOUBLE * z) + {t}::DOUBLE)" for (a, b, c), t in zip(_TURN, (-6.4, 2.0, 0.5), strict=True)]


@query(f"WITH {_PT} SELECT id, {', '.join(f'{_M.format(v)} AS {c}_1e6' for c, v in zip('xyz', _TURNED, strict=True))} FROM pt")
def m08_turned(spark, sf_dir):
    pose = rigid.pose_matrix((-6.4, 2.0, 0.5), (1.2, 0.0, 0.96, 1.28), 0.05)
    return _micros(mesh.placed(points(spark, sf_dir), pose), "x", "y", "z")
