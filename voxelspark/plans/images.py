"""Queries over depth images and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour
from ..operators import images, keysets
from . import fixtures as fx
from .fusion import CAMERA, depth, micro
from .registry import query, table

_PX = f"WITH {fx.PIXELS}, d AS (SELECT frame, x, y, CASE WHEN depth_mm < 100 THEN 0.0::DOUBLE ELSE depth_mm / 1000.0::DOUBLE END AS depth FROM px)"
_M = "CAST(floor({} * 1000000 + 0.37::DOUBLE) AS BIGINT)"


def _depth(spark, sf_dir):
    d = depth(spark, sf_dir)
    return d.withColumn("depth", F.when(F.col("depth") < 0.1, F.lit(0.0)).otherwise(F.col("depth")))


def _micros(df, *names):
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, *[micro(F.col(c)).alias(f"{c}_1e6") for c in names])


@query(f"""{_PX}, t AS (SELECT frame, x // 2 AS tx, y // 2 AS ty, depth, x + y * 8 AS idx FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, tx, ty ORDER BY depth, idx) AS n, count(*) OVER (PARTITION BY frame, tx, ty) AS c FROM t WHERE depth >= 1e-5),
f AS (SELECT frame, tx, ty, min(idx) AS first FROM t GROUP BY ALL)
SELECT f.frame, CAST(f.tx AS INTEGER) AS x, CAST(f.ty AS INTEGER) AS y, coalesce(r.depth, 0.0::DOUBLE) AS depth, CAST(coalesce(r.idx, first) AS INTEGER) AS idx FROM f LEFT JOIN r ON r.frame = f.frame AND r.tx = f.tx AND r.ty = f.ty AND r.n = c // 2 + 1""")
def i01_median_downsample(spark, sf_dir):
    return images.downsample(_depth(spark, sf_dir), 8, 2)


@query(f"{_PX}, p AS (SELECT frame, x, y, (x * 3 + y * 5 + frame) % 64 AS idx FROM d), i AS (SELECT frame, x + y * 8 AS idx, depth FROM d) SELECT p.frame, p.x, p.y, i.depth AS value FROM p JOIN i ON i.frame = p.frame AND i.idx = p.idx")
def i02_remap(spark, sf_dir):
    d = _depth(spark, sf_dir)
    image = d.select("frame", (F.col("x") + F.col("y") * 8).cast("long").alias("idx"), F.col("depth").alias("value"))
    return images.remap(image, d.select("frame", "x", "y", ((F.col("x") * 3 + F.col("y") * 5 + F.col("frame")) % 64).alias("idx")))


@query(f"""{_PX}, h AS (SELECT frame, x AS hx, y AS hy, depth AS head, greatest(0, least(x + i, 7)) AS x, greatest(0, least(y + j, 7)) AS y FROM d, range(0, 2) a(i), range(0, 2) b(j) WHERE x % 2 = 0 AND y % 2 = 0)
SELECT h.frame, CAST(hx // 2 AS INTEGER) AS x, CAST(hy // 2 AS INTEGER) AS y, {_M.format("avg(d.depth)")} AS depth_1e6 FROM h JOIN d ON d.frame = h.frame AND d.x = h.x AND d.y = h.y WHERE abs(d.depth - head) < 0.3 GROUP BY 1, 2, 3""")
def i03_half_sample(spark, sf_dir):
    return _micros(images.half_sample(_depth(spark, sf_dir), 8, 8, 0.3), "depth")


_CLOUD = f"{_PX}, p AS (SELECT *, CASE WHEN depth > 0 THEN depth * ((x - 3.5::DOUBLE) / 8.0::DOUBLE) ELSE 0.0 END AS px, CASE WHEN depth > 0 THEN depth * ((y - 3.5::DOUBLE) / 8.0::DOUBLE) ELSE 0.0 END AS py, depth AS pz FROM d)"


@query(f"{_CLOUD} SELECT frame, x, y, {_M.format('px')} AS px_1e6, {_M.format('py')} AS py_1e6, {_M.format('pz')} AS pz_1e6 FROM p")
def i04_point_cloud(spark, sf_dir):
    return _micros(images.point_cloud(_depth(spark, sf_dir), CAMERA).drop("depth"), "px", "py", "pz")


@query(f"{_CLOUD} SELECT frame, x, y, {_M.format('(pz + 0.25::DOUBLE)')} AS depth_1e6 FROM p")
def i05_cloud_to_depth(spark, sf_dir):
    return _micros(images.cloud_to_depth(images.point_cloud(_depth(spark, sf_dir), CAMERA), (0.0, 0.0, 0.25)), "depth")


@query(f"""{_CLOUD}, n AS (SELECT p.*, {", ".join(f"coalesce({f}({c}) OVER {w}, {c}) AS {k}{c}" for k, f, w in (("l", "lag", "a"), ("r", "lead", "a"), ("u", "lag", "b"), ("d", "lead", "b")) for c in ("px", "py", "pz"))}
FROM p WINDOW a AS (PARTITION BY frame, y ORDER BY x), b AS (PARTITION BY frame, x ORDER BY y)),
v AS (SELECT *, rpx - lpx AS ax, rpy - lpy AS ay, rpz - lpz AS az, dpx - upx AS bx, dpy - upy AS by_, dpz - upz AS bz FROM n),
c AS (SELECT *, by_ * az - bz * ay AS cx, bz * ax - bx * az AS cy, bx * ay - by_ * ax AS cz FROM v),
g AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS n, least(pz, lpz, rpz, upz, dpz) > 0 AS good FROM c)
SELECT frame, x, y, {", ".join(f"CASE WHEN good AND n > 0 THEN {_M.format(f'(c{k} / n)')} END AS n{k}_1e6" for k in "xyz")} FROM g""")
def i06_normals(spark, sf_dir):
    return _micros(images.normals(images.point_cloud(_depth(spark, sf_dir), CAMERA)), "nx", "ny", "nz")


@query(f"{_PX} SELECT frame, x, y, CASE WHEN depth <= 0 THEN 0 ELSE {_M.format('greatest(0.005::DOUBLE, least(0.05::DOUBLE * (depth * depth), 0.1::DOUBLE))')} END AS sigma_1e6 FROM d")
def i07_depth_sigma(spark, sf_dir):
    return _depth(spark, sf_dir).select("frame", "x", "y", micro(images.depth_sigma(F.col("depth"), 0.05, 0.005, 0.1, quadratic=True)).alias("sigma_1e6"))


@query(f"""{_PX}, s AS (SELECT frame, CAST(x + i AS INTEGER) AS x, CAST(y + j AS INTEGER) AS y, CASE WHEN depth >= 1e-5 THEN depth END AS g FROM d, range(-2, 3) a(i), range(-2, 3) b(j))
SELECT frame, x, y, min(g) AS low, max(g) AS high, CAST(count(g) AS INTEGER) AS known, NOT (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5) AS crossing FROM s WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY frame, x, y""")
def i08_pooling_level(spark, sf_dir):
    return images.pool(_depth(spark, sf_dir), 8, 8, 2)


@query(f"""{_PX}, b AS (SELECT event_id AS id, event_id % 500 AS frame, CAST(event_id % 11 AS INTEGER) - 2 AS x0, CAST(event_id % 7 AS INTEGER) - 1 AS y0, CAST(event_id % 11 + event_id % 5 AS INTEGER) - 2 AS x1, CAST(event_id % 7 + event_id % 3 AS INTEGER) - 1 AS y1 FROM events)
SELECT b.id, NOT (x0 >= 0 AND y0 >= 0 AND x1 < 8 AND y1 < 8) AS crossing, min(CASE WHEN depth >= 1e-5 THEN depth END) AS low, max(CASE WHEN depth >= 1e-5 THEN depth END) AS high, CAST(count(CASE WHEN depth >= 1e-5 THEN 1 END) AS INTEGER) AS known, CAST(count(CASE WHEN depth < 1e-5 THEN 1 END) AS INTEGER) AS unknown
FROM b LEFT JOIN d ON d.frame = b.frame AND d.x BETWEEN x0 AND x1 AND d.y BETWEEN y0 AND y1 GROUP BY ALL""")
def i09_pool_boxes(spark, sf_dir):
    e = F.col("event_id")
    box = {"x0": (e % 11).cast("int") - 2, "y0": (e % 7).cast("int") - 1, "x1": (e % 11 + e % 5).cast("int") - 2, "y1": (e % 7 + e % 3).cast("int") - 1}
    boxes = table(spark, sf_dir, "events").select(e.alias("id"), (e % 500).alias("frame"), *[v.alias(k) for k, v in box.items()])
    return images.pool_boxes(boxes, _depth(spark, sf_dir), 8, 8)


def _cut(x: str) -> str:
    return f"CAST(greatest(0, least(255, floor({x}))) AS INTEGER)"


_RAMP = ("255.0::DOUBLE * (2.0::DOUBLE * t - 1)", "255.0::DOUBLE * (1.0::DOUBLE - abs(2.0::DOUBLE * t - 1))", "255.0::DOUBLE * (1.0::DOUBLE - 2.0::DOUBLE * t)")


@query(f"{_PX}, t AS (SELECT *, (depth - 0.2::DOUBLE) / 0.8::DOUBLE AS t FROM d) SELECT frame, x, y, {', '.join(f'CASE WHEN depth <= 0 THEN 0 WHEN depth < 0.2::DOUBLE THEN 64 WHEN depth > 1.0::DOUBLE THEN 255 ELSE {_cut(r)} END AS {c}' for c, r in zip('rgb', _RAMP, strict=True))} FROM t")
def i10_depth_colours(spark, sf_dir):
    rgb = colour.of_depth(F.col("depth"), 0.2, 1.0)
    return _depth(spark, sf_dir).select("frame", "x", "y", *[v.alias(c) for c, v in zip("rgb", rgb, strict=True)])


def _rgb(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", *[((e * k + j) % 256).cast("int").alias(c) for j, (c, k) in enumerate((("r", 7), ("g", 11), ("b", 13)))])


_RGB = "WITH c AS (SELECT event_id, CAST(event_id * 7 % 256 AS INTEGER) AS r, CAST((event_id * 11 + 1) % 256 AS INTEGER) AS g, CAST((event_id * 13 + 2) % 256 AS INTEGER) AS b FROM events)"
def _c():
    return F.col("r"), F.col("g"), F.col("b")


@query(f"{_RGB} SELECT event_id, (r + g) % 256 AS sum_r, {_cut('g * 0.5::DOUBLE')} AS half_g, {_cut('0.25::DOUBLE * b + 0.75::DOUBLE * r')} AS mixed_b, r::BIGINT + g * 256 + b * 65536 + 4278190080 AS packed, r AS back FROM c")
def i11_rgb_arithmetic(spark, sf_dir):
    turned = (F.col("g"), F.col("b"), F.col("r"))
    packed = colour.pack(_c())
    return _rgb(spark, sf_dir).select("event_id", colour.add(_c(), turned)[0].alias("sum_r"), colour.scaled(_c(), 0.5)[1].alias("half_g"), colour.blend(_c(), turned, 0.25)[2].alias("mixed_b"), packed.alias("packed"), colour.unpack(packed)[0].alias("back"))


@query(f"{_RGB} SELECT event_id, row_number() OVER (ORDER BY r, g, b, event_id) AS rank FROM c")
def i11_rgb_order(spark, sf_dir):
    return keysets.ranked(_rgb(spark, sf_dir), F.asc("r"), F.asc("g"), F.asc("b"), F.asc("event_id")).select("event_id", "rank")


_PAL = " ".join(f"WHEN {k} THEN {{}}" for k in range(len(colour.SCALE_COLOURS)))


@query("SELECT event_id, " + ", ".join(f"CASE greatest(0, least(event_id % 10 - 1, 7)) {_PAL.format(*[c[j] for c in colour.SCALE_COLOURS])} END AS {n}" for j, n in enumerate("rgb")) + " FROM events")
def i10_scale_colours(spark, sf_dir):
    rgb = colour.of_scale((F.col("event_id") % 10 - 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", *[v.alias(c) for c, v in zip("rgb", rgb, strict=True)])


@query(f"{_PX} SELECT frame, x, y, {_M.format('(depth / sqrt(1.0::DOUBLE + ((x - 3.5::DOUBLE) / 8.0::DOUBLE) * ((x - 3.5::DOUBLE) / 8.0::DOUBLE) + ((y - 3.5::DOUBLE) / 8.0::DOUBLE) * ((y - 3.5::DOUBLE) / 8.0::DOUBLE)))')} AS z_1e6 FROM d")
def r10_ray_to_z(spark, sf_dir):
    return _depth(spark, sf_dir).select("frame", "x", "y", micro(images.ray_to_z(F.col("depth"), CAMERA, F.col("x"), F.col("y"))).alias("z_1e6"))


@query("WITH s AS (SELECT event_id // 256 AS scan, event_id % 256 AS idx, user_id AS value FROM events) SELECT scan, CAST((idx // 4 + [0, 6, 12, 18][idx % 4 + 1]) % 64 AS INTEGER) AS x, CAST(idx % 4 AS INTEGER) AS y, value FROM s")
def r11_destagger(spark, sf_dir):
    e = F.col("event_id")
    scans = table(spark, sf_dir, "events").select(F.floor(e / 256).alias("scan"), (e % 256).alias("idx"), F.col("user_id").alias("value"))
    return images.destagger(scans, 64, (0, 6, 12, 18))


@query(f"{_PX} SELECT frame, x, y, CAST(greatest(0, least(65535, round(depth * 1000))) AS INTEGER) AS mm FROM d")
def w07_depth_millimetres(spark, sf_dir):
    return _depth(spark, sf_dir).select("frame", "x", "y", images.to_millimetres(F.col("depth")).alias("mm"))


@query(f"{_RGB}, n AS (SELECT *, sqrt(r * r + g * g + b * b + 1.0::DOUBLE) AS n FROM c), l AS (SELECT *, greatest(r / n * 0.5::DOUBLE + g / n * 0.25::DOUBLE + b / n * 0.75::DOUBLE, 0.0::DOUBLE) AS a FROM n) SELECT event_id, {_cut('(0.1::DOUBLE + a) * r')} AS r, {_cut('(0.1::DOUBLE + a) * g')} AS g, {_cut('(0.1::DOUBLE + a) * b')} AS b FROM l")
def c07_render(spark, sf_dir):
    n = F.sqrt(F.col("r") * F.col("r") + F.col("g") * F.col("g") + F.col("b") * F.col("b") + F.lit(1.0))
    rgb = colour.shade(tuple(c / n for c in _c()), (0.5, 0.25, 0.75), (0.1, 0.1, 0.1), _c())
    return _rgb(spark, sf_dir).select("event_id", *[v.alias(c) for c, v in zip("rgb", rgb, strict=True)])
