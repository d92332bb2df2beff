"""Queries over maps of rays at all scales."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.sensors import HYSTERESIS, SCALE_STEPS, Lidar
from ..operators import fusion, ray_map
from ..streaming.store import BlockStore
from . import fixtures as fx
from .files import folder
from .fusion import _CELLS, _INSIDE, _ISM, _LIMIT, _MICRO, MAP, micro
from .registry import query

BATCHES = 3
#: So wide a beam that a few metres take all scales.
HOW = ray_map.RayMap(vmap=MAP, lidar=Lidar.leica(3.5, 3.5))
_PER = math.radians(3.5) / MAP.res


def scans(spark, sf_dir):
    """Rays in three batches, between which the sensor moves."""
    rows = fx.rays(spark, sf_dir).withColumn("batch", F.col("scan") % BATCHES)
    return rows.withColumns({"tx": (F.col("batch") - 1) * F.lit(1.5), "ty": F.lit(0.0), "tz": F.lit(0.0)})


def _ladder(d: str) -> str:
    return "CASE " + " ".join(f"WHEN {d} * {_PER!r}::DOUBLE >= {s!r} THEN {k}" for k, s in reversed(list(enumerate(SCALE_STEPS, 1)))) + " ELSE 0 END"


def _ask(d: str) -> str:
    now = f"({_ladder(d)})"
    return f"CASE WHEN last IS NULL OR {now} = last THEN {now} ELSE {_ladder(f'({d} + CASE WHEN {now} > last THEN -{HYSTERESIS!r}::DOUBLE ELSE {HYSTERESIS!r}::DOUBLE END)')} END"


_LIMITS = (_LIMIT.format(*(repr(v) for v in (6.0 * 0.05, 0.026, 16.0 * 0.05))), _LIMIT.format(*(repr(v) for v in (1.5 * 0.05, 0.052, 6.0 * 0.05))))
_MOVED = lambda text: text.replace("x / n * d", "x / n * d + tx")
_SIDE = -(-MAP.size // 8)
_NUMBER = lambda x, y, z: f"(({z}) * {MAP.size} + ({y})) * {MAP.size} + ({x})"
_CORNER = lambda step: _NUMBER(*(f"v{c} // {step} * {step}" for c in "xyz"))
_AWAY = " + ".join(f"pow((v{c} // 8 * 8 + 4.0::DOUBLE) * 0.05::DOUBLE - 6.4::DOUBLE - {t}, 2)" for c, t in zip("xyz", ("tx", "0", "0"), strict=True))
_COORD = f"v % {MAP.size} AS vx, v // {MAP.size} % {MAP.size} AS vy, v // {MAP.size**2} AS vz"


def _sql() -> str:
    """Batch after batch: the blocks' scales, the state brought to them, and the fold of the new values over it."""
    out = [f"""WITH {fx.RAYS}, l AS (SELECT *, scan % {BATCHES} AS batch, (scan % {BATCHES} - 1) * 1.5::DOUBLE AS tx, sqrt(x * x + y * y + z * z) AS n FROM ry),
m AS (SELECT *, {_LIMITS[0]} AS t, 3.0::DOUBLE * {_LIMITS[1]} AS s FROM l WHERE n >= 0.1),
k AS (SELECT *, unnest(generate_series(0, CAST(ceil((least(n + t, 10.0::DOUBLE) - 0.1::DOUBLE) / 0.025::DOUBLE) AS BIGINT) - 1)) AS k FROM m),
g AS (SELECT *, 0.1::DOUBLE + k * 0.025::DOUBLE AS d FROM k),
c AS (SELECT batch, scan, seq, k, t, s, tx, d - n AS x, {_MOVED(_CELLS)} FROM g WHERE {_MOVED(_INSIDE)}),
e AS (SELECT *, {", ".join(f"k % {1 << s} = 0 AND (vx, vy, vz) IS DISTINCT FROM lag((vx, vy, vz), {1 << s}) OVER w AS f{s}" for s in range(4))} FROM c WINDOW w AS (PARTITION BY scan, seq ORDER BY k)),
u AS (SELECT batch, scan, seq, k, vx, vy, vz, f0, f1, f2, f3, x < -s AS free, least({_ISM}, 5.015::DOUBLE) AS value, (vz // 8 * {_SIDE} + vy // 8) * {_SIDE} + vx // 8 AS b, sqrt({_AWAY}) AS away
      FROM e WHERE x < t AND (f0 OR f1 OR f2 OR f3)),
st0 AS (SELECT 0::BIGINT AS b, 0 AS scale, 0::BIGINT AS v, 0.0::DOUBLE AS m0, 0::BIGINT AS w0 WHERE false)"""]
    for i in range(1, BATCHES + 1):
        p, old = i - 1, f"st{i - 1}"
        out.append(f"""
t{i} AS (SELECT u.b, any_value(o.last) AS last, min(away) FILTER (free) AS near, min(away) FILTER (NOT free) AS surface FROM u LEFT JOIN (SELECT b, any_value(scale) AS last FROM {old} GROUP BY b) o ON o.b = u.b WHERE batch = {p} GROUP BY u.b),
w{i} AS MATERIALIZED (SELECT b, last, least({_ask('surface')}, greatest({_ask('near')}, 1)) AS scale FROM (SELECT b, last, coalesce(near, 1e9::DOUBLE) AS near, coalesce(surface, 1e9::DOUBLE) AS surface, near IS NULL AS n1, surface IS NULL AS n2 FROM t{i})),
o{i} AS (SELECT w.b, w.last, w.scale, v, m0, w0, {_COORD} FROM {old} s JOIN w{i} w ON w.b = s.b),
a{i} AS (SELECT b, last + 1 AS last, scale, {_NUMBER(*(f"v{c} // (2 << last) * (2 << last)" for c in "xyz"))} AS v, avg(m0) AS m0, CAST(ceil(avg(w0)) AS BIGINT) AS w0 FROM o{i} WHERE scale > last GROUP BY 1, 2, 3, 4),
b{i} AS (SELECT b, last + 1 AS last, scale, {_NUMBER(*(f"v{c} // (2 << last) * (2 << last)" for c in "xyz"))} AS v, avg(m0) AS m0, CAST(ceil(avg(w0)) AS BIGINT) AS w0 FROM (SELECT *, {_COORD} FROM a{i}) WHERE scale > last GROUP BY 1, 2, 3, 4),
c{i} AS (SELECT b, last + 1 AS last, scale, {_NUMBER(*(f"v{c} // (2 << last) * (2 << last)" for c in "xyz"))} AS v, avg(m0) AS m0, CAST(ceil(avg(w0)) AS BIGINT) AS w0 FROM (SELECT *, {_COORD} FROM b{i}) WHERE scale > last GROUP BY 1, 2, 3, 4),
d{i} AS (SELECT b, scale, {_NUMBER("vx + x * (1 << scale)", "vy + y * (1 << scale)", "vz + z * (1 << scale)")} AS v, m0, w0 FROM o{i}, range(8) p(x), range(8) q(y), range(8) r(z) WHERE scale <= last AND x < (1 << (last - scale)) AND y < (1 << (last - scale)) AND z < (1 << (last - scale))),
r{i} AS (SELECT b, scale, v, m0, w0 FROM d{i} UNION ALL SELECT b, scale, v, m0, w0 FROM (SELECT * FROM a{i} UNION ALL SELECT * FROM b{i} UNION ALL SELECT * FROM c{i}) WHERE scale = last),
n{i} AS (SELECT u.b, w.scale, CASE w.scale WHEN 0 THEN {_CORNER(1)} WHEN 1 THEN {_CORNER(2)} WHEN 2 THEN {_CORNER(4)} ELSE {_CORNER(8)} END AS v, scan, seq, k, value FROM u JOIN w{i} w ON w.b = u.b WHERE batch = {p} AND CASE w.scale WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END),
x{i} AS (SELECT b, scale, v, value, row_number() OVER (PARTITION BY v ORDER BY scan, seq, k) AS i, count(*) OVER (PARTITION BY v) AS n FROM n{i}),
y{i} AS (SELECT coalesce(x.b, r.b) AS b, coalesce(x.scale, r.scale) AS scale, coalesce(x.v, r.v) AS v, value, i, coalesce(n, 0) AS n, coalesce(m0, 0) AS m0, coalesce(w0, 0) AS w0 FROM x{i} x FULL JOIN r{i} r ON r.v = x.v),
z{i} AS (SELECT any_value(b) AS b, any_value(scale) AS scale, v, coalesce(sum(value * pow(0.95::DOUBLE, greatest(w0 + n - greatest(w0 + i, 20), 0)) / least(w0 + n, 20)), 0) + any_value(w0 * m0 * pow(0.95::DOUBLE, greatest(w0 + n - 20, 0)) / least(w0 + n, 20)) AS m0, least(any_value(w0 + n), 20) AS w0 FROM y{i} GROUP BY v),
st{i} AS MATERIALIZED (SELECT * FROM z{i} UNION ALL SELECT * FROM {old} WHERE b NOT IN (SELECT b FROM w{i}))""")
    return ",".join(out)


_FUSED = _sql()


def fused(spark, sf_dir):
    """The map after all batches, each of which writes the blocks that it changes."""
    store, at = BlockStore(folder(spark), ray_map.STATE), folder(spark, "rays")
    # As in a stream, rays have been written by batches.
    scans(spark, sf_dir).write.partitionBy("batch").parquet(at)
    rows = spark.read.parquet(at)
    for i in range(BATCHES):
        store.write(ray_map.changes(store.read(spark, i - 1), rows.filter(F.col("batch") == i), HOW), i)
    return store.read(spark, BATCHES - 1)


@query(f"""{_FUSED} SELECT CAST(scale AS INTEGER) AS scale, CAST(v % {MAP.size} AS INTEGER) AS vx, CAST(v // {MAP.size} % {MAP.size} AS INTEGER) AS vy, CAST(v // {MAP.size**2} AS INTEGER) AS vz, {_MICRO.format("m0")} AS occupancy_1e6, CAST(w0 AS INTEGER) AS weight FROM st{BATCHES}""")
def f09_ray_scales(spark, sf_dir):
    """Batches of rays fused into blocks at scales of their own."""
    out = fused(spark, sf_dir)
    return out.select("scale", *fusion.voxel_of(F.col("v"), MAP), micro(F.col("occupancy")).alias("occupancy_1e6"), "weight")


@query(f"""{_FUSED}, h AS (SELECT v, scale, m0 * w0 AS held, {_COORD} FROM st{BATCHES}),
lv AS (SELECT s AS scale, {_NUMBER(*(f"v{c} // (1::BIGINT << s) * (1::BIGINT << s)" for c in "xyz"))} AS v, min(held) AS low, max(held) AS high, sum(1::BIGINT << (3 * scale)) = 1::BIGINT << (3 * s) AS observed FROM h, (SELECT CAST(range AS INTEGER) AS s FROM range(1, {MAP.size.bit_length()})) WHERE s > scale GROUP BY s, 2)
SELECT scale, CAST(v AS BIGINT) AS v, {_MICRO.format("low")} AS low_1e6, {_MICRO.format("high")} AS high_1e6, observed FROM lv""")
def f12_ray_levels(spark, sf_dir):
    """The octants above that map's voxels, with the bounds of what is below."""
    out = ray_map.levels(fused(spark, sf_dir), HOW)
    return out.select("scale", "v", micro(F.col("low")).alias("low_1e6"), micro(F.col("high")).alias("high_1e6"), "observed")
