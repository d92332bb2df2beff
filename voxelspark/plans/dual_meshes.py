"""Queries over meshes across scales (M03, M04), on a ball for each supplier whose blocks have different scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dual_mesh, mesh
from .fusion import _MICRO, micro
from .registry import query, table

#: Blocks along an edge of a ball's box, and balls along a row of boxes.
EDGE, ROW = 3, 64


def balls(spark, sf_dir):
    """Voxels (scale, vx, vy, vz, value) of a ball for each supplier: distances at middles; blocks of 8 take scales 0 to 3 in turn."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 3).alias("n"))
    # The table is one small file, so its rows are dealt out before each becomes thousands.
    s = s.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    rows = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(EDGE**3 - 1)))).withColumns({"bx": F.col("i") % EDGE, "by": F.floor(F.col("i") / EDGE) % EDGE, "bz": F.floor(F.col("i") / EDGE**2)})
    rows = rows.withColumn("scale", ((F.col("bx") + 2 * F.col("by") + 3 * F.col("bz") + F.col("k")) % 4).cast("int"))
    rows = rows.withColumn("m", F.call_function("shiftright", F.lit(8), F.col("scale"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") * F.col("m") * F.col("m") - 1)))
    step = F.call_function("shiftleft", F.lit(1), F.col("scale"))
    own = {"x": F.col("j") % F.col("m"), "y": F.floor(F.col("j") / F.col("m")) % F.col("m"), "z": F.floor(F.col("j") / (F.col("m") * F.col("m")))}
    at = {c: F.col(f"b{c}") * 8 + own[c] * step for c in "xyz"}
    away = [(at[c] + step / F.lit(2.0) - F.lit(d)) for c, d in zip("xyz", (12.1, 11.7, 12.3), strict=True)]
    value = F.sqrt(away[0] * away[0] + away[1] * away[1] + away[2] * away[2]) - (F.col("n") + F.lit(6.3))
    shift = {"x": F.col("k") % ROW * 8 * EDGE, "y": F.floor(F.col("k") / ROW) % ROW * 8 * EDGE, "z": F.floor(F.col("k") / ROW**2) * 8 * EDGE}
    return rows.select("scale", *[(at[c] + shift[c]).cast("int").alias(f"v{c}") for c in "xyz"], value.alias("value"))


_NEXT = {"x": f"k % {ROW} * {8 * EDGE}", "y": f"k // {ROW} % {ROW} * {8 * EDGE}", "z": f"k // {ROW**2} * {8 * EDGE}"}
_BALLS = f"""bl AS (SELECT s_suppkey AS k, s_nationkey % 3 AS n, x.i AS bx, y.i AS by_, z.i AS bz, CAST((x.i + 2 * y.i + 3 * z.i + s_suppkey) % 4 AS INTEGER) AS scale FROM supplier, range({EDGE}) x(i), range({EDGE}) y(i), range({EDGE}) z(i)),
lf AS (SELECT k, n, scale, 1 << scale AS size, bx * 8 + (x.i << scale) AS lx, by_ * 8 + (y.i << scale) AS ly, bz * 8 + (z.i << scale) AS lz FROM bl, range(8) x(i), range(8) y(i), range(8) z(i) WHERE greatest(x.i, y.i, z.i) < (8 >> scale)),
vx AS (SELECT scale, size, lx + {_NEXT['x']} AS vx, ly + {_NEXT['y']} AS vy, lz + {_NEXT['z']} AS vz,
       sqrt((lx + size / 2.0::DOUBLE - 12.1::DOUBLE) * (lx + size / 2.0::DOUBLE - 12.1::DOUBLE) + (ly + size / 2.0::DOUBLE - 11.7::DOUBLE) * (ly + size / 2.0::DOUBLE - 11.7::DOUBLE) + (lz + size / 2.0::DOUBLE - 12.3::DOUBLE) * (lz + size / 2.0::DOUBLE - 12.3::DOUBLE)) - (n + 6.3::DOUBLE) AS value FROM lf),
lv AS (SELECT ((vz * {1 << dual_mesh.BITS} + vy) * {1 << dual_mesh.BITS} + vx) * 4 + scale AS leaf, * FROM vx),
un AS (SELECT leaf, value, size, vx, vy, vz, vx + x.i AS ux, vy + y.i AS uy, vz + z.i AS uz FROM lv, range(8) x(i), range(8) y(i), range(8) z(i) WHERE greatest(x.i, y.i, z.i) < size),
pt AS (SELECT DISTINCT vx + x.i * size AS px, vy + y.i * size AS py, vz + z.i * size AS pz FROM lv, range(2) x(i), range(2) y(i), range(2) z(i)),
oc AS (SELECT px, py, pz, o.o, leaf, value, vx + size / 2.0::DOUBLE AS cx, vy + size / 2.0::DOUBLE AS cy, vz + size / 2.0::DOUBLE AS cz
       FROM (SELECT *, px - 1 + (o & 1) AS wx, py - 1 + (o >> 1 & 1) AS wy, pz - 1 + (o >> 2 & 1) AS wz FROM pt, range(8) r(o)) o JOIN un ON ux = wx AND uy = wy AND uz = wz),
cl AS (SELECT px, py, pz, CAST(sum(CASE WHEN value < 0 THEN 1 << o ELSE 0 END) AS INTEGER) AS index FROM oc GROUP BY ALL HAVING count(*) = 8)"""
_TRI = ", ".join(f"({case}, {k}, {c}, {a}, {b})" for case in range(1, 255) for k, t in enumerate(mesh.triangles(case)) for c, e in enumerate(t) for a, b in (mesh.EDGES[e],))
_FACES = f"""{_BALLS}, tr(index, face, corner, a, b) AS (VALUES {_TRI}),
fv AS (SELECT c.px, c.py, c.pz, face, corner, least(p.leaf, q.leaf) AS low, greatest(p.leaf, q.leaf) AS high FROM cl c JOIN tr ON tr.index = c.index JOIN oc p ON p.px = c.px AND p.py = c.py AND p.pz = c.pz AND p.o = a JOIN oc q ON q.px = c.px AND q.py = c.py AND q.pz = c.pz AND q.o = b),
fa AS (SELECT px, py, pz, face, {", ".join(f"max(low) FILTER (corner = {k}) AS {n}_low, max(high) FILTER (corner = {k}) AS {n}_high" for k, n in enumerate("abc"))} FROM fv GROUP BY ALL)"""
_REAL = " AND ".join(f"({m}_low, {m}_high) <> ({n}_low, {n}_high)" for m, n in ("ab", "bc", "ac"))


@query(f"WITH {_BALLS} SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, CAST(pz AS INTEGER) AS pz, index FROM cl")
def m03_dual_cells(spark, sf_dir):
    return dual_mesh.cell_indices(balls(spark, sf_dir))


@query(f"WITH {_FACES} SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, CAST(pz AS INTEGER) AS pz, face, a_low, a_high, b_low, b_high, c_low, c_high FROM fa WHERE {_REAL}")
def m03_dual_mesh(spark, sf_dir):
    """Triangles across scales, by the voxels that their vertices lie between."""
    faces = dual_mesh.dual_mesh(balls(spark, sf_dir))
    return faces.select("px", "py", "pz", "face", *[F.col(f"{n}.{e}").alias(f"{n}_{e}") for n in "abc" for e in ("low", "high")])


_CROSS = f"""{_BALLS}, ed(a, b) AS (VALUES {", ".join(f"({a}, {b})" for a, b in mesh.EDGES)}),
ve AS (SELECT DISTINCT p.leaf AS p, q.leaf AS q FROM cl c, ed JOIN oc p ON p.px = c.px AND p.py = c.py AND p.pz = c.pz AND p.o = a JOIN oc q ON q.px = c.px AND q.py = c.py AND q.pz = c.pz AND q.o = b WHERE (p.value < 0) <> (q.value < 0)),
pr AS (SELECT DISTINCT least(p, q) AS low, greatest(p, q) AS high FROM ve),
vt AS (SELECT low, high, l.value / (l.value - h.value) AS t, {", ".join(f"l.v{c} + l.size / 2.0::DOUBLE AS l{c}, h.v{c} + h.size / 2.0::DOUBLE AS h{c}" for c in "xyz")} FROM pr JOIN lv l ON l.leaf = low JOIN lv h ON h.leaf = high)"""


@query(f"WITH {_CROSS} SELECT low, high, {', '.join(_MICRO.format(f'(l{c} + (h{c} - l{c}) * t)') + f' AS {c}_1e6' for c in 'xyz')} FROM vt")
def m04_vertices_across_scales(spark, sf_dir):
    """Every pair of voxels between which the surface passes, once, and where."""
    rows = dual_mesh.vertices(dual_mesh.dual_mesh(balls(spark, sf_dir)))
    return rows.select("low", "high", *[micro(F.col(c)).alias(f"{c}_1e6") for c in "xyz"])
