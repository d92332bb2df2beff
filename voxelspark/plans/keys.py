"""Queries over Morton keys, key sets, octree scans and allocation (K, S, T, A, Q12, M07, H08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morton as m
from ..operators import keysets, octree
from . import fixtures as fx
from . import sql as q
from .registry import query

ID = ["l_orderkey", "l_linenumber"]


def _ids(spark, sf_dir, *cols):
    return fx.keys(spark, sf_dir).select(*ID, *cols)


def _sql(*cols: str) -> str:
    return f"WITH {q.KEYS} SELECT l_orderkey, l_linenumber, {', '.join(cols)} FROM k"


# Of every fifth key one bit is set that its scale can't have, so that both answers occur.
_ODD = "(CASE WHEN l_orderkey % 5 = 0 THEN key | 32 ELSE key END)"


@query(_sql(f"{_ODD} AS tested", f"((({_ODD} >> 5) & ((1::BIGINT << CAST(3 * ({_ODD} & 31) AS INTEGER)) - 1)) = 0) AS valid"))
def k01_valid_key(spark, sf_dir):
    odd = F.when(F.col("l_orderkey") % 5 == 0, F.col("key").bitwiseOR(F.lit(32))).otherwise(F.col("key"))
    return _ids(spark, sf_dir, odd.alias("tested")).withColumn("valid", m.is_valid_key(F.col("tested")))


@query(_sql("(x * 4096 >= 0 AND x * 4096 < 524288 AND y - 9 >= 0 AND y - 9 < 524288 AND z >= 0) AS valid"))
def k02_valid_coord(spark, sf_dir):
    return _ids(spark, sf_dir, m.is_valid_coord(F.col("x") * 4096, F.col("y") - 9, F.col("z")).alias("valid"))


@query(_sql("(" + " | ".join(f"(((x * 1023 + y) >> {k} & 1) << {3 * k})" for k in range(19)) + ") AS spread"))
def k03_expand(spark, sf_dir):
    return _ids(spark, sf_dir, m.expand(F.col("x") * 1023 + F.col("y")).alias("spread"))


@query(_sql(f"{q.decode('(code * 5 + l_orderkey)', 0)} AS gathered"))
def k04_compact(spark, sf_dir):
    return _ids(spark, sf_dir, m.compact(F.col("code") * 5 + F.col("l_orderkey")).alias("gathered"))


@query(_sql("code"))
def k05_encode_code(spark, sf_dir):
    return _ids(spark, sf_dir, "code")


@query(_sql("key", f"({q.at('code', 'scale')} = code) AS lossless"))
def k06_encode_key(spark, sf_dir):
    return _ids(spark, sf_dir, "key", m.is_lossless(F.col("code"), F.col("scale")).alias("lossless"))


@query(_sql(f"{q.key('code', '(scale + 2)')} AS coarse"))
def k07_encode_key_from_code(spark, sf_dir):
    return _ids(spark, sf_dir, m.encode_key(F.col("code"), F.col("scale") + 2).alias("coarse"))


@query(_sql(f"{q.decode('(key >> 5)', 0)} AS kx", f"{q.decode('(key >> 5)', 1)} AS ky", f"{q.decode('(key >> 5)', 2)} AS kz", "CAST(key & 31 AS INTEGER) AS kscale", "key >> 5 AS kcode"))
def k08_decode_key(spark, sf_dir):
    x, y, z = m.key_coord(F.col("key"))
    return _ids(spark, sf_dir, x.alias("kx"), y.alias("ky"), z.alias("kz"), m.key_scale(F.col("key")).alias("kscale"), m.key_code(F.col("key")).alias("kcode"))


@query(_sql("CAST((code >> CAST(3 * scale AS INTEGER)) & 7 AS INTEGER) AS child"))
def k09_child_index(spark, sf_dir):
    return _ids(spark, sf_dir, m.child_index(F.col("code"), F.col("scale")).alias("child"))


@query(_sql(f"{q.at('code', '2')} AS code_at_2", f"CASE WHEN scale <= 2 THEN {q.key('(key >> 5)', '2')} END AS key_at_2"))
def k10_at_scale(spark, sf_dir):
    return _ids(spark, sf_dir, m.code_at_scale(F.col("code"), F.lit(2)).alias("code_at_2"), m.key_at_scale(F.col("key"), F.lit(2)).cast("long").alias("key_at_2"))


@query(_sql(f"{q.key('(key >> 5)', '(scale + 1)')} AS parent"))
def k11_parent_key(spark, sf_dir):
    return _ids(spark, sf_dir, m.parent_key(F.col("key")).alias("parent"))


@query(_sql(f"{q.at('(key >> 5)', '3')} * 32 + scale AS block", f"{q.at('code', '3')} AS block_code"))
def k12_block_key(spark, sf_dir):
    return _ids(spark, sf_dir, m.block_key(F.col("key")).alias("block"), m.code_at_scale(F.col("code"), F.lit(3)).alias("block_code"))


@query(f"WITH {q.KEYS} SELECT DISTINCT key, c.child, ((key >> 5) + (c.child << CAST(3 * (scale - 1) AS INTEGER))) * 32 + scale - 1 AS child_key FROM k, (SELECT CAST(range AS BIGINT) AS child FROM range(8)) c WHERE scale > 0")
def k13_children(spark, sf_dir):
    keys = fx.keys(spark, sf_dir).filter("scale > 0").select("key").distinct()
    rows = keys.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("child"))
    return rows.withColumn("child_key", m.child_key(F.col("key"), F.col("child")))


@query(f"""WITH {q.KEYS}, u AS (SELECT DISTINCT key, key >> 5 AS code, CAST(key & 31 AS INTEGER) AS scale FROM k),
a AS (SELECT u.key, s.up, {q.at("u.code", "s.up")} AS c FROM u, (SELECT CAST(range AS INTEGER) AS up FROM range(1, 4)) s WHERE s.up > u.scale)
SELECT a.key AS child, p.key AS parent FROM a JOIN u p ON p.scale = a.up AND p.code = a.c""")
def k14_ancestor_pairs(spark, sf_dir):
    keys = fx.keys(spark, sf_dir).select("key").distinct()
    up = octree.ancestors(keys, 3, include_self=False)
    return up.join(keys.withColumnRenamed("key", "parent"), F.col("ancestor") == F.col("parent")).select(F.col("key").alias("child"), "parent")


@query(f"WITH {q.KEYS}, u AS (SELECT DISTINCT key, {q.key('(key >> 5)', '(scale + 1)')} AS parent FROM k) SELECT parent, count(*) AS siblings, min(key) AS first_key FROM u GROUP BY parent")
def k15_siblings(spark, sf_dir):
    keys = fx.keys(spark, sf_dir).select("key").distinct()
    return keys.groupBy(m.parent_key(F.col("key")).alias("parent")).agg(F.count("*").alias("siblings"), F.min("key").alias("first_key"))


@query(_sql("CAST(1 << CAST(scale AS INTEGER) AS INTEGER) AS size", "CAST(scale AS INTEGER) AS back"))
def k16_octant_size(spark, sf_dir):
    size = m.octant_size(F.col("scale"))
    return _ids(spark, sf_dir, size.alias("size"), m.size_to_scale(size).alias("back"))


@query(f"WITH {q.KEYS}, u AS (SELECT DISTINCT key FROM k) SELECT key, row_number() OVER (ORDER BY key) AS rank FROM u")
def s01_sort_keys(spark, sf_dir):
    return keysets.ranked(fx.keys(spark, sf_dir).select("key").distinct(), F.asc("key"))


@query(f"WITH {q.TREE} SELECT key, CAST(scale AS INTEGER) AS scale, row_number() OVER (ORDER BY scale DESC, key DESC) AS rank FROM t")
def s02_sort_blocks(spark, sf_dir):
    return keysets.ranked(fx.tree(spark, sf_dir).select("key", "scale"), F.desc("scale"), F.desc("key"))


@query(f"WITH {q.KEYS} SELECT DISTINCT key FROM k")
def s03_unique_keys(spark, sf_dir):
    return keysets.unique_keys(fx.keys(spark, sf_dir))


@query(f"WITH {q.KEYS} SELECT (key >> 5) * 32 + min(key & 31) AS key FROM k GROUP BY key >> 5")
def s04_unique_codes(spark, sf_dir):
    return keysets.unique_codes(fx.keys(spark, sf_dir))


def _mixed_keys(spark, sf_dir):
    return fx.keys(spark, sf_dir).select(m.encode_key(F.col("code"), F.col("l_orderkey") % 7 + 2).alias("key"))


_ALLOC = f"""WITH {q.KEYS}, b AS (SELECT DISTINCT {q.key("code", "greatest(l_orderkey % 7 + 2, 3)")} AS key FROM k),
f AS (SELECT key >> 5 AS code, min(key & 31) AS scale FROM b GROUP BY 1),
n AS (SELECT *, lead(code) OVER (ORDER BY code) AS next FROM f)
SELECT code * 32 + scale AS key FROM n WHERE next IS NULL OR next >= code + (1::BIGINT << CAST(3 * scale AS INTEGER))"""


@query(_ALLOC)
def s05_unique_allocation(spark, sf_dir):
    return keysets.unique_allocation(_mixed_keys(spark, sf_dir), partitions_scale=6)


@query(f"WITH {q.KEYS} SELECT DISTINCT {q.key('(key >> 5)', '2')} AS key FROM k WHERE scale <= 2")
def s06_unique_at_scale(spark, sf_dir):
    return keysets.unique_at_scale(fx.keys(spark, sf_dir), 2)


@query(f"WITH {q.KEYS} SELECT DISTINCT key FROM k WHERE l_linenumber > 1 UNION SELECT key FROM k WHERE l_linenumber <= 2")
def s07_merge_sets(spark, sf_dir):
    k = fx.keys(spark, sf_dir)
    return keysets.merge_keys(k.filter("l_linenumber > 1"), k.filter("l_linenumber <= 2"))


@query(f"""WITH {q.TREE} SELECT DISTINCT key FROM t WHERE is_block OR child_mask = 0 EXCEPT SELECT key FROM t WHERE (code >> 9) % 5 = 0""")
def s08_updated_octants(spark, sf_dir):
    t = fx.tree(spark, sf_dir)
    code = m.key_code(F.col("key"))
    return keysets.updated_octants(octree.blocks(t), octree.nodes(t).filter("child_mask = 0"), octree.leaves(t), t.filter(m._shr(code, 9) % 5 == 0))


@query(f"WITH {q.TREE} SELECT key FROM t WHERE is_block AND (code >> 9) % 2 = 0 UNION ALL SELECT key FROM t WHERE is_block AND (code >> 9) % 2 = 1")
def s09_all_blocks(spark, sf_dir):
    b = octree.blocks(fx.tree(spark, sf_dir))
    odd = m._shr(m.key_code(F.col("key")), 9) % 2
    return keysets.all_blocks(b.filter(odd == 0), b.filter(odd == 1))


def _tree(spark, sf_dir):
    return fx.tree(spark, sf_dir).select("key", "scale", "is_block", "child_mask")


_T = "SELECT key, CAST(scale AS INTEGER) AS scale, is_block, child_mask FROM t"


@query(f"WITH {q.TREE} {_T}")
def t01_octants(spark, sf_dir):
    return _tree(spark, sf_dir)


@query(f"WITH {q.TREE} {_T} WHERE NOT is_block")
def t02_nodes(spark, sf_dir):
    return octree.nodes(_tree(spark, sf_dir))


@query(f"WITH {q.TREE} {_T} WHERE is_block")
def t03_blocks(spark, sf_dir):
    return octree.blocks(_tree(spark, sf_dir))


@query(f"WITH {q.TREE} {_T} WHERE child_mask = 0")
def t04_leaves(spark, sf_dir):
    return octree.leaves(_tree(spark, sf_dir))


_STAMPED = f"WITH {q.TREE}, s AS (SELECT t.*, CASE WHEN is_block THEN CAST((code >> 9) % 32 AS INTEGER) ELSE -1 END AS ts FROM t)"


def _stamped(spark, sf_dir):
    ts = F.when(F.col("is_block"), (m._shr(m.key_code(F.col("key")), 9) % 32).cast("int")).otherwise(F.lit(-1))
    return _tree(spark, sf_dir).withColumn("ts", ts)


@query(f"{_STAMPED} SELECT key, ts FROM s WHERE is_block AND ts >= 20")
def t05_updated_blocks(spark, sf_dir):
    return octree.updated_since(_stamped(spark, sf_dir), 20).select("key", "ts")


@query(f"""{_STAMPED}, up AS (SELECT {q.at("s.code", "l.scale")} AS code, l.scale, max(ts) AS latest FROM s, (SELECT CAST(range AS BIGINT) AS scale FROM range(3, 10)) l WHERE s.is_block GROUP BY 1, 2)
SELECT s.key, coalesce(latest, ts) AS ts FROM s LEFT JOIN up ON up.code = s.code AND up.scale = s.scale""")
def h08_propagate_timestamps(spark, sf_dir):
    return octree.propagate_timestamps(_stamped(spark, sf_dir), fx.TOP).select("key", "ts")


_POINTS = f"p AS (SELECT o_orderkey AS id, o_custkey % 512 AS x, o_orderkey % 512 AS y, o_orderkey % 16 AS z FROM orders), pc AS (SELECT *, {q.code('x', 'y', 'z')} AS c FROM p)"


def _points(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 512).alias("x"), (F.col("o_orderkey") % 512).alias("y"), (F.col("o_orderkey") % 16).alias("z"))


@query(f"WITH {q.TREE}, {_POINTS} SELECT pc.id, t.key FROM pc LEFT JOIN t ON t.scale = 4 AND t.code = {q.at('pc.c', '4')}")
def t07_octant(spark, sf_dir):
    return octree.fetch(_points(spark, sf_dir), _tree(spark, sf_dir), 4).select("id", "key")


_FINEST = """, r AS (SELECT pc.id, t.key, t.scale, t.child_mask, row_number() OVER (PARTITION BY pc.id ORDER BY t.scale) AS n FROM pc JOIN t ON t.scale >= {low} AND t.code = ((pc.c >> CAST(3 * t.scale AS INTEGER)) * (1::BIGINT << CAST(3 * t.scale AS INTEGER))))
SELECT pc.id, r.key FROM pc LEFT JOIN r ON r.id = pc.id AND r.n = 1 AND (r.scale = {low} OR r.child_mask = 0)"""


@query(f"WITH {q.TREE}, {_POINTS}{_FINEST.format(low=4)}")
def t08_finest_octant(spark, sf_dir):
    return octree.finest(_points(spark, sf_dir), _tree(spark, sf_dir), 4, fx.TOP).select("id", "key")


@query(f"WITH {q.TREE}, {_POINTS} SELECT pc.id, t.key FROM pc LEFT JOIN t ON t.is_block AND t.code = {q.at('pc.c', '3')}")
def t09_block(spark, sf_dir):
    return octree.fetch(_points(spark, sf_dir), _tree(spark, sf_dir), 3).select("id", "key")


@query(f"WITH {q.TREE}, {_POINTS}{_FINEST.format(low=3)}")
def t10_leaf(spark, sf_dir):
    return octree.finest(_points(spark, sf_dir), _tree(spark, sf_dir), 3, fx.TOP).select("id", "key")


_FACES = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(octree.FACES))


@query(f"""WITH {q.TREE}, f(face, dx, dy, dz) AS (VALUES {_FACES}),
n AS (SELECT t.key, face, {q.decode("t.code", 0)} + dx * 8 AS x, {q.decode("t.code", 1)} + dy * 8 AS y, {q.decode("t.code", 2)} + dz * 8 AS z FROM t, f WHERE t.is_block),
i AS (SELECT key, face, {q.code("x", "y", "z")} AS c, key >> 5 AS own FROM n WHERE least(x, y, z) >= 0 AND greatest(x, y, z) < 512),
r AS (SELECT i.key, face, min_by(t.key, t.scale) AS k, min(t.scale) AS s, min_by(t.child_mask, t.scale) AS mask, any_value(own) AS own FROM i JOIN t ON t.code = ((i.c >> CAST(3 * t.scale AS INTEGER)) * (1::BIGINT << CAST(3 * t.scale AS INTEGER))) GROUP BY i.key, face)
SELECT key, face, CASE WHEN (s = 3 OR mask = 0) AND (s = 3 OR ((own >> CAST(3 * s AS INTEGER)) <> (k >> 5) >> CAST(3 * s AS INTEGER))) THEN k END AS neighbour FROM r""")
def t11_face_neighbours(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return octree.face_neighbours(t, octree.blocks(t), fx.SIZE, fx.TOP)


@query(f"""WITH {q.TREE}, bl AS (SELECT key, {q.decode("code", 0)} AS x, {q.decode("code", 1)} AS y, {q.decode("code", 2)} AS z FROM t WHERE is_block),
n AS (SELECT key, x + i * 8 AS x, y + j * 8 AS y, z + l * 8 AS z FROM bl, range(-1, 2) a(i), range(-1, 2) c(j), range(-1, 2) d(l) WHERE NOT (i = 0 AND j = 0 AND l = 0))
SELECT key, {q.code("x", "y", "z")} * 32 + 3 AS neighbour FROM n WHERE least(x, y, z) >= 0 AND greatest(x, y, z) < 512""")
def t13_neighbours(spark, sf_dir):
    return octree.neighbours26(octree.blocks(_tree(spark, sf_dir)).select("key"), fx.SIZE)


@query(f"WITH {q.TREE} SELECT key, ({q.at('code', 'scale + 1')} + (c.i << CAST(3 * scale AS INTEGER))) * 32 + scale AS sibling FROM t, (SELECT CAST(range AS BIGINT) AS i FROM range(8)) c WHERE is_block")
def t13_siblings(spark, sf_dir):
    return octree.siblings(octree.blocks(_tree(spark, sf_dir)).select("key"))


@query(f"WITH {q.TREE} SELECT key FROM t EXCEPT SELECT key FROM t WHERE (code >> 12) % 3 = 0 AND scale >= 4")
def a01_allocate_missing(spark, sf_dir):
    t = _tree(spark, sf_dir)
    have = t.filter((m._shr(m.key_code(F.col("key")), 12) % 3 == 0) & (F.col("scale") >= 4))
    return octree.allocate(octree.blocks(t).select("key"), fx.TOP, existing=have, only_allocated=True)


@query(f"WITH {q.TREE} SELECT (code + (c.i << 9)) * 32 + 3 AS key FROM t, (SELECT CAST(range AS BIGINT) AS i FROM range(8)) c WHERE scale = 4")
def a02_allocate_children(spark, sf_dir):
    return octree.allocate_children(_tree(spark, sf_dir).filter("scale = 4").select("key"))


@query(f"WITH {q.TREE}, p AS (SELECT code FROM t WHERE scale = 5 AND (code >> 15) % 2 = 0) SELECT key FROM t WHERE NOT (scale < 5 AND {q.at('code', '5')} IN (SELECT code FROM p))")
def a03_delete_children(spark, sf_dir):
    t = _tree(spark, sf_dir)
    parents = t.filter((F.col("scale") == 5) & (m._shr(m.key_code(F.col("key")), 15) % 2 == 0)).select("key")
    return octree.delete_children(t, parents, fx.TOP).select("key")


@query(f"WITH {q.TREE} SELECT key FROM t")
def a04_allocate_with_ancestors(spark, sf_dir):
    return octree.allocate(fx.keys(spark, sf_dir).select(m.encode_key(F.col("code"), F.lit(3)).alias("key")), fx.TOP)


@query(f"WITH {q.TREE} SELECT key, CAST(s.l AS INTEGER) AS scale FROM t, range(1, 4) s(l) WHERE is_block AND s.l >= 2")
def a11_block_scales(spark, sf_dir):
    b = octree.blocks(_tree(spark, sf_dir)).select("key")
    return octree.drop_scales(octree.block_scales(b, 1), 2)


@query(f"WITH {q.TREE}, l AS (SELECT {q.decode('code', 0)} AS x, {q.decode('code', 1)} AS y, {q.decode('code', 2)} AS z, 1 << CAST(scale AS INTEGER) AS s FROM t WHERE child_mask = 0) SELECT min(x) AS min_x, CAST(max(x + s - 1) AS BIGINT) AS max_x, min(y) AS min_y, CAST(max(y + s - 1) AS BIGINT) AS max_y, min(z) AS min_z, CAST(max(z + s - 1) AS BIGINT) AS max_z FROM l")
def q12_bounds(spark, sf_dir):
    return octree.bounds(_tree(spark, sf_dir))


_SIZES = ((12.8, 0.1), (25.6, 0.1), (51.2, 0.1), (10.24, 0.01), (20.48, 0.01), (10.24, 0.02), (20.48, 0.02), (10.0, 0.05), (100.0, 0.05))


@query("SELECT d AS dim, r AS res, CAST(1 << CAST(ceil(log2(greatest(ceil(d / r), 16))) AS INTEGER) AS INTEGER) AS size, CAST(ceil(log2(greatest(ceil(d / r), 16))) AS INTEGER) - 3 AS block_depth FROM (VALUES " + ", ".join(f"({d}::DOUBLE, {r}::DOUBLE)" for d, r in _SIZES) + ") v(d, r)")
def q15_map_sizes(spark, sf_dir):
    rows = [(d, r, n := octree.map_size(d, r), octree.block_depth(n)) for d, r in _SIZES]
    return spark.createDataFrame(rows, "dim double, res double, size int, block_depth int")
