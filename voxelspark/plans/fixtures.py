"""Depth frames, keys, poses, samples and rays derived from the driver's tables, by integer or exact arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morton as m
from ..operators import octree
from ..operators.fusion import settle
from .registry import table  # noqa: F401

#: Edge of the map in voxels, its root scale, and voxel size in metres.
SIZE, TOP, RES = 512, 9, 0.05


def keys(spark: SparkSession, sf_dir: str, *others: str) -> DataFrame:
    """l_orderkey, l_linenumber, other columns, x, y, z, scale, code, key of every lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    c = li.select("l_orderkey", "l_linenumber", *others, (F.col("l_partkey") % 512).alias("x"), (F.col("l_suppkey") % 512).alias("y"), (F.col("l_linenumber") % 512).cast("long").alias("z"), (F.col("l_orderkey") % 4).cast("long").alias("scale"))
    # Copied into grouping keys and filters, a code's expression makes methods too long to compile.
    e = settle(c.withColumn("code", m.encode_code(F.col("x"), F.col("y"), F.col("z"))), "code")
    return e.withColumn("key", m.encode_key(F.col("code"), F.col("scale")))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """octants (key, scale, is_block, child_mask) over the blocks of all keys."""
    blocks = keys(spark, sf_dir).select(m.encode_key(F.col("code"), F.lit(3)).alias("key"))
    return octree.with_children(octree.allocate(blocks, TOP))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, depth_mm: an 8x8 depth image from each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "e"))
    depth = F.floor(F.abs(F.col("e").cast("double")) * 10000).cast("int")
    return rows.select("frame", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), depth.alias("depth_mm"))


#: The same in SQL.
PIXELS = """
px AS (SELECT vec_id AS frame, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(floor(abs(embedding[i + 1]::DOUBLE) * 10000) AS INTEGER) AS depth_mm
       FROM embeddings, LATERAL (SELECT unnest(generate_series(0, 63)) AS i))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iter, key, type, value, seq: statistics from events."""
    ev = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select(F.floor(ts / 86_400_000_000).cast("long").alias("iter"), F.col("event_type").alias("key"), kind[F.col("event_type")].alias("type"), F.round(F.col("value") * 100).cast("long").alias("value"), ts.alias("ts"), "event_id")


TYPES = {"click": "DURATION", "view": "COUNT", "purchase": "MEMORY", "signup": "FREQUENCY", "error": "UNDEFINED"}
_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items())
SAMPLES = f"""
sm AS (SELECT CAST(floor(epoch_us(ts) / 86400000000::DOUBLE) AS BIGINT) AS iter, event_type AS key, CASE event_type {_CASE} END AS type,
              CAST(round(value * 100) AS BIGINT) AS value, epoch_us(ts) AS ts, event_id FROM events)"""


def stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """id, ts (microseconds) and position (px, py, pz) of one event type: a list of images or poses."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return ev.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").cast("double").alias("px"), F.col("user_id").cast("double").alias("py"), (F.col("event_id") % 100).cast("double").alias("pz"))


def stream_sql(kind: str) -> str:
    return f"(SELECT event_id AS id, epoch_us(ts) AS ts, value::DOUBLE AS px, user_id::DOUBLE AS py, (event_id % 100)::DOUBLE AS pz FROM events WHERE event_type = '{kind}')"


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan, seq, ts, x, y, z: LiDAR rays from events; a ray's length is value / 100."""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy(ts, "event_id")).cast("long")
    d = [((F.col("event_id") % 7) - 3).cast("double"), ((F.col("event_id") % 5) - 2).cast("double"), F.lit(1.0)]
    norm = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return ev.select(F.col("user_id").alias("scan"), seq.alias("seq"), ts.alias("ts"), *[(c / norm * (F.col("value") / 100.0)).alias(n) for c, n in zip(d, "xyz", strict=True)])


RAYS = """
d AS (SELECT user_id AS scan, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS seq, epoch_us(ts) AS ts, value::DOUBLE AS value,
             ((event_id % 7) - 3)::DOUBLE AS a, ((event_id % 5) - 2)::DOUBLE AS b, 1.0::DOUBLE AS c FROM events),
ry AS (SELECT scan, seq, ts, a / sqrt(a * a + b * b + c * c) * (value / 100.0::DOUBLE) AS x, b / sqrt(a * a + b * b + c * c) * (value / 100.0::DOUBLE) AS y,
              c / sqrt(a * a + b * b + c * c) * (value / 100.0::DOUBLE) AS z FROM d)"""
