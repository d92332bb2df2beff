"""Queries over free space in octants of any size."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import morton as m
from ..operators import free_space, fusion
from . import fixtures as fx
from . import sql as q
from .files import folder
from .fusion import _MICRO, micro
from .registry import query


def visits(spark, sf_dir):
    """Visits to octants of scale 3 to 6, mostly free; blocks are occupied now and then, or only asked for."""
    scale = F.lit(3) + F.greatest(F.lit(0), F.col("l_orderkey") % 16 - 12).cast("int")
    # Rows of one line meet each other's amounts: a join of lines with themselves in one exchange.
    line = Window.partitionBy("l_orderkey", "l_linenumber")
    rows = fx.keys(spark, sf_dir, "l_quantity").select("l_orderkey", "l_linenumber", "code", F.col("l_quantity").cast("double").alias("amount")).filter("l_orderkey is not null and l_linenumber is not null")
    rows = rows.withColumn("of", F.collect_list(F.struct("amount")).over(line)).drop("amount")
    rows = rows.select("l_orderkey", "l_linenumber", "code", F.inline("of"))
    value = F.when((scale > 3) | (F.col("amount") < 40), F.lit(-5.015)).when(F.col("amount") < 48, (F.col("amount") - 40) / 4)
    rows = rows.select(m.encode_key(F.col("code"), scale).alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame"), value.alias("value"))
    return fusion.settle(rows, "key", "frame", "value")


#: l: leaves with the fold of their own visits and their ancestors'; a: all their ancestors and themselves.
_LEAVES = f"""{q.KEYS}, g AS (SELECT k.*, 3 + greatest(0, k.l_orderkey % 16 - 12) AS s, l_quantity::DOUBLE AS amount FROM k JOIN lineitem USING (l_orderkey, l_linenumber)),
vi AS (SELECT {q.at("code", "s")} AS code, s, l_orderkey * 8 + l_linenumber AS frame, CASE WHEN s > 3 OR amount < 40 THEN -5.015::DOUBLE WHEN amount < 48 THEN (amount - 40) / 4 END AS value FROM g),
dk AS (SELECT DISTINCT code, s FROM vi),
inn AS (SELECT DISTINCT {q.at("code", "t.t")} AS code, t.t AS s FROM dk, range(4, 10) t(t) WHERE t.t > s),
ch AS (SELECT code + (c << CAST(3 * (s - 1) AS INTEGER)) AS code, s - 1 AS s FROM inn, range(8) r(c)),
lf AS (SELECT ch.* FROM ch ANTI JOIN inn ON inn.code = ch.code AND inn.s = ch.s),
a AS (SELECT lf.code AS leaf, lf.s AS own, t.t AS s, {q.at("lf.code", "t.t")} AS code FROM lf, range(3, 10) t(t) WHERE t.t >= lf.s),
h AS (SELECT leaf, own, value, row_number() OVER (PARTITION BY leaf, own ORDER BY frame, value) AS i, count(*) OVER (PARTITION BY leaf, own) AS n FROM a JOIN vi ON vi.code = a.code AND vi.s = a.s WHERE value IS NOT NULL),
f AS (SELECT leaf, own, sum(value * pow(0.95::DOUBLE, greatest(n - greatest(i, 20), 0)) / least(n, 20)) AS occupancy, CAST(least(count(*), 20) AS INTEGER) AS weight FROM h GROUP BY leaf, own),
l AS (SELECT lf.code, lf.s, coalesce(occupancy, 0) AS occupancy, coalesce(weight, 0) AS weight FROM lf LEFT JOIN f ON f.leaf = lf.code AND f.own = lf.s)"""
_BOUNDS = f"""{_LEAVES}, bo AS (SELECT a.code, a.s, min(CASE WHEN weight > 0 THEN occupancy * weight END) AS low, max(CASE WHEN weight > 0 THEN occupancy * weight END) AS high,
  sum(CASE WHEN weight > 0 THEN 1::BIGINT << CAST(3 * a.own AS INTEGER) ELSE 0 END) = any_value(1::BIGINT << CAST(3 * a.s AS INTEGER)) AS observed
  FROM a JOIN l ON l.code = a.leaf AND l.s = a.own GROUP BY a.code, a.s)"""


def state(spark, sf_dir):
    """The leaves after all visits, in two batches: the second splits leaves of the first."""
    # As in a stream, visits have been written, and the next batch reads what the first one wrote.
    at = folder(spark)
    visits(spark, sf_dir).write.parquet(f"{at}/visits")
    every = spark.read.parquet(f"{at}/visits")
    late = F.col("frame") >= every.agg(F.max("frame")).first()[0] // 2
    free_space.update(spark.createDataFrame([], free_space.STATE), every.filter(~late), fx.TOP).write.parquet(f"{at}/early")
    free_space.update(spark.read.parquet(f"{at}/early"), every.filter(late), fx.TOP).write.parquet(f"{at}/leaves")
    return spark.read.parquet(f"{at}/leaves")


@query(f"WITH {_LEAVES} SELECT code * 32 + s AS key, {_MICRO.format('occupancy')} AS occupancy_1e6, weight FROM l")
def f08_free_nodes(spark, sf_dir):
    return state(spark, sf_dir).select("key", micro(F.col("occupancy")).alias("occupancy_1e6"), "weight")


@query(f"WITH {_BOUNDS} SELECT code * 32 + s AS key, {_MICRO.format('low')} AS low_1e6, {_MICRO.format('high')} AS high_1e6, observed FROM bo")
def f08_node_bounds(spark, sf_dir):
    rows = free_space.bounds(free_space.summary(state(spark, sf_dir)), fx.TOP)
    return rows.select("key", micro(F.col("low")).alias("low_1e6"), micro(F.col("high")).alias("high_1e6"), "observed")


@query(f"""WITH {_BOUNDS}, p AS (SELECT a.leaf, a.own, arg_max(a.code, a.s) AS code, max(a.s) AS s FROM a JOIN bo ON bo.code = a.code AND bo.s = a.s WHERE observed AND high <= -95.0::DOUBLE AND a.s < 9 GROUP BY a.leaf, a.own)
SELECT coalesce(p.code, l.code) * 32 + coalesce(p.s, l.s) AS key, {_MICRO.format("max(occupancy * weight)")} AS high_1e6 FROM l LEFT JOIN p ON p.leaf = l.code AND p.own = l.s GROUP BY 1""")
def f08_pruned_nodes(spark, sf_dir):
    rows = free_space.prune(free_space.summary(state(spark, sf_dir)), fx.TOP)
    return rows.select("key", micro(F.col("occupancy") * F.col("weight")).alias("high_1e6"))
