"""Sort, distinct and set operators on tables of Morton keys (column key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import morton as m


def sort_keys(keys: DataFrame, descending: bool = False) -> DataFrame:
    """By key; of equal codes the finer scale comes first, or last if descending."""
    return keys.orderBy(F.desc("key") if descending else F.asc("key"))


def sort_blocks(blocks: DataFrame, largest_first: bool = False) -> DataFrame:
    """By scale, then key: small to large or large to small."""
    order = [F.desc("scale"), F.desc("key")] if largest_first else [F.asc("scale"), F.asc("key")]
    return blocks.orderBy(*order)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows in this order with their rank from 1, for rows that differ in it.

    Ranges are sorted each in its task; a rank is the place in the range after the rows of
    the ranges before, so only the ranges' counts meet in one task. Both read one persisted
    table, as ranges drawn twice need not be equal.
    """
    place = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"range": F.shiftright(place, 33), "place": place.bitwiseAND(F.lit((1 << 33) - 1))}).persist()
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "range").withColumn("rank", F.col("start") + F.col("place") + 1).drop("range", "start", "place")


def unique_keys(keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct()


def unique_codes(keys: DataFrame) -> DataFrame:
    """One key for each code, the one of finest scale."""
    rows = keys.groupBy(m.key_code(F.col("key")).alias("code")).agg(F.min(m.key_scale(F.col("key"))).alias("scale"))
    return rows.select(m._shl(F.col("code"), m.SCALE_BITS).bitwiseOR(F.col("scale").cast("long")).alias("key"))


def unique_allocation(keys: DataFrame, block_scale: int = 3, partitions_scale: int = 12) -> DataFrame:
    """Keys truncated to blocks, without those that are an ancestor of another.

    Per code only the finest key counts; of these, a key is an ancestor exactly if the next
    code lies in its range. Codes are compared within subtrees of partitions_scale, so no
    window spans the whole table; keys coarser than that are tested against the subtrees' keys.
    """
    blocks = keys.select(m.encode_key(m.key_code(F.col("key")), F.greatest(m.key_scale(F.col("key")), F.lit(block_scale))).alias("key"))
    rows = unique_codes(blocks).select("key", m.key_code(F.col("key")).alias("code"), m.key_scale(F.col("key")).alias("scale"))
    rows = rows.withColumn("tree", m.code_at_scale(F.col("code"), F.lit(partitions_scale)))
    following = F.lead("code").over(Window.partitionBy("tree").orderBy("code"))
    rows = rows.withColumn("next", following)
    leaf = F.coalesce(F.col("next") >= m.descendants_end(F.col("code"), F.col("scale")), F.lit(True))
    fine = rows.filter((F.col("scale") < partitions_scale) & leaf).select("key")
    coarse = rows.filter(F.col("scale") >= partitions_scale)
    scales = F.explode(F.sequence(F.lit(partitions_scale), F.lit(m.MAX_SCALE))).alias("at")
    above = rows.select("code", "scale", scales).filter(F.col("at") > F.col("scale")).select(m.code_at_scale(F.col("code"), F.col("at")).alias("code"), F.col("at").alias("scale")).distinct()
    return fine.unionByName(coarse.join(above, ["code", "scale"], "left_anti").select("key"))


def unique_at_scale(keys: DataFrame, scale: int) -> DataFrame:
    """Finer keys brought to scale, coarser ones dropped, distinct."""
    at = m.key_at_scale(F.col("key"), F.lit(scale))
    return keys.select(at.alias("key")).filter("key is not null").distinct()


def merge_keys(*tables: DataFrame) -> DataFrame:
    """The union of key tables as a set."""
    out = tables[0].select("key")
    for t in tables[1:]:
        out = out.unionByName(t.select("key"))
    return out.distinct()


def updated_octants(blocks: DataFrame, freed: DataFrame, leaves: DataFrame, pruned: DataFrame) -> DataFrame:
    """Keys changed by an update: blocks, freed blocks and leaf nodes, without pruned ones."""
    return merge_keys(blocks, freed, leaves).join(pruned.select("key"), "key", "left_anti")


def all_blocks(fetched: DataFrame, allocated: DataFrame) -> DataFrame:
    """Fetched and newly allocated blocks, which are disjoint by construction."""
    return fetched.select("key").unionByName(allocated.select("key"))
