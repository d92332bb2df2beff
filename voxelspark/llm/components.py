"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

ROUNDS = 60
#: A key with more than this share of all rows is hot; there are fewer than HOT such keys.
HOT = 1000


def spread_join(rows: DataFrame, groups: DataFrame, on: str, total: int) -> DataFrame:
    """rows with the columns of groups, one row for each value of on, in which n counts its rows; total is the sum of n.

    Rows of hot keys stay where they are: their groups, fewer than HOT, are broadcast. The
    others, each at most total / HOT rows, meet by exchange. Column n is left out.
    """
    more = [c for c in groups.columns if c not in (on, "n")]
    hot = F.broadcast(groups.filter(F.col("n") * HOT > total).select(F.col(on).alias("_hot"), F.struct(*more).alias("_of")))
    marked = rows.join(hot, F.col(on) == F.col("_hot"), "left")
    known = marked.filter("_hot is not null").select(*rows.columns, *[F.col(f"_of.{c}").alias(c) for c in more])
    cold = marked.filter("_hot is null").select(*rows.columns).join(groups.filter(F.col("n") * HOT <= total).drop("n"), on)
    return known.unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the component's least node.

    Each round links all neighbours of a node to the least one, first the larger and then
    the smaller ones, and is written to the shared folder. Every step is an aggregate or an
    equi-join; the rows of a node with very many neighbours stay spread (spread_join), so
    no component is ever in one place.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e, last = keep(e, "edges"), None
    for _ in range(ROUNDS):
        sign = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == last or not sign[0]:
            break
        last = sign
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = spread_join(both.filter("b > a"), least, "a", 2 * sign[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("c")).select("a", "b", "m")
        links = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = keep(links.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
