"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document of quality weight w gets the key -ln(u) / w, with u in (0, 1) from a hash of
its id: ascending keys are a weighted draw without replacement. A source whose target
is e times its size and a rest first takes e complete epochs, then the documents of
smallest key until their prefix sum comes nearest to the rest.

No source is sorted as a whole. Keys fall into a fixed number of buckets whose sums are
aggregated on the map side; only the one bucket per source in which the rest runs out is
sorted. What comes out is one row per source with the key at which to stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep
from .text import SYMBOLS, col, count_words, free_name, whole

#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the input, and the most epochs a source may take.
SHARE, MOST_EPOCHS = 1.5, 2
BUCKETS = 4096


def quality_weight(text: Column) -> Column:
    """1 for plain text, less with the share of markup symbols, 0.1 at least."""
    n = F.length(text)
    symbols = n - F.length(F.regexp_replace(text, SYMBOLS, ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * symbols / n))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    v = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return -F.log((v + F.lit(0.5)) / F.lit(2.0**52)) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with target, by the closed form of resharing what a cap cuts off.

    Sorted by cap over weight, the sources up to some point are capped; the others share
    what is left by weight. One row per source, so windows over all of them are small.
    """
    every = Window.partitionBy()
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((n - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(every))
    fair = F.coalesce(F.col("level") * F.col("w"), F.col("cap"))
    return t.select("source", "source_size", F.least(F.col("cap"), fair).alias("target"))


def with_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None) -> DataFrame:
    text = whole(col(text_col))
    return docs.select(
        col(source_col).cast("string").alias("source"),
        col(id_col).alias("doc_id"),
        count_words(text).alias("size"),
        sampling_key(col(id_col), quality_weight(text) if weight is None else weight).alias("key"),
        F.xxhash64(text).alias("tie"),
    )


def cuts(keyed: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs, and the last (key, doc_id, tie) of the fraction."""
    at = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    rows = keyed.withColumn("bucket", at)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    plan = targets(sums.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = keep(plan, "mix-targets")
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(so_far), F.lit(0)))
    cross = sums.join(plan.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of")))
    cross = cross.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("held"))).select("of", F.col("bucket").alias("at"), "before", "rest")
    fine = rows.join(cross, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    order = F.struct("key", "doc_id", "tie")
    within = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    stops = fine.groupBy("of").agg(F.max("at").alias("bucket"), F.max(F.when(F.col("before") + F.col("size") / 2 <= F.col("rest"), order)).alias("last"))
    # Without words left to take there is no crossing bucket, and nothing but the epochs is taken.
    return plan.join(stops, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "epochs", "bucket", "last")


def taken(key: Column, doc_id: Column, tie: Column, size: Column) -> Column:
    """Words a document gives to the mix, from the columns of cuts() beside it."""
    at = F.least(F.floor((F.lit(1.0) - F.exp(-key)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    here = F.struct(key.alias("key"), doc_id.alias("doc_id"), tie.alias("tie")) <= F.col("last")
    part = F.coalesce((at < F.col("bucket")) | ((at == F.col("bucket")) & F.coalesce(here, F.lit(False))), F.lit(False))
    return (size * (F.col("epochs") + part.cast("long"))).cast("long")


def plan_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weight: Column | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """The keyed documents (a kept table without texts) and one row of cuts() per source."""
    keyed = keep(with_keys(docs, id_col, text_col, source_col, weight), "mix-keys")
    return keyed, keep(cuts(keyed, **how), "mix-cuts")


def mix_sizes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs.

    Null or empty texts have size 0 and give 0 words. Null is a source of its own, ordered
    last. Rows that repeat an id and text have one key and are taken together; reruns agree.
    A source of size 0 has target 0; an empty table gives an empty table.
    """
    keyed, cut = plan_mix(docs, **how)
    cut = cut.withColumnRenamed("source", "of")
    rows = keyed.join(cut, F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken(F.col("key"), F.col("doc_id"), F.col("tie"), F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weight: Column | None = None, **how) -> DataFrame:
    """The mixed corpus: the columns of docs, each document as often as it is taken.

    Documents of size 0 are left out. Names of docs' other columns don't matter.
    """
    _, cut = plan_mix(docs, id_col, text_col, source_col, weight, **how)
    names = {c: free_name(docs.columns, f"mix_{c}") for c in ("source", "key", "size", "tie", "times")}
    text = whole(col(text_col))
    rows = docs.withColumns({
        names["key"]: sampling_key(col(id_col), quality_weight(text) if weight is None else weight),
        names["size"]: count_words(text),
        names["tie"]: F.xxhash64(text),
    })
    cut = cut.select(F.col("source").alias(names["source"]), F.struct("epochs", "bucket", "last").alias(names["times"]))
    rows = rows.join(cut, col(source_col).cast("string").eqNullSafe(col(names["source"])))
    key, size, tie, of = (col(names[x]) for x in ("key", "size", "tie", "times"))
    at = F.least(F.floor((F.lit(1.0) - F.exp(-key)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    here = F.coalesce(F.struct(key.alias("key"), col(id_col).alias("doc_id"), tie.alias("tie")) <= of["last"], F.lit(False))
    part = F.coalesce((at < of["bucket"]) | ((at == of["bucket"]) & here), F.lit(False))
    times = F.when(size > 0, of["epochs"] + part.cast("long")).otherwise(F.lit(0)).cast("int")
    copies = F.filter(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), lambda x: x <= times)
    return rows.withColumn(names["times"], F.explode(copies)).select(*[col(c) for c in docs.columns])
