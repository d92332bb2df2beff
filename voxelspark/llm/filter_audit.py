"""How filters of a chain act on each other: what each removes, alone and in every order.

Each document gets a mask with a bit for each filter that it fails, and a histogram of the
masks, 2^n cells for each part, holds all that any order of the filters can remove. Texts
are read once, for masks and digests; copies meet by digest, and only their least id is
sought, so a group of copies is combined before it is shuffled, however large it is. All
orders are then read off the cells of a part, a row with a fixed number of values.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep
from .text import WORD, col, count_words, whole

#: The filter that fails whatever repeats the text of a smaller id.
REPEATS = "repeats"
#: Words, their share that must differ and of capitals in percent, symbols.
MIN_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, r"[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def distinct_words(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).cast("long")


def standard_filters(text: Column) -> dict[str, Column | str]:
    """Five filters by letter; each column holds where a text fails. None is null, also on the empty text."""
    n = count_words(text)
    return {
        "A": n < MIN_WORDS,
        "B": distinct_words(text) * 100 < n * DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * CAPITALS,
        "D": text.rlike(MARKS),
        "E": REPEATS,
    }


def failures(docs: DataFrame, filters=standard_filters) -> DataFrame:
    """(doc_id, part, mask) for each row of docs (doc_id, text, source), mask with bit k where it fails filter k.

    Null texts count as the empty text and null sources as the part ''. Texts are the same
    if they have the same SHA-256. Rows that repeat the least id of a text stay, all of them;
    a row without an id repeats nothing and nothing repeats it. Words of a very long text are
    held in memory at once, one text at a time. Other columns of docs are not read.
    """
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("source").cast("string"), F.lit("")).alias("part"), whole(col("text")).alias("text"))
    checks = filters(F.col("text"))
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(checks.values()) if not isinstance(c, str)]
    own = reduce(lambda a, b: a + b, bits, F.lit(0))
    rows = keep(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), own.alias("mask")), "failures")
    repeats = [k for k, c in enumerate(checks.values()) if isinstance(c, str)]
    if not repeats:
        return rows.drop("same")
    # The least row of a text is found by its id and text, so that no group of copies is ever together.
    least = rows.filter("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    known = rows.filter("doc_id is not null").join(least, ["doc_id", "same"], "left")
    more = F.when(F.col("least").isNull(), F.lit(sum(1 << k for k in repeats))).otherwise(F.lit(0))
    return known.select("doc_id", "part", (F.col("mask") + more).alias("mask")).unionByName(rows.filter("doc_id is null").drop("same"))


def histogram(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those that a label calls good (quality 1) or toxic (1).

    Several labels of one id count as one: it is good if any says so, and toxic likewise.
    """
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    # Rows that repeat an id are counted before they meet their label, so none is hot; those without an id have none.
    same = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = same.filter("doc_id is not null").join(marks, "doc_id", "left")
    none = same.filter("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    every = known.unionByName(none.select(known.columns))
    times = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTS[1:]]
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), *times)


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of all filters and step in it, from the cells (part, mask, n, good, toxic).

    kept: left after the step; removed: by it; redundant: would fail it but left earlier;
    unique_fails: fail this filter alone; good_lost and toxic_lost: of removed; shapley: what
    the filter removes in all orders together, an even share of each document among those
    that it fails. A part has all its rows, zeros included. An empty table has none.
    """
    n = len(letters)
    held = F.array_sort(F.collect_list(F.struct("mask", *COUNTS)))
    rows = cells.groupBy("part").agg(held.alias("cells"))
    every = ",".join("".join(p) for p in itertools.permutations(letters))
    rows = rows.withColumn("filter_order", F.explode(F.split(F.lit(every), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def bit(letter: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)

    at = lambda k: F.substring(F.col("filter_order"), k, F.lit(1))
    gone = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, k: s + F.when(k < F.col("step"), bit(at(k))).otherwise(F.lit(0)))
    rows = rows.withColumns({"bit": bit(at(F.col("step"))), "before": gone})

    def total(count: str, where, weight=None) -> Column:
        return F.aggregate(F.filter("cells", lambda c: where(c["mask"])), F.lit(0).cast("long"), lambda s, c: s + (c[count] * weight(c["mask"]) if weight else c[count]))

    has = lambda m, b: m.bitwiseAND(F.col(b)) != 0
    here = lambda m: has(m, "bit") & ~has(m, "before")
    share = lambda m: F.floor(F.lit(math.factorial(n)) / F.bit_count(m)).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~has(m, "bit") & ~has(m, "before")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: has(m, "bit") & has(m, "before")).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", lambda m: has(m, "bit"), share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters=standard_filters) -> DataFrame:
    """orders() of the filters over docs (doc_id, text, source) with labels (doc_id, quality, toxic)."""
    return orders(histogram(failures(docs, filters), labels), "".join(filters(F.lit(""))))
