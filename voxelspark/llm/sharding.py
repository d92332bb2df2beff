"""Shards of bounded size by extendible hashing.

A document's hash is the first 60 bits of an MD5 over its id and text. The directory
starts as one bucket and a bucket splits on the next hash bit only while it holds more
bytes than the limit, so shards have different depths and no full rehash ever happens.

Sizes are first summed into cells (hash prefixes somewhat finer than the shards); the
directory is worked out on cells, never on documents, and stays a table. Cells that are
too large on their own go through the same again with more bits. Documents that no bit
can part (rows that repeat in id and text beyond the limit, or one text beyond it) stay
in a bucket of full depth, which is cut into overflow pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep
from .text import col, free_name, whole

HASH_BITS = 60
#: Production limit of a shard, in bytes of text.
LIMIT_BYTES = 64 << 20
#: Cells per shard, as a power of two: the finer, the fewer cells need a second pass.
CELL_BITS = 6
#: A directory of at most this many cells (40 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_CELLS = 50_000


def hash_bits(doc_id: Column, text: Column) -> Column:
    """The hash as a non-negative long of HASH_BITS bits."""
    joined = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(whole(text)))
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(bits: Column, depth: Column | int) -> Column:
    """The first depth bits."""
    if isinstance(depth, int):
        return F.shiftright(bits, HASH_BITS - depth)
    return F.call_function("shiftright", bits, (F.lit(HASH_BITS) - depth).cast("int"))


def leaves(cells: DataFrame, depth: int, floor: int, limit: int) -> DataFrame:
    """(cell, depth, bytes): for each cell the shallowest of its prefixes whose bucket fits.

    cells: (cell, bytes) at this depth; floor: the depth at which their buckets are known
    to be too large, so none shallower is tried. A cell that doesn't fit alone gets a null depth.
    """
    rows = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("d"))
    rows = rows.withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("d")).cast("int")))
    sums = rows.groupBy("d", "p").agg(F.sum("bytes").alias("held")).filter(F.col("held") <= limit)
    fits = rows.join(sums, ["d", "p"]).groupBy("cell").agg(F.min(F.struct("d", "held")).alias("leaf"))
    return cells.select("cell").join(fits, "cell", "left").select("cell", F.col("leaf.d").alias("depth"), F.col("leaf.held").alias("held"))


def directory(sizes: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame]], int]:
    """The directory as [(cell depth, table of leaves)], in the order in which it is asked.

    sizes: (h, bytes). Every pass looks only at what the one before left too large.
    """
    total, rest, floor, out = sizes.agg(F.sum("bytes")).first()[0] or 0, sizes, 0, []
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + CELL_BITS)
    while True:
        cells = rest.groupBy(prefix(F.col("h"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        found = keep(leaves(cells, depth, floor, limit), "shard-directory")
        n, left = found.agg(F.count("*"), F.count_if(F.col("depth").isNull())).first()
        out.append((depth, found, n))
        if not left or depth == HASH_BITS:
            return out, total
        large = found.filter(F.col("depth").isNull()).select("cell")
        rest = rest.withColumn("cell", prefix(F.col("h"), depth)).join(large, "cell", "left_semi").select("h", "bytes")
        floor, depth = depth + 1, min(HASH_BITS, depth + 12)


def assign(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shard_id, shard_depth, shard_bytes (of the whole shard) and n_bytes.

    shard_id is the hash prefix in binary digits ("" for a single shard), with "+k" on the
    later overflow pages of a bucket that can't be split. Null ids and texts hash as empty,
    and a null or empty text has 0 bytes. Repeated rows are kept, each counted. A text above
    the limit has a shard to itself or with others of the same hash. An empty table gives
    an empty table. Columns of docs keep their values; where one has a name of ours, ours
    replaces it.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    ours = ["shard_id", "shard_depth", "shard_bytes", "n_bytes"]
    base = docs.select(*[col(c) for c in docs.columns if c.lower() not in ours])
    h, b = free_name(base.columns, "h"), free_name(base.columns, "b")
    rows = base.withColumn(h, hash_bits(col(id_col), col(text_col))).withColumn(b, F.octet_length(whole(col(text_col))).cast("long"))
    small = keep(rows.select(col(h).alias("h"), col(b).alias("bytes")), "shard-sizes")
    tables, _ = directory(small, limit)
    depth, held, names = F.lit(None).cast("int"), F.lit(None).cast("long"), []
    for k, (bits, table, n) in enumerate(tables):
        c, d, s = (free_name(rows.columns, f"{x}{k}") for x in ("cell", "depth", "held"))
        table = table.select(F.col("cell").alias(c), F.col("depth").alias(d), F.col("held").alias(s))
        rows = rows.withColumn(c, prefix(col(h), bits)).join(F.broadcast(table) if n <= BROADCAST_CELLS else table, c, "left")
        depth, held, names = F.coalesce(depth, col(d)), F.coalesce(held, col(s)), [*names, c, d, s]
    kept = [col(c) for c in base.columns]
    rows = rows.select(*kept, col(h), col(b).alias("n_bytes"), depth.alias("shard_depth"), held.alias("shard_bytes"))
    label = lambda d: F.when(d > 0, F.lpad(F.bin(prefix(col(h), d)), d, "0")).otherwise("")
    out = rows.filter(F.col("shard_depth").isNotNull()).select(*kept, label(F.col("shard_depth")).alias("shard_id"), "shard_depth", "shard_bytes", "n_bytes")
    if tables[-1][0] < HASH_BITS:
        return out
    # Rows of one full hash have one text, so as many as fit make a page, one at least.
    w = Window.partitionBy(col(h))
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest(F.max("n_bytes").over(w), F.lit(1))), F.lit(1))
    page = F.floor((F.row_number().over(w.orderBy(col(id_col))) - 1) / fit)
    over = rows.filter(F.col("shard_depth").isNull()).withColumn(p := free_name(rows.columns, "page"), page)
    over = over.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy(col(h), col(p))))
    name = F.concat(F.lpad(F.bin(col(h)), HASH_BITS, "0"), F.when(col(p) > 0, F.concat(F.lit("+"), col(p).cast("string"))).otherwise(""))
    return out.unionByName(over.select(*kept, name.alias("shard_id"), F.lit(HASH_BITS).alias("shard_depth"), "shard_bytes", "n_bytes"))


#: Name of the partition folders: a letter before the bits keeps them text, and names the shard without bits.
FOLDER, MARK = "shard", "s"


def write(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, **names: str) -> DataFrame:
    """Write each shard as a Parquet folder shard=s<shard_id> under path; returns its manifest, read from what was written.

    The folders hold docs' columns (but for ours and one named shard) with shard_depth,
    shard_bytes and n_bytes. Manifest: shard_id, n_docs, bytes. An empty table gives an
    empty manifest.
    """
    rows = assign(docs, limit, **names)
    rows = rows.select(*[col(c) for c in rows.columns if c.lower() not in (FOLDER, "shard_id")], F.concat(F.lit(MARK), F.col("shard_id")).alias(FOLDER))
    rows.repartition(FOLDER).write.mode("overwrite").partitionBy(FOLDER).parquet(path)
    written = docs.sparkSession.read.schema(rows.schema).parquet(path)
    return written.groupBy(F.substring(FOLDER, len(MARK) + 1, HASH_BITS + 30).alias("shard_id")).agg(F.count("*").alias("n_docs"), F.sum("n_bytes").alias("bytes"))
