"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Equal texts (the same words in the same order) are one: all further work is on
   distinct texts, so groups of copies cost one row per copy and no pair.
2. Each text gets a MinHash signature. A tree of the forest is a prefix trie over its part
   of the signature, LONGEST values deep. Simulated pairs at the threshold tell how far
   prefixes must be shortened, a value at a time, until a pair shares one in some tree with
   the target recall; values below that depth are never made.
3. Each tree's texts are dealt by their shortest prefix and sorted by the longer ones, which
   is the order of the trie. A text is linked to the least text under its longest prefix
   that another text shares; only the least goes on to the shorter ones. No pairs are made;
   the connected components of the links hold every candidate pair.
4. A component's shingle sets meet in one task, or, beyond BLOCK_WEIGHT, in one task for
   each pair of its blocks. There all pairs are verified exactly, by products of
   incidence matrices, and come out as counts and a spanning forest.
5. The components of the forests are the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, spread_join
from .store import keep, small_batches
from .text import col, free_name, whole
from .words import Words, shingles, words

SHINGLE_WORDS, THRESHOLD = 5, 0.8
TREES, LONGEST, TARGET_RECALL = 20, 8, 0.9995
#: Simulated pairs that recall is measured on, and the sizes of their shingle sets.
TRIALS, MADE_SIZES = 16_000, (40, 100, 160)
#: Shingles (and TEXT_WEIGHT for each text) that one block of a component holds.
BLOCK_WEIGHT, TEXT_WEIGHT = 1_000_000, 2000
_SEED = 4


def made_pairs(threshold: float, trials: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Pairs of shingle sets with the least similarity that passes: (hashes, offsets) of the one side, then of the other."""
    sides: tuple[list, list] = ([], [])
    for n in rng.choice(MADE_SIZES, trials).tolist():
        # Of two sets of n shingles, c common ones give c / (2n - c).
        c = math.ceil(2 * n * threshold / (1 + threshold) - 1e-9)
        both = rng.integers(0, 1 << 63, c, dtype=np.uint64)
        for side in sides:
            side.append(np.concatenate([both, rng.integers(0, 1 << 63, n - c, dtype=np.uint64)]))
    return tuple(x for side in sides for x in (np.concatenate(side), np.r_[0, np.cumsum([len(t) for t in side])]))


@lru_cache
def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, target: float = TARGET_RECALL) -> tuple[int, tuple[float, ...]]:
    """How long a shared prefix must be, and the recall measured at each length tried, from the longest on.

    Raises where not even prefixes of one value reach the target: more trees are called for.
    """
    a, at, b, bt = made_pairs(threshold, TRIALS, np.random.default_rng(_SEED + 1))
    one, other = tree_keys(a, at, trees, longest, 1), tree_keys(b, bt, trees, longest, 1)
    measured = []
    for length in range(longest, 0, -1):
        measured.append(float((one[length - 1] == other[length - 1]).any(axis=1).mean()))
        if measured[-1] >= target:
            return length, tuple(measured)
    raise ValueError(f"{trees} trees find {measured[-1]:.4f} of the pairs at {threshold}, not {target}")


def text_keys(w: Words) -> list[bytes]:
    """A digest of each text's words in order."""
    return [hashlib.blake2b(w.hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(w.of[:-1], w.of[1:], strict=True)]


def tree_keys(hashes: np.ndarray, offsets: np.ndarray, trees: int, longest: int, shortest: int) -> np.ndarray:
    """[length - shortest, text, tree]: hashes of the prefixes from shortest to longest (each text has a shingle)."""
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 1 << 63, (trees, longest), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, (trees, longest), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((longest - shortest + 1, len(offsets) - 1, trees), dtype=np.uint64)
    for t in range(trees):
        key = np.zeros(len(offsets) - 1, dtype=np.uint64)
        for j in range(longest):
            key = (key ^ np.minimum.reduceat(hashes * a[t, j], offsets[:-1])) * b[t, j]
            key ^= key >> np.uint64(29)
            if j + 1 >= shortest:
                out[j + 1 - shortest, :, t] = key + np.uint64(t)
    return out


def signatures(docs: DataFrame, size: int, trees: int, longest: int, shortest: int) -> DataFrame:
    """docs (doc_id, text) as (doc_id, tid, n_shingles, keys); keys holds prefixes, all trees' shortest ones first."""
    width = trees * (longest - shortest + 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text")):
                hashes, offsets = shingles(w, size)
                n = np.diff(offsets)
                some, flat = np.flatnonzero(n), np.zeros(0, dtype=np.int64)
                if len(some):
                    keys = tree_keys(hashes, np.r_[offsets[:-1][some], offsets[-1]], trees, longest, shortest)
                    flat = np.ascontiguousarray(keys.transpose(1, 0, 2)).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(n > 0, width, 0))].astype(np.int32)), pa.array(flat))
                ids = batch.column("doc_id").slice(w.first, len(w))
                yield pa.record_batch([ids, pa.array(text_keys(w), pa.binary()), pa.array(n.astype(np.int64)), lists], names=["doc_id", "tid", "n_shingles", "keys"])

    return docs.mapInArrow(sign, "doc_id long, tid binary, n_shingles long, keys array<long>")


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Square boolean matrix: which of these sorted distinct sets have the threshold's similarity."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.r_[True, values[1:] != values[:-1]]
    run = np.cumsum(new) - 1
    often = np.bincount(run) > 1
    column = np.cumsum(often) - 1
    use = often[run]
    owner, column = owner[use], column[run[use]]
    common, width = np.zeros((n, n), dtype=np.float64), max(1, (8 << 20) // n)
    # Columns are in order, so each slice of rows holds whole columns.
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, int(column[b - 1]) - low + 1), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    out = common >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """For each node of a boolean matrix the least node it is connected to."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        low = np.minimum(label, near)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): n links of text a found in one task (b null), or an edge of a spanning forest (n null).

    members: (root, i, j, own, tid, grams), one group of rows for each (root, i, j); own is
    the block of the text. With i = j all pairs are compared, else those across the blocks.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, []

        def finish():
            tids = list(held)
            sets = [np.frombuffer(held[t][1], dtype=np.uint64) for t in tids]
            links = linked(sets, threshold)
            own = np.array([held[t][0] for t in tids])
            if key[1] != key[2]:
                links &= own[:, None] != own[None, :]
            for t, n, r in zip(tids, links.sum(axis=1).tolist(), roots(links).tolist(), strict=True):
                if n:
                    out.append((t, None, n))
                if tids[r] != t:
                    out.append((t, tids[r], None))

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "n"])

        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("root", "i", "j", "own", "tid", "grams")]
            for root, i, j, own, tid, grams in zip(*cols, strict=True):
                if key != (root, i, j):
                    if len(held) > 1:
                        finish()
                    key, held = (root, i, j), {}
                held[tid] = (own, grams)
            yield flush()
        if len(held) > 1:
            finish()
        yield flush()

    return members.mapInArrow(compare, "a binary, b binary, n long")


def forest(texts: DataFrame, trees: int, longest: int, shortest: int) -> DataFrame:
    """(a, b): links of texts (tid, keys) to the least text under the longest prefix that they share with another.

    Dealt by the shortest prefix and sorted by all, a trie's nodes are stretches of rows at
    every length, so one exchange and one sort serve all lengths.
    """
    lengths = range(shortest, longest + 1)
    prefixes = lambda t: F.struct(*[F.get("keys", (n - shortest) * trees + t).alias(f"k{n}") for n in lengths])
    rows = texts.select("tid", F.inline(F.array(*[prefixes(t) for t in range(trees)]))).repartition(f"k{shortest}")
    for n in reversed(lengths):
        node = Window.partitionBy(*[f"k{m}" for m in range(shortest, n + 1)])
        rows = rows.withColumn(f"least{n}", F.min("tid").over(node))
    least = F.coalesce(*[F.nullif(F.col(f"least{n}"), F.col("tid")) for n in reversed(lengths)])
    return rows.select(F.col("tid").alias("a"), least.alias("b")).filter("b is not null")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, tid, class_id, n_links, n_copies) of every row of docs.

    class_id: the least doc_id of all texts connected by links, a link being a Jaccard
    similarity of word shingles of at least the threshold. n_links: how many other distinct
    texts this text has a link to. n_copies: rows with this text. Texts are equal if their
    words are. Null and empty texts, and those without a word, have no link: each row is a
    class of its own with n_copies 1. A text of fewer words than a shingle has one shingle,
    all its words. Repeated rows are copies; an empty table gives an empty table. A text of
    any length is shingled whole, by one task. Other columns of docs are not read.
    """
    shortest, _ = prefix_length(threshold, trees, longest, target)
    small_batches(docs.sparkSession)
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), whole(col(text_col)).alias("text"))
    rows = keep(signatures(texts, size, trees, longest, shortest), "signatures")
    distinct = rows.filter("n_shingles > 0").groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    distinct = keep(distinct, "distinct-texts")
    near = forest(distinct, trees, longest, shortest)
    parts = components(near).withColumnRenamed("node", "tid")
    parts = parts.join(distinct.select("tid", "first_id", "n_shingles"), "tid")
    parts = keep(parts.select("tid", "root", "first_id", "n_shingles"), "candidates")
    blocks = parts.groupBy("root").agg(F.ceil(F.sum(F.col("n_shingles") + TEXT_WEIGHT) / BLOCK_WEIGHT).cast("int").alias("blocks"), F.count("*").alias("n"))
    parts = spread_join(parts, blocks, "root", parts.count()).withColumn("own", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    parts = keep(parts.select("root", "tid", "first_id", "blocks", "own"), "components")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids = batch.column("tid").to_pylist()
            for w in words(batch.column("text")):
                hashes, offsets = shingles(w, size)
                keys = text_keys(w)
                same = [k for k in range(len(w)) if keys[k] == tids[w.first + k]]
                if same:
                    part = batch.take(pa.array([w.first + k for k in same]))
                    sets = [np.unique(hashes[offsets[k] : offsets[k + 1]]).tobytes() for k in same]
                    yield pa.record_batch([*(part.column(x) for x in ("root", "blocks", "own", "tid")), pa.array(sets, pa.binary())], names=["root", "blocks", "own", "tid", "grams"])

    # Always by merge: the texts then move once, at any size, and no plan depends on a broadcast.
    found = texts.hint("merge").join(parts, F.col("doc_id").eqNullSafe(F.col("first_id"))).select("root", "blocks", "own", "tid", "text")
    found = found.mapInArrow(grams, "root binary, blocks int, own int, tid binary, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = found.select("root", "own", "tid", "grams", other)
    tasks = tasks.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "tid", "grams")
    tasks = tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    results = keep(verify(tasks, threshold), "links")
    same = components(results.filter("b is not null").select("a", "b")).withColumnRenamed("node", "tid")
    counts = results.filter("n is not null").groupBy(F.col("a").alias("tid")).agg(F.sum("n").alias("n_links"))
    known = distinct.select("tid", "first_id", "n_copies").join(same, "tid", "left").join(counts, "tid", "left")
    known = keep(known.withColumn("root", F.coalesce("root", "tid")), "texts")
    least = known.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n"))
    known = spread_join(known, least, "root", known.count()).select("tid", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = rows.select("doc_id", "tid", "n_shingles").join(known, "tid", "left")
    return out.select("doc_id", "tid", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of docs for each class, that of least doc_id, in docs' columns; texts without words all stay.

    Where rows share an id, they stay if the id is the first of a class of theirs, equal texts as one row.
    """
    found = classes(docs, id_col, text_col, **how)
    d = free_name(docs.columns, "d")
    first = found.groupBy("class_id").agg(F.min(F.struct("doc_id", "tid")).alias("first")).select(F.col("first.doc_id").alias(d))
    # By merge, as in classes(): the texts move once at any size.
    marked = docs.hint("merge").join(keep(first.distinct(), "class-firsts"), col(id_col).cast("long").eqNullSafe(col(d)), "left_semi")
    if docs.groupBy(col(id_col)).count().filter("count > 1").isEmpty():
        return marked.select(*[col(c) for c in docs.columns])
    # Rows share an id: of those with the id of a class's first text, equal texts are one row.
    mark, n = (free_name(docs.columns, x) for x in ("k_text", "k_row"))
    words_only = F.trim(F.regexp_replace(whole(col(text_col)), r"[\x20\x09-\x0D]+", " "))
    marked = marked.withColumn(mark, F.md5(words_only))
    w = Window.partitionBy(col(id_col), col(mark)).orderBy(F.xxhash64(whole(col(text_col))))
    marked = marked.withColumn(n, F.row_number().over(w)).filter((col(n) == 1) | (F.length(words_only) == 0))
    return marked.select(*[col(c) for c in docs.columns])
