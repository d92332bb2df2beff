"""Benchmark decontamination by edit distance over words.

A document holds a benchmark item of m words if one of its windows of m words (all of
it, if shorter) is within floor(MAX_EDITS * m) word edits of the item.

1. Which windows can be: that few edits leave a run of equal words in the item, by the
   pigeonhole principle, so only windows lined up with such a run are looked at. This
   loses nothing.
2. CGK embedding: a random walk through the window copies words and moves on by a random
   bit of (step, word), so edit distance becomes Hamming distance to the item's walk.
3. Bit-sampling LSH: a window is a candidate if some sample of steps agrees with the
   item's. Items of like length have walks of their own, added until simulated windows at
   the greatest distance are found with the target recall. The walks' distance grows with
   the square of the edits, so for long items (over LONGEST_WALKED words, or where
   MOST_WALKS don't reach the target) they tell nothing, and every window of step 1 goes on.
4. Candidates are verified exactly, by a bound on common words and then bit-parallel edit
   distance over all windows around the candidate.

Documents are read once and not shuffled. The benchmark is sent in blocks of a bounded
number of words; a larger one takes as many passes as it has blocks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .text import col, count_words, whole
from .words import windows, words

#: Edits for each word of an item.
MAX_EDITS = 0.2
TARGET_RECALL, SAMPLE_STEPS, SAMPLES, MOST_WALKS, LONGEST_WALKED, TRIALS = 0.99, 3, 24, 16, 256, 1200
#: Bound of one block of the benchmark, in words; its index is some 100 bytes a word, and 32 more for each walk of the item's length.
BLOCK_WORDS = 200_000
_BITS = 20


def edits(m: int, rate: float = MAX_EDITS) -> int:
    return int(rate * m + 1e-9)


def seed_size(m: int, rate: float = MAX_EDITS) -> int:
    """Length of a run of equal words that any window near enough has, 3 at most."""
    e = edits(m, rate)
    return min(3, -((e - m) // (e + 1)))


def distance(item: dict[int, int], m: int, window: list[int]) -> int:
    """Edit distance of a window to an item of m words, given as word -> bits of its places."""
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for w in window:
        eq = item.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = (minus | ~(xh | plus)) & full, plus & xh
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1) | 1, down << 1
        plus, minus = (down | ~(xv | up)) & full, up & xv & full
    return score


def walk(text: np.ndarray, at: np.ndarray, ends: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """CGK embeddings of the sequences text[at:ends], one step for each multiplier; 0 past the end."""
    at, out = at.copy(), np.zeros((len(at), len(odds)), dtype=np.uint64)
    for t, odd in enumerate(odds):
        live = at < ends
        w = np.where(live, text[np.minimum(at, len(text) - 1)], np.uint64(0))
        out[:, t] = w
        at += ((w * odd) >> np.uint64(63)).astype(at.dtype) & live
    return out


@dataclass
class Walks:
    """Walks of the items of one class of lengths; narrow: whether they choose candidates."""

    items: np.ndarray
    m: np.ndarray
    walks: list[np.ndarray] = field(default_factory=list)
    samples: list[np.ndarray] = field(default_factory=list)
    walked: list[np.ndarray] = field(default_factory=list)
    narrow: bool = False
    recall: float = 1.0

    def add(self, flat: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> None:
        steps = 2 * int(self.m.max())
        self.walks.append(rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        # Fractions of an item's walk, so that one draw serves items of all lengths.
        self.samples.append(rng.random((SAMPLES, SAMPLE_STEPS)))
        self.walked.append(walk(flat, at[self.items], at[self.items + 1], self.walks[-1]))

    def alike(self, k: int, row: np.ndarray, text: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether some sample of walk k agrees between the windows text[at:ends] and the items of these rows."""
        out = np.zeros(len(row), dtype=bool)
        for low in range(0, len(row), 8192):
            part = slice(low, low + 8192)
            m = self.m[row[part]]
            steps = 2 * int(m.max())
            same = walk(text, at[part], ends[part], self.walks[k][:steps]) == self.walked[k][row[part], :steps]
            rows = np.arange(len(m))
            for sample in self.samples[k]:
                hit = np.ones(len(m), dtype=bool)
                for f in sample:
                    hit &= same[rows, (f * 2 * m).astype(np.int64)]
                out[part] |= hit
        return out


@dataclass
class Index:
    """One block of items, ready to be looked for."""

    ids: list
    texts: list[np.ndarray]
    rate: float = MAX_EDITS
    classes: list[Walks] = field(default_factory=list)

    def __post_init__(self):
        self.m = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.flat = np.concatenate([*self.texts, np.zeros(1, np.uint64)])
        self.at = np.r_[0, np.cumsum(self.m)]
        self.seeds = {}
        found = defaultdict(list)
        for k, t in enumerate(self.texts):
            size = seed_size(len(t), self.rate) if len(t) else 0
            for j, h in enumerate(windows(t, size)) if size else ():
                found[size].append((h, k, j))
        for size, rows in found.items():
            rows.sort()
            h = np.array([r[0] for r in rows], dtype=np.uint64)
            values, first = np.unique(h, return_index=True)
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[(values >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.seeds[size] = (bits, values, np.r_[first, len(rows)], np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64))
        self.places = []
        for t in self.texts:
            bits: dict[int, int] = {}
            for j, w in enumerate(t.tolist()):
                bits[w] = bits.get(w, 0) | 1 << j
            self.places.append(bits)
        self.bags = [Counter(t.tolist()) for t in self.texts]

    def calibrate(self, target: float = TARGET_RECALL) -> None:
        """Give each class of lengths, by powers of two, the walks with which it reaches the target recall.

        Simulated windows are at the greatest distance; half of them are lined up with the
        item, half lie as many words beside it as edits are left to them, and each half must
        reach the target.
        """
        sizes = np.array([int(m).bit_length() for m in self.m])
        self.classes, self.of, self.row = [], np.zeros(len(self.m), dtype=np.int64), np.zeros(len(self.m), dtype=np.int64)
        for size in np.unique(sizes):
            items = np.flatnonzero(sizes == size)
            self.of[items], self.row[items] = len(self.classes), np.arange(len(items))
            self.classes.append(Walks(items, self.m[items]))
            if self.m[items].max() <= LONGEST_WALKED:
                self._calibrate(self.classes[-1], target, np.random.default_rng(11))

    def _calibrate(self, group: Walks, target: float, rng: np.random.Generator) -> None:
        row = rng.integers(0, len(group.items), TRIALS)
        made = []
        for trial, k in enumerate(group.items[row]):
            t = self.texts[k].tolist()
            # Beside the item by s words, a window lacks s of its words and has s others: two edits each.
            beside = int(rng.integers(0, edits(len(t), self.rate) // 2 + 1)) if trial % 2 else 0
            t = [int(w) for w in rng.integers(1, 1 << 62, beside)] + t
            for _ in range(edits(len(self.texts[k]), self.rate) - 2 * beside):
                j, what, w = int(rng.integers(0, len(t))), rng.integers(0, 3), int(rng.integers(1, 1 << 62))
                t = [*t[:j], *([w] if what == 0 else [w, t[j]] if what == 1 else []), *t[j + 1 :]] or [w]
            made.append(np.array(t, dtype=np.uint64)[: len(self.texts[k])])
        text, at = np.concatenate(made), np.r_[0, np.cumsum([len(x) for x in made])]
        found = np.zeros(TRIALS, dtype=bool)
        while len(group.walks) < MOST_WALKS and not group.narrow:
            group.add(self.flat, self.at, rng)
            found |= group.alike(len(group.walks) - 1, row, text, at[:-1], at[1:])
            group.recall = float(min(found[::2].mean(), found[1::2].mean()))
            group.narrow = group.recall >= target
        if not group.narrow:
            group.walks, group.samples, group.walked, group.recall = [], [], [], 1.0

    def search(self, w) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, start) of the nearest window for each text and item within reach."""
        pairs = []
        owner = np.repeat(np.arange(len(w)), np.diff(w.of))
        for size, (bits, values, first, items, places) in self.seeds.items():
            h = windows(w.hashes, size)
            spots = np.flatnonzero(bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            spots = spots[owner[spots] == owner[spots + size - 1]]
            slot = np.minimum(np.searchsorted(values, h[spots]), len(values) - 1)
            met = values[slot] == h[spots]
            spots, slot = spots[met], slot[met]
            n = first[slot + 1] - first[slot]
            rows = np.repeat(first[slot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            spots = np.repeat(spots, n)
            text, item = owner[spots], items[rows]
            low, high = w.of[text], np.maximum(w.of[text], w.of[text + 1] - self.m[item])
            pairs.append(np.stack([text, item, np.clip(spots - places[rows], low, high)], axis=1))
        if not pairs:
            return []
        pairs = np.unique(np.concatenate(pairs), axis=0)
        text, item, start = pairs.T
        ends = np.minimum(start + self.m[item], w.of[text + 1])
        kept = []
        for c, group in enumerate(self.classes):
            left = np.flatnonzero(self.of[item] == c)
            if not group.narrow:
                kept.append(left)
                continue
            for k in range(len(group.walks)):
                if not len(left):
                    break
                hit = group.alike(k, self.row[item[left]], w.hashes, start[left], ends[left])
                kept.append(left[hit])
                left = left[~hit]
        chosen: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k in np.sort(np.concatenate(kept)) if kept else ():
            chosen[int(text[k]), int(item[k])].append(int(start[k]))
        return [(d, i, *best) for (d, i), starts in chosen.items() if (best := self.nearest(w, d, i, starts))]

    def nearest(self, w, doc: int, k: int, starts: list[int]) -> tuple[int, int] | None:
        """(distance, start) of the nearest window around these, the first such; None beyond reach."""
        m, low, end = int(self.m[k]), int(w.of[doc]), int(w.of[doc + 1])
        reach, bag = edits(m, self.rate), self.bags[k]
        best = None
        for s in starts:
            have = Counter(x for x in w.hashes[s : min(s + m, end)].tolist() if x in bag)
            # Moving the window by reach words changes its bag by as many.
            if m - sum((have & bag).values()) > 2 * reach:
                continue
            for a in range(max(low, s - reach), max(low, min(s + reach, end - m)) + 1):
                window = w.hashes[a : min(a + m, end)].tolist()
                short = m - sum((Counter(x for x in window if x in bag) & bag).values())
                if short > reach or best and short > best[0]:
                    continue
                d = distance(self.places[k], m, window)
                if d <= reach and (best is None or (d, a) < best):
                    best = (d, a)
            if best and best[0] == 0:
                break
        return best and (best[0], best[1] - low)


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = MAX_EDITS) -> Iterator[Index]:
    """The benchmark in blocks of about BLOCK_WORDS words, one at a time. Items without words are left out."""
    rows = items.select(col(id_col).cast("long").alias("item_id"), whole(col(text_col)).alias("text"))
    total = rows.agg(F.sum(count_words(F.col("text")))).first()[0] or 0
    n = max(1, -(-total // BLOCK_WORDS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        found = sorted(rows.filter(F.col("block") == k).select("item_id", "text").distinct().collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        ids, texts = [], []
        for w in words(pa.array([r["text"] for r in found], pa.string())):
            for i in range(len(w)):
                if w.of[i + 1] > w.of[i]:
                    ids.append(found[w.first + i]["item_id"])
                    texts.append(w.hashes[w.of[i] : w.of[i + 1]])
        if ids:
            index = Index(ids, texts, rate)
            index.calibrate()
            yield index


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = MAX_EDITS) -> DataFrame:
    """(doc_id, item_id, distance, n_words, start_word) for every row of docs and item it holds.

    distance is that of the nearest window of n_words (the item's) words, start_word the
    first such. Null and empty texts hold nothing; items without words are held by none;
    repeated rows each have their rows; empty tables give an empty table. Very long texts and
    items are looked through whole.
    """
    spark = docs.sparkSession
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), whole(col(text_col)).alias("text"))
    small_batches(spark)
    schema = "doc_id long, item_id long, distance int, n_words int, start_word int"
    out = spark.createDataFrame([], schema)
    for index in indexes(items, rate=rate):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, rows = batch.column("doc_id").to_pylist(), []
                for w in words(batch.column("text")):
                    rows += [(ids[w.first + d], index.ids[i], dist, len(index.texts[i]), start) for d, i, dist, start in index.search(w)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "distance", "n_words", "start_word"])

        out = out.unionByName(texts.mapInArrow(scan, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", rate: float = MAX_EDITS) -> DataFrame:
    """The rows of docs that hold no item, in docs' columns.

    Rows with a null or empty text stay, repeated rows fare alike, an empty table stays
    empty and an empty benchmark drops nothing; columns that are named like an item's don't matter.
    """
    small_batches(docs.sparkSession)
    for index in indexes(items, rate=rate):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        place = [c.lower() for c in docs.columns].index(text_col.lower())

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, dtype=bool)
                for w in words(batch.column(place)):
                    good[[w.first + d for d, *_ in shared.value.search(w)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
