"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through WINDOW bytes, most significant digit first; suffixes
still equal after the last digit are exactly the repeated windows. Two things keep a sort
of all suffixes of a corpus small:

* The first digit is GRAM bytes taken not at the suffix's start but at its anchor, the
  least GRAM-byte hash in the window. Equal windows have equal anchors at equal places,
  and the runs of neighbouring windows that share an anchor go through a pass as one row.
* The second digit is the rest of what such a run covers. Runs that are equal through it
  form one group, of which all but the first are repeats as a whole. Only anchors under
  which runs differ need the last digit, which splits them into single windows.

Digits are compared as 64-bit hashes, each within the group of the digit before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, release, small_batches
from .text import col, whole
from .words import mix, raw

#: Length in bytes of what counts as a repeat, and of the first digit.
WINDOW, GRAM = 100, 16
#: Texts are worked on together up to so many bytes.
CHUNK_BYTES = 1 << 18
#: Windows of one text worked on at a time, and the bits that hold a place among them.
SEGMENT, _SEGMENT_BITS = 1 << 23, 24
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Rows that share an id are told apart by their place among them, in the high bits of a position.
PLACE_BITS = 40


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes at each place, by doubling."""
    out, parts, length = _TABLE[data], None, 1
    have = 0
    while True:
        if size & length:
            parts = out if parts is None else parts[: len(data) - have - length + 1] * _power(length) + out[have : len(data) - length + 1]
            have += length
        if have == size:
            return mix(parts[: len(data) - size + 1].copy())
        out = out[: len(out) - length] * _power(length) + out[length:]
        length *= 2


_power_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    if len(_power_tables.get(base, ())) < n:
        table = np.full(max(n, 4 * CHUNK_BYTES), base, dtype=np.uint64)
        table[0] = 1
        _power_tables[base] = np.multiply.accumulate(table, out=table)
    return _power_tables[base][:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows under one anchor: (text, first window, last window, gram hash, run hash).

    Places are within data; windows don't run over the end of their text. Of equal hashes
    in a window the first counts. The run hash is of all bytes that the run covers and of
    where its anchor is in them. Texts beyond SEGMENT windows are worked on in segments,
    which only parts a run in two.
    """
    found = [_anchors(data[k : k + SEGMENT + window - 1], k, at, window, gram) for k in range(0, max(1, len(data) - window + 1), SEGMENT)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, base: int, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h, low_bits = grams(data, gram), np.uint64(_SEGMENT_BITS)
    ranked = (h >> low_bits << low_bits) | np.arange(len(h), dtype=np.uint64)
    least = (sliding_min(ranked, window - gram + 1) & np.uint64((1 << _SEGMENT_BITS) - 1)).astype(np.int64)
    new = np.r_[True, least[1:] != least[:-1]]
    edges = at[(at > base) & (at < base + len(least))] - base
    new[edges] = True
    low = np.flatnonzero(new)
    high = np.r_[low[1:], len(least)] - 1
    text = np.searchsorted(at, low + base, side="right") - 1
    high = np.minimum(high, at[text + 1] - base - window)
    good = high >= low
    text, low, high, spot = text[good], low[good], high[good], least[low[good]]
    return text, low + base, high + base, h[spot], _ranges(data, low, high + window, spot - low)


def _ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], each with extra; equal bytes have equal hashes wherever they are."""
    power, inverse = _powers(len(data) + 1, int(_BASE)), _powers(len(data) + 1, pow(int(_BASE), -1, 1 << 64))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * power[:-1], out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix(value + mix((ends - starts).astype(np.uint64) << np.uint64(20) | extra.astype(np.uint64)))


def _chunks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive texts, up to CHUNK_BYTES or one longer text at a time."""
    k = 0
    while k < len(at) - 1:
        end = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK_BYTES, side="right")) - 1)
        yield k, end
        k = end


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """For rows in order, which is the first with its keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    new[:1] = True
    out = np.zeros(len(order), dtype=bool)
    out[order] = new
    return out


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, place, text); place counts rows that share an id, in the order of their texts."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), whole(col(text_col)).alias("text"))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("place"), "text")
    w = Window.partitionBy("doc_id").orderBy("text")
    return rows.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("place"), "text")


def first_passes(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(gram, doc_id, pos, n, repeat): runs that repeat an earlier one as a whole (repeat true), and
    the first of each run under an anchor that has differing runs (false). A run has n + 1 windows."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column("text"))
            place = batch.column("place").to_numpy(zero_copy_only=False)
            found = []
            for k, end in _chunks(at):
                text, low, high, g, r = anchors(data[at[k] : at[end]], at[k : end + 1] - at[k], window, gram)
                text = text + k
                found.append((text, low + at[k] - at[text], high - low, g, r))
            if not found:
                continue
            text, low, n, g, r = (np.concatenate(x) for x in zip(*found, strict=True))
            # Within the batch, a run that repeats needs no group; it is sent anywhere, with its length below 0.
            ids = batch.column("doc_id")
            order = np.argsort(ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            by = np.lexsort((low, place[text], rank[text]))
            text, low, n, g, r = text[by], low[by], n[by], g[by], r[by]
            first = _first_of(g, r)
            g = np.where(first, g, mix(g + mix((text << np.int64(32)).astype(np.uint64) + low.astype(np.uint64))))
            n = np.where(first, n, -n - 1)
            pos = (place[text] << PLACE_BITS) | low
            yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), ids.take(pa.array(text)), pa.array(pos), pa.array(n.astype(np.int32))], names=["gram", "run", "doc_id", "pos", "n"])

    found = rows.mapInArrow(runs, "gram long, run long, doc_id long, pos long, n int").repartition("gram")
    w = Window.partitionBy("gram").orderBy("run", "doc_id", "pos")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumns({"prev": F.lag("run").over(w), "least": F.first("run").over(every), "most": F.last("run").over(every)})
    known, again = F.col("n") < 0, F.coalesce(F.col("prev") == F.col("run"), F.lit(False))
    out = found.filter(known | again | (F.col("least") != F.col("most")))
    return out.select("gram", "doc_id", "pos", F.when(known, -F.col("n") - 1).otherwise(F.col("n")).alias("n"), (known | again).alias("repeat"))


def last_pass(rows: DataFrame, mixed: DataFrame, window: int) -> DataFrame:
    """(doc_id, pos, n): stretches of windows that repeat an earlier one, under the anchors in mixed."""
    per_doc = mixed.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("gram", "pos", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column("text"))
            place, lists = batch.column("place").to_numpy(zero_copy_only=False), batch.column("runs")
            flat = lists.flatten()
            if not len(flat):
                continue
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            g, pos, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            mine = (pos >> PLACE_BITS) == place[of]
            of, g, pos, n = of[mine], g[mine], pos[mine], n[mine]
            start = at[of] + (pos & ((1 << PLACE_BITS) - 1))
            size = n.astype(np.int64) + window
            offsets = np.r_[0, np.cumsum(size)]
            spots = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[spots])])
            yield pa.record_batch([pa.array(g), batch.column("doc_id").take(pa.array(of)), pa.array(pos), held.cast(pa.binary())], names=["gram", "doc_id", "pos", "held"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def finish(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            data, at = raw_binary(table.column("held").combine_chunks())
            g, pos = (table.column(x).to_numpy() for x in ("gram", "pos"))
            every = grams(data, window)
            n = np.diff(at) - window + 1
            of = np.repeat(np.arange(len(n)), n)
            spots = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            again = ~_first_of(g[of], every[spots])
            step = np.diff(np.r_[0, again.astype(np.int8), 0])
            border = np.flatnonzero(np.diff(of)) + 1
            # Stretches of repeats, cut where the run changes.
            begins, ends = set(np.flatnonzero(step == 1).tolist()), set(np.flatnonzero(step == -1).tolist())
            for k in border.tolist():
                if k and again[k] and again[k - 1]:
                    begins.add(k)
                    ends.add(k)
            begins, ends = np.array(sorted(begins), dtype=np.int64), np.array(sorted(ends), dtype=np.int64)
            owner = of[begins] if len(begins) else np.zeros(0, np.int64)
            first = pos[owner] + spots[begins] - at[owner] if len(begins) else np.zeros(0, np.int64)
            ids = table.column("doc_id").combine_chunks().take(pa.array(owner))
            return pa.record_batch([ids, pa.array(first.astype(np.int64)), pa.array((ends - begins - 1).astype(np.int32))], names=["doc_id", "pos", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("gram").to_numpy()
            # All but the last anchor's rows are complete.
            at = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            if at or (rest and rest[-1].column("gram")[-1].as_py() != g[0]):
                whole_groups = [*rest, batch.slice(0, at)] if at else rest
                yield finish(pa.Table.from_batches(whole_groups))
                rest = []
            rest.append(batch.slice(at))
        if rest:
            yield finish(pa.Table.from_batches(rest))

    texts = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d"))).select("doc_id", "place", "text", "runs")
    pieces = texts.mapInArrow(cut, "gram long, doc_id long, pos long, held binary")
    return pieces.repartition("gram").sortWithinPartitions("gram", "doc_id", "pos").mapInArrow(split, "doc_id long, pos long, n int")


def raw_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of docs.

    spans: the maximal stretches [start, end) of the text's UTF-8 bytes that are covered by
    a string of window bytes which also starts earlier: in a row of smaller doc_id (null
    is the least), or earlier in the same row. kept: the other bytes. Strings are judged on
    the input; null texts are empty; texts shorter than the window keep all. Rows that
    share an id come in the order of their texts. An empty table gives an empty table.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    small_batches(docs.sparkSession)
    rows = placed(docs, id_col, text_col)
    found = keep(first_passes(rows, window, gram), "repeat-runs")
    release(docs.sparkSession)
    again = found.filter("repeat").select("doc_id", "pos", "n")
    again = again.unionByName(last_pass(rows, found.filter("not repeat").select("gram", "doc_id", "pos", "n"), window))
    per_doc = again.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("pos", "n")).alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column("text"))
            place, lists = batch.column("place").to_numpy(zero_copy_only=False), batch.column("runs")
            flat = lists.flatten()
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            pos, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            mine = (pos >> PLACE_BITS) == place[of]
            of, pos, n = of[mine], pos[mine], n[mine]
            start = at[of] + (pos & ((1 << PLACE_BITS) - 1))
            # A window never crosses texts, so the depth of cover at each byte needs no cut between them.
            depth = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(depth, start, 1)
            np.add.at(depth, start + n + window, -1)
            gone = np.cumsum(depth[:-1]) > 0
            step = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            inner = at[1:-1]
            cuts = inner[(inner > 0) & (inner < len(data))]
            cuts = np.unique(cuts[gone[cuts] & gone[cuts - 1]]) if len(cuts) else cuts
            begins, ends = np.sort(np.r_[step[::2], cuts]), np.sort(np.r_[step[1::2], cuts])
            owner = np.searchsorted(at, begins, side="right") - 1
            counts = np.bincount(owner, minlength=len(at) - 1)
            spans = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(begins - at[owner]), pa.array(ends - at[owner])], names=["start", "end"]),
            )
            left = np.r_[0, np.cumsum(~gone)][at]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])])
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), spans, kept.cast(pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    texts = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "place", "text", "runs")
    return texts.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
