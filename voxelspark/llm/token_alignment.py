"""How the tokens of two tokenizers lie over each other, and which ids stand for each other.

Texts of an Arrow partition are taken in chunks of bounded size. In DuckDB a chunk is two
tables of token intervals over one line of bytes: ends that both share, counted by a window
sum, number the groups; ASOF joins give each token the other tokenizer's token at its
start, which are all overlaps, as two overlapping tokens begin at the start of one of them.
Each distinct stretch between spaces is in them once. A chunk keeps its pairs of ids once
each, with partial counts; stretches refer to them by number, and documents to stretches. Spark adds the partial counts up and deals the sums back to the chunks, so
what is shuffled is one row for each pair and chunk, however frequent a pair is.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bounded_batches, keep
from .text import col, whole
from .token_output import _EDGE, by_words
from .vocabulary import BLANK, byte_level, sentence_pieces

#: Characters of text of a chunk, of which one has more only if a single text has; of a table in DuckDB (bytes); and of what is encoded together.
CHUNK_CHARS, TABLE_BYTES, CALL_CHARS = 1 << 20, 1 << 19, 1 << 14
#: Distinct stretches, and their characters, after which those of earlier chunks are forgotten.
KEPT, KEPT_CHARS = 120_000, 1 << 22
DUCKDB = {"threads": 1, "memory_limit": "128MB"}
#: Rows of a chunk: its documents (k null), with numbers and counts of their pairs, and its pairs (k their number).
CHUNKS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, sha string, pair array<int>, n array<int>, k int, a int, b int, total long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

#: A word at whose ends both tokenizers begin a token, if single spaces part it from others like it.
_SURE = re.compile(f"{_EDGE.pattern}(?:.*{_EDGE.pattern})?", re.DOTALL)
#: Links by document and pair, one number: a token of A with the token of B at its start, and a token of B that begins inside one of A.
_LINKS = """
SELECT link, count(*) AS n FROM (
  SELECT (a.doc::BIGINT << 32) + a.id::BIGINT * {width} + b.id AS link FROM a ASOF JOIN b ON a.s >= b.s
  UNION ALL
  SELECT (b.doc::BIGINT << 32) + a.id::BIGINT * {width} + b.id FROM b ASOF JOIN a ON b.s > a.s WHERE b.s < a.e
) GROUP BY link"""
#: For each token of A, the number of common ends before its own.
_GROUPS = """
SELECT coalesce(sum(shared) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM (SELECT a.e AS e, CASE WHEN b.e IS NULL THEN 0 ELSE 1 END AS shared FROM a LEFT JOIN b ON b.e = a.e) ORDER BY e"""


class Pair:
    """Both tokenizers, the bytes of their ids, and an open DuckDB.

    A text is cut at single spaces at which both tokenizers begin a token whatever stands
    around them, so that a stretch between is encoded, and joined, once for a whole chunk.
    Where that isn't certain a stretch goes on, to the end of the text at most.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        tables = self.tables = byte_level(self.a), sentence_pieces(self.b)
        self.sizes = [np.array([len(x) for x in t], dtype=np.int64) for t in tables]
        if len(tables[0]) * len(tables[1]) > 1 << 32:
            raise ValueError("vocabularies of more than 2^32 pairs")
        # Plain byte-level BPE, and a model that leaves every character as it is and has no piece with a space after another character.
        with open(path_a, encoding="utf-8") as f:
            plain = by_words(json.load(f))
        odd = self.b.normalize("ﬁ ①  Å ") != f"{BLANK}ﬁ{BLANK}①{BLANK}{BLANK}Å{BLANK}"
        self.cut = plain and not odd and not any(b" " in x.lstrip(b" ") for x in tables[1])
        # Decimal ids of A and B, each followed by a comma and by what ends its side of a group.
        self.told = [f"{i}{end}".encode() for t, ends in zip(tables, (",|", ",;"), strict=True) for end in ends for i in range(len(t))]
        self.con = duckdb.connect(config=DUCKDB)
        self.forget()

    def forget(self) -> None:
        """Start with no stretches. They have numbers; figures and groups of each, and its links from first[k] to first[k + 1].

        A word that is certain at both ends, wherever it stands, is its own key; others have a space before them.
        """
        self.number: dict[str, int] = {}
        self.new: list[str] = []
        self.chars, self.groups = 0, []
        self.figures = np.zeros((4, 0), dtype=np.int32)
        self.first, self.pair, self.times = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)

    def stretches(self, text: str) -> list[str]:
        if not self.cut:
            return [text]
        pieces, out, start = text.split(" "), [], 0
        for k in range(1, len(pieces)):
            if pieces[k - 1] and pieces[k] and _EDGE.match(pieces[k - 1][-1]) and _EDGE.match(pieces[k][0]):
                out.append(" ".join(pieces[start:k]))
                start = k
        return [*out, " ".join(pieces[start:])]

    def of(self, key: str) -> int:
        k = self.number.get(key)
        if k is None:
            k = self.number[key] = len(self.number)
            self.new.append(key)
        return k

    def numbered(self, text: str) -> np.ndarray:
        """A text as numbers of stretches; the empty text has none."""
        pieces = text.split(" ") if text else []
        out = list(map(self.number.get, pieces))
        if None in out:
            for k in [k for k, x in enumerate(out) if x is None]:
                x = pieces[k]
                if x not in self.number and not (self.cut and _SURE.fullmatch(x)):
                    out = [self.of(y if self.cut and _SURE.fullmatch(y) and " " not in y else f" {y}") for y in self.stretches(text)]
                    break
                out[k] = self.of(x)
        return np.array(out, dtype=np.int32)

    def encode(self, stretches: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For both tokenizers the ids of a space and each stretch (as keys), one after another, and how many each has.

        A stretch whose bytes one of them doesn't give back has none.
        """
        ids: list[list[np.ndarray]] = [[], []]
        counts: list[list[np.ndarray]] = [[], []]
        for whole, run in groupby(stretches, key=lambda x: x[:1] == " "):
            for some in _calls(run):
                # Words that are certain at both ends are one text.
                texts = some if whole else [f" {' '.join(some)}"]
                found = [[e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([x[1:] for x in texts])]
                ends = np.cumsum([len(x.encode()) + (not whole) for x in some])
                each = []
                for k in (0, 1):
                    x = np.array(list(chain.from_iterable(found[k])), dtype=np.int32)
                    same = b"".join(map(self.tables[k].__getitem__, x.tolist())) == "".join(texts).encode()
                    at = np.cumsum(self.sizes[k][x])
                    last = np.searchsorted(at, ends)
                    each.append((x, np.diff(np.r_[0, last + 1])) if same and (at[last] == ends).all() else None)
                if None in each and len(some) > 1:
                    for y in some:
                        for k, (x, n) in enumerate(zip(*self.encode([y]), strict=True)):
                            ids[k].append(x)
                            counts[k].append(n)
                    continue
                for k in (0, 1):
                    x, n = each[k] if None not in each else (np.zeros(0, np.int32), np.zeros(1, np.int64))
                    ids[k].append(x)
                    counts[k].append(n)
        return [np.concatenate(x) for x in ids], [np.concatenate(x) for x in counts]

    def learn(self) -> None:
        """Align the new stretches."""
        new, self.new = self.new, []
        if not new:
            return
        ids, counts = self.encode(new)
        m = len(new)
        self.chars += sum(map(len, new))
        groups, told, found = np.zeros(m, dtype=np.int64), [b""] * m, []
        ends = [np.cumsum(s[i]) for s, i in zip(self.sizes, ids, strict=True)]
        docs = [np.repeat(np.arange(m), c) for c in counts]
        for low, high in self.cuts(ends):
            spans = [slice(*np.searchsorted(e, (low, high), side="right")) for e in ends]
            part = [[x[s] for x, s in zip(y, spans, strict=True)] for y in (ids, ends, docs)]
            link, times, *group = self.section(part[0], [e - low for e in part[1]], part[2])
            found.append((link, times))
            groups += np.bincount(part[2][0][np.r_[group[0][1:] != group[0][:-1], True]], minlength=m)
            at = np.r_[0, np.cumsum(np.bincount(part[2][0], minlength=m) + np.bincount(part[2][1], minlength=m))].tolist()
            shown = list(map(self.told.__getitem__, self.symbols(part[0], group).tolist()))
            for k in range(int(part[2][0][0]), int(part[2][0][-1]) + 1):
                told[k] += b"".join(shown[at[k] : at[k + 1]])
        link, times = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in range(2))
        link, same = np.unique(link, return_inverse=True)
        times = np.bincount(same, weights=times, minlength=len(link)).astype(np.int32)
        links = np.bincount(link >> 32, weights=times, minlength=m).astype(np.int64)
        self.groups += told
        self.figures = np.concatenate([self.figures, np.stack([*counts, groups, links]).astype(np.int32)], axis=1)
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(np.bincount(link >> 32, minlength=m))]
        self.pair, self.times = np.r_[self.pair, (link & 0xFFFFFFFF).astype(np.uint32)], np.r_[self.times, times]

    def section(self, ids: list[np.ndarray], ends: list[np.ndarray], docs: list[np.ndarray]):
        """Links (document and pair in one number) with their counts, and the groups, from 0, of all tokens.

        The tokens of A and B start and end together; ends count from their start.
        """
        for name, i, e, d, size in zip("ab", ids, ends, docs, self.sizes, strict=True):
            self.con.register(name, pa.table({"id": i, "s": (e - size[i]).astype(np.int32), "e": e.astype(np.int32), "doc": d.astype(np.int32)}))
        links = self.con.sql(_LINKS.format(width=len(self.tables[1]))).fetchnumpy()
        a = self.con.sql(_GROUPS).fetchnumpy()["g"]
        return links["link"], links["n"], a, np.searchsorted(ends[0][np.r_[a[1:] != a[:-1], True]], ends[1])

    def symbols(self, ids: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
        """Numbers in told of all groups' ids: those of A, then those of B, group by group."""
        a, b = (len(t) for t in self.tables)
        n = int(groups[0][-1]) + 1
        counts = [np.bincount(g, minlength=n) for g in groups]
        out = np.empty(len(ids[0]) + len(ids[1]), dtype=np.int64)
        last = [np.r_[g[1:] != g[:-1], True] for g in groups]
        # A's tokens come after B's of the groups before, B's after A's of their own group too.
        out[np.arange(len(ids[0])) + (np.cumsum(counts[1]) - counts[1])[groups[0]]] = ids[0] + a * last[0]
        out[np.arange(len(ids[1])) + np.cumsum(counts[0])[groups[1]]] = 2 * a + ids[1] + b * last[1]
        return out

    def chunk(self, texts: list[str]) -> dict:
        """Figures of each text, its pairs as numbers with counts, from at[k] to at[k + 1], and the chunk's pairs with theirs."""
        if len(self.number) > KEPT or self.chars > KEPT_CHARS:
            self.forget()
        n = len(texts)
        seen = [self.numbered(x) for x in texts]
        self.learn()
        bad = self.figures[0] == 0
        seen = [x if not bad[x].any() else x[:0] for x in seen]
        # Each document's stretches once, with how often they occur, then its pairs, numbered anew within the chunk.
        of, often = np.unique((np.repeat(np.arange(n), [len(x) for x in seen]) << 32) | np.concatenate(seen).astype(np.int64), return_counts=True)
        doc, stretch = of >> 32, of & 0xFFFFFFFF
        total = lambda x: np.bincount(doc, weights=often * x[stretch], minlength=n).astype(np.int64)
        many = self.first[stretch + 1] - self.first[stretch]
        rows = np.repeat(self.first[stretch] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs, number = np.unique(self.pair[rows], return_inverse=True)
        times = self.times[rows] * np.repeat(often, many)
        own, same = np.unique((np.repeat(doc, many) << 32) | number, return_inverse=True)
        return {
            "n_a": total(self.figures[0]),
            "n_b": total(self.figures[1]),
            "n_groups": total(self.figures[2]),
            "n_links": total(self.figures[3]),
            "sha": [hashlib.sha256(b"".join(map(self.groups.__getitem__, x.tolist()))[:-1]).hexdigest() if len(x) else "" for x in seen],
            "at": np.r_[0, np.cumsum(np.bincount(own >> 32, minlength=n))],
            "pair": own & 0xFFFFFFFF,
            "n": np.bincount(same, weights=times, minlength=len(own)).astype(np.int64),
            "a": pairs // len(self.tables[1]),
            "b": pairs % len(self.tables[1]),
            "total": np.bincount(number, weights=times, minlength=len(pairs)).astype(np.int64),
        }

    def cuts(self, ends: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Stretches of bytes (after low, up to high) of about TABLE_BYTES that begin and end at ends of both."""
        low, total = 0, int(ends[0][-1]) if len(ends[0]) else 0
        while low < total:
            high = total
            if total - low > 2 * TABLE_BYTES:
                # The last common end up to there, or else the first one after it.
                a = ends[0][np.searchsorted(ends[0], low, side="right") : np.searchsorted(ends[0], low + TABLE_BYTES, side="right")]
                b = ends[1][np.searchsorted(ends[1], low, side="right") : np.searchsorted(ends[1], low + TABLE_BYTES, side="right")]
                same = np.intersect1d(a, b, assume_unique=True)
                high = int(same[-1]) if len(same) else int(np.intersect1d(ends[0][ends[0] > low], ends[1][ends[1] > low], assume_unique=True)[0])
            yield low, high
            low = high


def _calls(stretches: Iterator[str]) -> Iterator[list[str]]:
    """Stretches in lists of about CALL_CHARS characters."""
    some, size = [], 0
    for x in stretches:
        some.append(x)
        size += len(x)
        if size >= CALL_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """Both tokenizers in this Python process."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
        # What is kept would be walked through by every full collection.
        gc.freeze()
        gc.set_threshold(100_000, 50, 1000)
    return _pairs[path_a, path_b]


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents and pairs of all chunks of docs (doc_id, text), written to the shared folder.

    path_a is a byte-level BPE of the tokenizers library, to which a space and the text are
    given, path_b a sentence piece model, which puts the space there itself. Strings of
    special tokens in a text are plain text. Null and empty texts, and those that one of
    both doesn't give back byte for byte, have no tokens. A very long text is a chunk of
    its own. Repeated rows count each; an empty table gives no chunk; other columns aren't
    read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), whole(col("text")).alias("text"))
    kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(c.split()[0], kind[c.split()[1]]) for c in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = pair_of(path_a, path_b), TaskContext.get().partitionId() << 32

        def batch_of(size: int, columns: dict) -> pa.RecordBatch:
            arrays = [columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema]
            return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

        def packed(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            x, n = both.chunk(texts), len(texts)
            at = pa.array(x["at"], pa.int32())
            lists = {c: pa.ListArray.from_arrays(at, pa.array(x[c], pa.int32())) for c in ("pair", "n")}
            yield batch_of(n, {"chunk": np.full(n, number), "doc_id": ids, **{c: x[c] for c in ("n_a", "n_b", "n_groups", "n_links", "sha")}, **lists})
            m = len(x["a"])
            yield batch_of(m, {"chunk": np.full(m, number), "k": np.arange(m), **{c: x[c] for c in ("a", "b", "total")}})
            number += 1

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1])
                if size >= CHUNK_CHARS:
                    yield from packed(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from packed(ids, texts)

    return keep(rows.mapInArrow(run, CHUNKS), "aligned")


def pair_counts(parts: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each pair of ids in all chunks, best where no pair of b has more."""
    counts = parts.filter("k is not null").groupBy("a", "b").agg(F.sum("total").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def documents(parts: DataFrame) -> DataFrame:
    """One row for each document of the chunks: tokens, groups, links and what the pairs' counts in all chunks say of its links."""
    fields = [f.split() for f in RESULT.split(", ")]
    pairs = parts.filter("k is not null").select("chunk", "k", "a", "b").join(pair_counts(parts), ["a", "b"]).select(F.col("chunk").alias("of"), "k", "count", "best")
    docs = parts.filter("k is null").drop("k", "a", "b", "total")

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        """A chunk's documents with sums over their pairs."""
        docs = docs.combine_chunks()
        of = {c: np.zeros(pairs.num_rows, dtype=np.int64) for c in ("count", "best")}
        for c, x in of.items():
            x[pairs["k"].to_numpy()] = pairs[c].to_numpy()
        lists = [docs[c].combine_chunks() for c in ("pair", "n")]
        pair, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        at = np.r_[0, np.cumsum(lists[0].value_lengths().to_numpy())]
        out = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": docs["sha"]}
        for c, name in (("n_best", "best"), ("count_sum", "count")):
            sums = np.r_[0, np.cumsum(n * of[name][pair])]
            out[c] = pa.array(sums[at[1:]] - sums[at[:-1]], pa.int64())
        return pa.table({c: out[c] for c, _ in fields})

    return docs.groupBy("chunk").cogroup(pairs.groupBy("of")).applyInArrow(run, RESULT)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """documents() of all chunks of docs."""
    return documents(chunks(docs, path_a, path_b))
