"""Conversations as token ids with a loss mask.

A conversation is rendered whole, by a template whose marks are tokens of their own, and
encoded once. Ids of byte-level BPE tile the rendered bytes, so the offsets of tokens are
prefix sums of their lengths; each learned turn's span is looked up in them by binary
search, and the tokens between are those under the mask. As marks stand at both ends of
every text, no token reaches over an end.

Rows are dealt by ranges of (conv_id, turn), so a conversation of very many turns spreads
over as many tasks as its size needs, as pieces in order.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, keep
from .text import col, whole
from .vocabulary import byte_level

#: Characters after which a long conversation goes on in another piece, and those encoded together.
PIECE_CHARS, CALL_CHARS = 1 << 20, 1 << 18
FORMATTED = "conv_id long, piece long, ids array<int>, loss array<boolean>"
_READ = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("turns", pa.binary()), ("loss", pa.binary())])
READ = "conv_id long, piece long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns binary, loss binary"
DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


@dataclass(frozen=True)
class Template:
    """Marks of a turn and what texts may not hold as it stands.

    start role middle text end, and a line break. A control string in a role or text gets
    a backslash after its first character, one more than it has there already, which
    unescape() takes away: every string comes back as it was. Control strings are
    <|name|> and those listed; none may hold the first character of another one elsewhere
    than where that can't begin one.
    """

    start: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>"
    controls: tuple[str, ...] = ("<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.start, self.middle, self.end

    @cached_property
    def _control(self) -> re.Pattern:
        named = r"<(\\*)(?=\|[A-Za-z0-9_.-]+\|>)"
        return re.compile("|".join([named, *(rf"{re.escape(c[0])}(\\*)(?={re.escape(c[1:])})" for c in self.controls)]))

    @cached_property
    def _turn(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.start)}(.*?){re.escape(self.middle)}(.*?){re.escape(self.end)}\n", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._control.sub(lambda m: m[0][:1] + m[0][2:], text)

    def turns(self, text: str) -> list[tuple[str, str]]:
        """Roles and texts of a rendered conversation; what isn't one raises."""
        out, at = [], 0
        for m in self._turn.finditer(text):
            if m.start() != at:
                break
            out.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        if at != len(text):
            raise ValueError(f"no turn at character {at}")
        return out


class Coder:
    """A byte-level BPE with the template's marks as tokens of their own; nothing is trained."""

    def __init__(self, path: str, template: Template):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in template.marks])
        self.table = byte_level(self.tokenizer)
        self.sizes = np.array([len(x) for x in self.table])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for ids, text in zip(out, texts, strict=True):
            if self.sizes[ids].sum() != len(text.encode()):
                raise ValueError("the tokenizer's ids do not tile a text")
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode()


_coders: dict[tuple[str, Template], Coder] = {}


def coder(path: str, template: Template) -> Coder:
    """The coder of this Python process."""
    if (path, template) not in _coders:
        _coders[path, template] = Coder(path, template)
    return _coders[path, template]


def mask(ids: np.ndarray, sizes: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet one of the sorted byte spans."""
    ends = np.cumsum(sizes[ids])
    out = np.zeros(len(ids), dtype=bool)
    if spans:
        low, high = np.array(spans).T
        first, last = np.searchsorted(ends, low, side="right"), np.searchsorted(ends - sizes[ids], high, side="left")
        for a, b in zip(first[low < high].tolist(), last[low < high].tolist(), strict=True):
            out[a:b] = True
    return out


def format_turns(rows: DataFrame, tokenizer_path: str, template: Template | None = None) -> DataFrame:
    """(conv_id, piece, ids, loss) of conversations in rows (conv_id, turn, role, text).

    loss marks the ids of learned roles' texts. A conversation has one piece, more only if
    it is longer than PIECE_CHARS or lies across two ranges; its pieces in order, one after
    another, are its ids. Null roles and texts are empty ones; a null turn comes first, rows
    that repeat a turn follow each other by role and text, and rows without conv_id are one
    conversation. A very long text is encoded whole. An empty table gives no rows; other
    columns are not read. The rows of a partition are in the order of (conv_id, piece).
    """
    spark, template = rows.sparkSession, template or Template()
    bounded_batches(spark)
    rows = rows.select(col("conv_id").cast("long").alias("conv_id"), col("turn").cast("long").alias("turn"), whole(col("role")).alias("role"), whole(col("text")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first = coder(tokenizer_path, template), TaskContext.get().partitionId() << 32
        key, open_, piece, size = None, None, 0, 0
        ready: list[tuple[int | None, int, str, list[tuple[int, int]]]] = []
        held = 0

        def close():
            nonlocal open_, size, held
            ready.append((key, first | piece, "".join(open_[0]), open_[1]))
            held += size
            open_, size = None, 0

        def flush() -> pa.RecordBatch:
            nonlocal ready, held
            ids = code.encode([r[2] for r in ready])
            loss = [mask(x, code.sizes, r[3]) for x, r in zip(ids, ready, strict=True)]
            at = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (ids, loss)]
            out = pa.record_batch([pa.array([r[0] for r in ready], pa.int64()), pa.array([r[1] for r in ready], pa.int64()), *lists], names=["conv_id", "piece", "ids", "loss"])
            ready, held = [], 0
            return out

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if open_ is not None and (conv != key or size >= PIECE_CHARS):
                    close()
                    piece = piece + 1 if conv == key else 0
                    if held >= CALL_CHARS:
                        yield flush()
                if open_ is None:
                    key, open_, place = conv, ([], []), 0
                head, body = f"{template.start}{template.escape(role)}{template.middle}", template.escape(text)
                begin = place + len(head.encode())
                place = begin + len(body.encode())
                if role in template.learned:
                    open_[1].append((begin, place))
                place += len(template.end.encode()) + 1
                open_[0].extend((head, body, template.end, "\n"))
                size += len(head) + len(body)
        if open_ is not None:
            close()
        if ready:
            yield flush()

    return rows.mapInArrow(run, FORMATTED)


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer_path: str, template: Template) -> Iterator[tuple]:
    """conv_id, piece, turns, texts under the mask and characters of each row."""
    code = coder(tokenizer_path, template)
    for batch in batches:
        ids, loss = batch.column("ids"), batch.column("loss")
        for k, (conv, piece) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True)):
            x, under = ids[k].values.to_numpy(), loss[k].values.to_numpy(zero_copy_only=False).astype(np.int8)
            edges = np.flatnonzero(np.diff(np.r_[np.int8(0), under, np.int8(0)]))
            texts = [template.unescape(code.decode(x[a:b])) for a, b in edges.reshape(-1, 2)]
            text = code.decode(x)
            yield conv, piece, template.turns(text), texts, len(text)


def read_back(formatted: DataFrame, tokenizer_path: str, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """Digests of conversations, from ids and mask alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is of role, line break, text, line break for each turn, loss_sha256 of all
    texts under the mask. in_order: each partition is sorted by conv_id and piece and no
    piece lies between those of another partition, as format_turns gives them. A
    conversation of one piece inside a partition is read there. The others, those at an
    edge of a partition or in several pieces, are hashed one after another: a digest has no
    other way, but it holds one piece at a time.
    """
    spark, template = formatted.sparkSession, template or Template()
    bounded_batches(spark)
    if not in_order:
        formatted = formatted.repartitionByRange(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "piece").sortWithinPartitions("conv_id", "piece")

    def row(conv, piece, turns, texts, chars, closed):
        told, learned = "".join(f"{r}\n{t}\n" for r, t in turns).encode(), "".join(texts)
        if closed:
            return (conv, piece, len(turns), hashlib.sha256(told).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), chars, None, None)
        return (conv, piece, len(turns), None, len(learned), None, chars, told, learned.encode())

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, alone, out, size = None, False, [], 0
        for item in _pieces(batches, tokenizer_path, template):
            if before is not None:
                same = item[0] == before[0]
                out.append(row(*before, closed=alone and not same))
                size += before[4]
                alone = not same
                if size >= PIECE_CHARS:
                    yield packed(out)
                    out, size = [], 0
            before = item
        if before is not None:
            yield packed([*out, row(*before, closed=False)])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, some = None, None, False
        turns, loss, sums = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        done = []
        for batch in batches:
            for r in batch.to_pylist():
                if some and r["conv_id"] != key:
                    done.append((key, 0, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], None, None))
                    turns, loss, sums = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                key, some = r["conv_id"], True
                turns.update(r["turns"])
                loss.update(r["loss"])
                sums = [a + r[c] for a, c in zip(sums, ("n_turns", "loss_chars", "formatted_chars"), strict=True)]
            if done:
                out, done = packed(done), []
                yield out
        if some:
            yield packed([(key, 0, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], None, None)])

    rows = keep(formatted.mapInArrow(single, READ), "conversations")
    rest = rows.filter("turns is not null").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return rows.filter("turns is null").unionByName(rest.mapInArrow(joined, READ)).select(*DIGEST)
