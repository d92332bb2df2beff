"""Token ids in a compressed binary format with random access to single documents.

Layout of a token store (a folder):

* ``dictionary``: one row with the Zstandard dictionary, its SHA-256, the hash of the
  tokenizer file, the id width in bytes and the end id;
* ``blocks``: rows (part, block, doc_ids, n_tokens, offsets, payload, dict_hash). A
  payload is the concatenation of one Zstandard frame per document, each compressed
  alone with the shared dictionary; offsets has the place of each frame in it. Blocks in
  the order of (part, block) hold the documents in ascending doc_id order.

Spark's committer writes both, so a lost executor leaves no half-written file, and any
file system that Spark reaches will do. A short document is read by its block's row: the
id bounds are in the Parquet statistics, and only its own frame is decompressed.
"""

from __future__ import annotations

import gc
import hashlib
import json
import math
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import small_batches
from .text import col, whole

#: Id that ends each document.
END_ID = 2
#: Bounds of what the dictionary is trained on: documents (the first of a random share) and bytes of each.
SAMPLE_DOCS, SAMPLE_TEXT_BYTES, DICTIONARY_BYTES = 512, 1 << 16, 1 << 16
LEVEL, BLOCK_BYTES, CACHE_WORDS = 3, 1 << 20, 1_000_000
#: Ids that are sampled for each part, to find bounds between parts of like size.
BOUND_SAMPLE = 64
BLOCKS = "part int, block int, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary, dict_hash string"

#: Characters beside a space at which byte-level pre-tokenization always splits: no white space in any definition.
_EDGE = re.compile("[!-~¡-ɏ]")
#: Letters in every version of Unicode: such a word is one pre-token.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")


#: Letters, then marks (no apostrophe, which may begin a contraction), and perhaps the same again on a new line.
_LINES = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)(?:\n([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*))?")


class _UnsureError(Exception):
    """A piece of text that can't be encoded without its neighbours."""


class _Words(dict):
    """The ids of " word" for each word met, as bytes; full, it no longer grows."""

    def __init__(self, tokenizer, dtype: np.dtype):
        super().__init__()
        self.tokenizer, self.dtype, self.merge = tokenizer, dtype, tokenizer.model.tokenize
        # The alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest follows from U+0100.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.symbols = {b: b if b in plain else next(rest) for b in range(256)}
        self.space, self.code = chr(self.symbols[32]), {2: "H", 4: "I"}[dtype.itemsize]
        self.ends = {c: self.encode([c])[0] for c in ",.;:!?"}
        self.marks, self.newline = {"": b"", None: b""}, self.encode(["a\na"])[0][len(self.encode(["a"])[0]) : -len(self.encode(["a"])[0])]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __missing__(self, word: str) -> bytes:
        met = True
        if word.isascii() and word.isalpha():
            # Letters of ASCII are their own symbols.
            ids = array(self.code, [t.id for t in self.merge(self.space + word)]).tobytes()
        elif word[-1:] in self.ends and _LETTERS.fullmatch(word, 0, len(word) - 1):
            met = word[:-1] in self
            ids = self[word[:-1]] + self.ends[word[-1]]
        elif _LETTERS.fullmatch(word):
            ids = self.merged(f" {word}")
        elif m := _LINES.fullmatch(word):
            # Letters, marks and a single line break are a pre-token each.
            met = m[1] in self
            ids = self[m[1]] + self.marked(m[2])
            if m[3]:
                ids += self.newline + self.merged(m[3]) + self.marked(m[4])
        elif word and _EDGE.match(word[0]) and _EDGE.match(word[-1]):
            ids = self.encode([f" {word}"])[0]
        else:
            raise _UnsureError
        if met and len(self) < CACHE_WORDS:
            self[word] = ids
        return ids

    def marked(self, marks: str | None) -> bytes:
        """The ids of a run of marks after letters."""
        ids = self.marks.get(marks)
        if ids is None:
            ids = self.merged(marks)
            if len(self.marks) < 10_000:
                self.marks[marks] = ids
        return ids

    def merged(self, letters: str) -> bytes:
        """The ids of one pre-token."""
        symbols = letters.encode().decode("latin-1").translate(self.symbols)
        return array(self.code, [t.id for t in self.merge(symbols)]).tobytes()

    def first(self, word: str) -> bytes:
        """The ids of a text's first word."""
        return self.merged(word) if _LETTERS.fullmatch(word) else self.encode([word])[0]


def by_words(spec: dict) -> bool:
    """Whether a tokenizer file is one whose texts can be encoded word by word: plain byte-level BPE."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    # Tokens that are cut out before all else must not reach over a space.
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]) for t in spec.get("added_tokens", ()))
    return model.get("type") == "BPE" and plain and not odd and added and not spec.get("normalizer")


class Encoder:
    """Whole texts to ids of a tokenizer of the tokenizers library; of byte-level BPE, each word once.

    Pre-tokenization always starts a token at a single space between two other
    characters, so what lies between such spaces is encoded alone and kept. Pieces at
    whose edge that isn't certain are encoded together with their neighbours.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            self.plain = by_words(json.load(f))
        self.tokenizer = tokenizer
        self.words = _Words(tokenizer, self.dtype) if self.plain else None

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes of self.dtype."""
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        pieces = text.split(" ")
        try:
            if len(pieces) > 1 and not _EDGE.match(pieces[0][-1:]):
                raise _UnsureError
            first = self.words.first(pieces[0])
            return first + b"".join(map(self.words.__getitem__, pieces[1:]))
        except _UnsureError:
            return self._joined(text.split(" "))

    def _joined(self, pieces: list[str]) -> bytes:
        sure = [bool(p and _EDGE.match(p[0]) and _EDGE.match(p[-1])) for p in pieces]
        starts = [0, *(i for i in range(1, len(pieces)) if sure[i] and sure[i - 1])]
        out = []
        for a, b in zip(starts, [*starts[1:], len(pieces)], strict=True):
            out.append(self.words[pieces[a]] if a and b == a + 1 and sure[a] else self.words.encode([" " * (a > 0) + " ".join(pieces[a:b])])[0])
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        # A million kept words would be walked through by every full collection.
        gc.freeze()
        gc.set_threshold(100_000, 50, 1000)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary for the id arrays, from a bounded sample; empty where there is too little to learn from."""
    # Drawn by a hash of the ids, of which some have no text that counts; only the drawn texts are collected.
    drawn = F.xxhash64("doc_id")
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(drawn, "doc_id").limit(2 * SAMPLE_DOCS).collect()
    rows = docs.filter(F.col("doc_id").isin([r[0] for r in ids]) & F.octet_length("text").between(1, SAMPLE_TEXT_BYTES))
    texts = rows.select("text", drawn.alias("drawn"), F.xxhash64("text").alias("same")).orderBy("drawn", "same").limit(SAMPLE_DOCS).collect()
    samples = [encoder(tokenizer_path).encode(r[0]) for r in texts]
    if len(samples) < 16 or sum(map(len, samples)) < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def parts_in_order(rows: DataFrame, n: int) -> Column:
    """A number for each row (doc_id, text) so that smaller numbers hold smaller ids, in about n parts of like size.

    Bounds are quantiles of a sample of the ids, BOUND_SAMPLE for each part, so no text is
    read for them; they are compared as whole numbers, first every k-th and then the k
    that follow, which is exact for any ids and quick for any number of parts. An id that
    is several quantiles at once holds many rows; it is parted by a hash of the text.
    """
    ids = rows.select("doc_id").filter("doc_id is not null")
    total = ids.count() if n > 1 else 0
    share = min(1.0, BOUND_SAMPLE * n / max(total, 1))
    drawn = sorted(r[0] for r in (ids.sample(share, 11) if share < 1 else ids).collect()) if total else []
    bounds = [drawn[k * len(drawn) // n] for k in range(1, n)] if drawn else []
    times = Counter(bounds)
    values = sorted(times)
    step = max(1, math.isqrt(len(values)))
    # A literal that is parsed once: as a column for each bound, thousands of them would take the driver long.
    listed = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>") if v else F.array().cast("array<bigint>")
    d = F.col("doc_id")
    blocks = F.size(F.filter(listed(values[step - 1 :: step]), lambda x: x < d))
    below = blocks * step + F.size(F.filter(F.slice(listed(values), blocks * step + 1, step), lambda x: x < d))
    many = {x: k for x, k in times.items() if k > 1}
    salt = F.lit(0)
    for x, k in many.items():
        salt = F.when(d == x, F.pmod(F.xxhash64("text"), F.lit(k)).cast("int") + 1).otherwise(salt)
    return F.when(d.isNull(), F.lit(-1)).otherwise(below * (max(many.values(), default=0) + 1) + salt).cast("int")


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Write the token store of docs to path.

    Null and empty texts become the end id alone. Null ids come first. Rows that repeat
    an id are documents of their own, in the order of their text's hash. An empty table
    gives a store without blocks. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), whole(col(text_col)).alias("text"))
    data = train_dictionary(rows, tokenizer_path)
    digest = hashlib.sha256(data).hexdigest()
    with open(tokenizer_path, "rb") as f:
        vocabulary = hashlib.sha256(f.read()).hexdigest()
    width = encoder(tokenizer_path).dtype.itemsize
    head = spark.createDataFrame([(digest, bytearray(data), vocabulary, width, end_id)], "dict_hash string, dictionary binary, tokenizer_hash string, id_bytes int, end_id int")
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(data), write_dict_id=False)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        part, block, held, size = None, 0, ([], [], [], []), 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()), ("dict_hash", pa.string())])

        def flush():
            nonlocal block, held, size
            ids, counts, at, frames = held
            known = [x for x in ids if x is not None]
            cols = [[part], [block], [known[0] if known else None], [known[-1] if known else None], [ids], [counts], [at], [b"".join(frames)], [digest]]
            block, held, size = block + 1, ([], [], [], []), 0
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for at, doc, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if at != part:
                    if held[0]:
                        yield flush()
                    part, block = at, 0
                ids = enc.encode(text.as_py())
                frame = pack.compress(ids + end)
                for x, v in zip(held, (doc, (len(ids) + len(end)) // enc.dtype.itemsize, size, frame), strict=True):
                    x.append(v)
                size += len(frame)
                if size >= BLOCK_BYTES:
                    yield flush()
        if held[0]:
            yield flush()

    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", parts_in_order(rows, n)).repartition("part").sortWithinPartitions("part", "doc_id", F.xxhash64("text"))
    rows.mapInArrow(blocks, BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a token store: doc_id, start, n_tokens, ids_crc32 and (with_ids) ids.

    start is the number of ids of all documents before it. doc_ids: only these (None:
    documents without an id), by the blocks that may hold them; an empty list gives no rows.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    data, digest, dtype = bytes(head["dictionary"]), head["dict_hash"], np.dtype(f"<u{head['id_bytes']}")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p"), so_far(Window.orderBy("part")).alias("before"))
    starts = sums.withColumn("here", so_far(Window.partitionBy("part").orderBy("block"))).join(parts, F.col("part") == F.col("p")).select("part", "block", (F.col("before") + F.col("here")).alias("at"))
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        known = wanted - {None}
        has = (F.col("last_id") >= min(known)) & (F.col("first_id") <= max(known)) if known else F.lit(False)
        blocks = blocks.filter(has | F.exists("doc_ids", lambda x: x.isNull()) if None in wanted else has)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dict(data))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError("block was written with another dictionary")
                before, out = 0, ([], [], [], [], [], [], [])
                ends = [*row["offsets"][1:], len(row["payload"])]
                for doc, n, a, b in zip(row["doc_ids"], row["n_tokens"], row["offsets"], ends, strict=True):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(unpack.decompress(row["payload"][a:b]), dtype=dtype).astype("<u4")
                        if len(ids) != n:
                            raise ValueError("frame and index differ")
                        for x, v in zip(out, (row["part"], row["block"], doc, before, n, zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None), strict=True):
                            x.append(v)
                    before += n
                types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["part", "block", "doc_id", "before", "n_tokens", "ids_crc32", "ids"]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    docs = blocks.select("part", "block", "doc_ids", "n_tokens", "offsets", "payload", "dict_hash").mapInArrow(decode, "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long, ids array<long>")
    docs = docs.join(starts, ["part", "block"]).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return docs if with_ids else docs.drop("ids")
