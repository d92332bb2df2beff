"""Token alignment, filter audit and chat formatting against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxelspark.llm import chat, filter_audit, token_alignment
from voxelspark.llm.vocabulary import byte_alphabet, byte_level

from .data import SCHEMA, documents, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["<|endoftext|> and </s><s> <unk>", "▁x y", "a▁ b", "  two  spaces ", "\n\nlines\n  in\n", "😀é中 ́a ﬁ", "don't 'tis x's", "\t\x0b\x0c", "\x00\x01 z", "a", " ", "x" * 90 + " y", "1 234 5,6", "¡no! ÄÖ"]


def rows_of(docs):
    return sorted(map(tuple, docs.collect()), key=repr)


# --- token alignment


def brute_alignment(docs: list[tuple]) -> list[tuple]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    letters = byte_alphabet()

    def spans(tokens):
        out, at = [], 0
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def of_piece(i):
        x = s.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if s.is_byte(i) else x.replace("▁", " ").encode()

    found, pairs = [], Counter()
    for doc, text in docs:
        a, b = [], []
        if text:
            a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(f" {text}", add_special_tokens=False).ids]
            b = [(i, of_piece(i)) for i in s.encode(text)]
            if any(b"".join(x[1] for x in y) != f" {text}".encode() for y in (a, b)):
                a, b = [], []
        a, b = spans(a), spans(b)
        links, j = [], 0
        for i, low, high in a:
            while j < len(b) and b[j][2] <= low:
                j += 1
            k = j
            while k < len(b) and b[k][1] < high:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(x[0]) for x in y if low < x[2] <= high) for y in (a, b)))
        pairs.update(links)
        found.append((doc, a, b, links, groups))
    most = {}
    for (_, i), n in pairs.items():
        most[i] = max(most.get(i, 0), n)
    return [
        (doc, len(a), len(b), len(groups), len(links), sum(pairs[x] == most[x[1]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for doc, a, b, links, groups in found
    ]


def test_alignment(spark):
    rng = random.Random(5)
    docs = [(d, x) for d, x, *_ in documents()] + [(2000 + k, x) for k, x in enumerate(ODD)] + [(2000, ODD[0]), (3000, prose(rng, 3000) + "  " + prose(rng, 9) * 40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"a": F.lit(1), "pair": F.lit("x"), "chunk": F.lit(0)})
    want = sorted(brute_alignment(docs), key=repr)
    got = token_alignment.align(table.repartition(3), BYTES, PIECES)
    assert got.columns == [c.split()[0] for c in token_alignment.RESULT.split(", ")]
    assert rows_of(got) == want
    assert sum(w[1] == 0 for w in want) == 4


def test_alignment_of_nothing(spark):
    schema = "doc_id long, text string"
    assert token_alignment.align(spark.createDataFrame([], schema), BYTES, PIECES).collect() == []
    got = token_alignment.align(spark.createDataFrame([(None, None), (1, "")], schema), BYTES, PIECES)
    assert rows_of(got) == sorted([(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")], key=repr)


def test_alignment_of_tables_in_parts(monkeypatch):
    """Tables are joined in parts that end at common ends, chunks forget earlier ones: always the same figures."""
    rng = random.Random(2)
    texts = [prose(rng, 400), "", "x", prose(rng, 900), "😀" * 300, "a▁ b", prose(rng, 5), "中文 " * 200 + "  " + "\n\n".join(map(str, range(500)))]
    both = token_alignment.Pair(BYTES, PIECES)
    one = both.chunk(texts)
    again = both.chunk(texts)
    monkeypatch.setattr(token_alignment, "TABLE_BYTES", 200)
    monkeypatch.setattr(token_alignment, "KEPT", 0)
    cut = both.chunk(texts)
    for other in (again, cut):
        assert all(list(one[name]) == list(other[name]) for name in one)
    both.forget()
    whole = both.chunk(texts[:1] * 3 + texts[:1])
    assert list(whole["total"]) == [4 * x for x in both.chunk(texts[:1])["total"]]
    ends = [both.sizes[0][[1] * 3000].cumsum()] * 2
    assert len(list(both.cuts(ends))) > 2


def test_single_words_are_cut_where_certain(monkeypatch):
    """Texts that are encoded whole give the figures of those cut at spaces."""
    rng = random.Random(9)
    alphabet = ["a", "the", " ", " ", "\n", "é", "😀", "1", ".", "'s", "ing", "Ab", "中", "  ", "\u00a0", "-"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    both = token_alignment.Pair(BYTES, PIECES)
    one = both.chunk(texts)
    assert both.cut and len(both.number) > 400
    both.forget()
    both.cut = False
    whole = both.chunk(texts)
    for name in ("n_a", "n_b", "n_groups", "n_links", "sha", "a", "b", "total"):
        assert list(one[name]) == list(whole[name]), name


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "two")], "doc_id long, text string")
    counts = token_alignment.pair_counts(token_alignment.chunks(docs, BYTES, PIECES)).collect()
    assert counts and sum(r["count"] for r in counts) == sum(r["n_links"] for r in token_alignment.align(docs, BYTES, PIECES).collect())
    by_b = {}
    for r in counts:
        by_b.setdefault(r["b"], []).append(r)
    assert all(r["best"] == (r["count"] == max(x["count"] for x in rows)) for rows in by_b.values() for r in rows)


# --- filter audit


def brute_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    first = {}
    for doc, text, *_ in docs:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    good, toxic = ({d for d, *x in labels if x[k] == 1} for k in (0, 1))
    parts = {}
    for doc, text, _, source, *_ in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if doc is not None and doc > first[text] else set()
        parts.setdefault(source or "", []).append((fails, doc in good, doc in toxic))
    out = []
    for part, rows in parts.items():
        shapley, some = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = list(range(len(rows)))
            for step, f in enumerate(order, 1):
                here = [k for k in left if f in rows[k][0]]
                gone = set(range(len(rows))) - set(left)
                left = [k for k in left if f not in rows[k][0]]
                shapley[f] += len(here)
                some.append([part, "".join(order), step, len(left), len(here), sum(f in rows[k][0] for k in gone), sum(r[0] == {f} for r in rows), sum(rows[k][1] for k in here), sum(rows[k][2] for k in here), f])
        out += [(*r[:-1], shapley[r[-1]]) for r in some]
    return out


def audit_rows():
    docs = documents(3, 60) + [(5000 + k, "SHOUT " * 60, "en", "src1", 1) for k in range(30)] + [(6000 + k, None, "en", None, 1) for k in range(5)] + [(7000, prose(random.Random(1), 80).replace("b", "B"), "en", "", 1)]
    labels = [(d[0], k % 2, (k // 2) % 3 == 0) for k, d in enumerate(docs) if k % 3]
    labels = [(a, b, int(c)) for a, b, c in labels] + [(3, 1, None), (3, 1, 1), (None, 1, 1), (99_999, 1, 1), (5001, None, None)]
    return docs, labels


def test_audit(spark):
    docs, labels = audit_rows()
    table = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit(1) for c in ("part", "mask", "same", "least", "n", "good")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filter_audit.audit(table.repartition(3), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = brute_audit(docs, labels)
    assert rows_of(got) == sorted(want, key=repr)
    assert len(want) == 600 * len({d[3] or "" for d in docs})


def test_audit_of_nothing_and_long_texts(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), marks).collect() == []
    docs = [(1, "w " * 300_000, "en", "a", 1), (2, " ".join(map(str, range(100_000))), "en", "a", 1)]
    got = filter_audit.audit(spark.createDataFrame(docs, SCHEMA), marks)
    assert rows_of(got) == sorted(brute_audit(docs, []), key=repr)


def test_audit_of_other_filters(spark):
    """Two filters of one's own: four cells, two orders, shares of 2 and 1."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "ab"), (4, "c"), (5, "ab")], "doc_id long, text string").withColumn("source", F.lit("s"))
    own = lambda text: {"X": text.contains("a"), "Y": text.contains("b")}
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), own)
    want = [("s", "XY", 1, 2, 3, 0, 1, 0, 0, 4), ("s", "XY", 2, 1, 1, 2, 1, 0, 0, 4), ("s", "YX", 1, 2, 3, 0, 1, 0, 0, 4), ("s", "YX", 2, 1, 1, 2, 1, 0, 0, 4)]
    assert rows_of(got) == sorted(want, key=repr)


# --- chat formatting

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "<\\|end|>", "<\\\\/s>", "<", "<|end|", "[", "[INST", "\\", "<<SYS>> a <</SYS>>", "<|endoftext|>", "<<|end|>>", "<|a<|b|>c|>", "\n", "", "é😀́", "<\\<SYS>>", "[[INST]]", "<|end|><|end|>", "|end|>", "/s>", "text|>"]


def brute_chat(rows: list[tuple]) -> list[tuple]:
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = sorted(turns)
        told = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return out


def chat_rows():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "a<|text|>\nb"]), rng.choice([*NASTY, prose(rng, 20), None])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"{NASTY[t % len(NASTY)]} {t}") for t in range(400)]
    rows += [(None, 0, "assistant", "no id"), (None, None, "user", "x"), (7, 0, "assistant", "again"), (7, 0, "assistant", "again"), (200, 0, "assistant", prose(rng, 40_000))]
    return rows


def test_escapes_are_reversible():
    t, rng = chat.Template(), random.Random(8)
    parts = ["<", "\\", "|end|>", "[", "INST]", "/INST]", "/s>", "s>", "<SYS>>", "</SYS>>", "|", ">", "a", "\n", "|turn|>", "unk>", "pad>"]
    for text in [*NASTY, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000))]:
        safe = t.escape(text)
        assert t.unescape(safe) == text
        assert not any(c in safe for c in (*t.marks, *t.controls, "<|endoftext|>"))


@pytest.mark.parametrize("in_order", [True, False])
def test_chat(spark, in_order, monkeypatch):
    rows = chat_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "piece": F.lit("x")})
    monkeypatch.setattr(chat, "PIECE_CHARS", 2000)
    out = chat.format_turns(table.repartition(3), BYTES)
    if not in_order:
        out = out.repartition(5)
    got = chat.read_back(out, BYTES, in_order=in_order)
    assert got.columns == chat.DIGEST
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=repr) == sorted(brute_chat(rows), key=repr)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got.collect())


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(empty, BYTES), BYTES).collect() == []


def test_masked_ids_are_those_between_marks():
    t, code = chat.Template(), chat.coder(BYTES, chat.Template())
    head, body = f"{t.start}assistant{t.middle}", t.escape("</s> ünï 😀")
    text = f"{head}{body}{t.end}\n"
    [ids] = code.encode([text])
    assert code.tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text
    a = len(head.encode())
    under = chat.mask(ids, code.sizes, [(a, a + len(body.encode()))])
    assert code.decode(ids[under]) == body and code.table[ids[under.argmax() - 1]] == t.middle.encode()
    assert not chat.mask(ids, code.sizes, [(a, a)]).any() and byte_level(code.tokenizer) == code.table
