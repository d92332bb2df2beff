"""Small documents with what the driver's tables hold: copies, near copies, junk, nulls, repeats."""

from __future__ import annotations

import random

WORDS = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu", "me", "nor") for b in ("ra", "si", "ten", "vu") for c in ("x", "n", "st", "la", "por")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars); the last few are edge cases."""
    rng = random.Random(seed)
    rows, texts = [], [prose(rng, rng.randint(55, 220)) for _ in range(n // 2)]
    for k in range(n):
        kind, text = k % 5, texts[k % len(texts)]
        if kind == 1:
            words = text.split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        elif kind == 2:
            text = prose(rng, 80) + "\n" + texts[0][:260] + "\n" + prose(rng, 60)
        elif kind == 3:
            text = " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in prose(rng, 90).split(" "))
        elif kind == 4:
            text = prose(rng, 120)
        rows.append((k, text, "en", f"src{k % 3}" if k % 7 else None, len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "src0", 0), (1002, " \n\t ", "en", "src1", 4), (None, texts[0], "en", "src9", 1), (3, rows[3][1], "en", "src0", 1), (3, rows[3][1], "en", "src0", 1), (4, prose(rng, 70), "en", "src2", 1), (1003, "one two", "en", "src2", 7), (1004, "é中😀 " * 200, "xx", "src1", 800)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
