"""The bytes that each id of a public tokenizer stands for."""

from __future__ import annotations

import re

#: Sign that stands for a space in sentence pieces.
BLANK = "▁"
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """Character to byte in byte-level BPE: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level BPE of the tokenizers library; added tokens are plain text."""
    of = byte_alphabet()
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = []
    for i in range(tokenizer.get_vocab_size()):
        entry = added.get(i) or tokenizer.id_to_token(i)
        out.append(entry.encode() if i in added or any(c not in of for c in entry) else bytes(of[c] for c in entry))
    return out


def sentence_pieces(model) -> list[bytes]:
    """Bytes of each id of a sentence piece model: its sign for a space, and single bytes by their number."""
    entries = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(m[1], 16)]) if model.is_byte(i) and (m := _BYTE.fullmatch(x)) else x.replace(BLANK, " ").encode() for i, x in enumerate(entries)]
