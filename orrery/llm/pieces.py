"""Cutting texts into pieces that a byte-level BPE vocabulary encodes independently.

A byte-level pre-tokenizer never joins what stands before a space to a non-space that follows
it, so a text may be cut in front of every such space; equal pieces have equal ids. Invented or
natural, text repeats its pieces, and a bounded memo of them does most of the work.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

#: White space as the pre-tokenizer's engine understands it (Unicode White_Space).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Each white-space character behind a space: the usual texts have none of these pairs.
_SPACE_THEN_WHITE = [f" {c}" for c in map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
#: Pre-tokens of a byte-level vocabulary; merges stay inside one.
PRETOKEN = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
_STARTS_WHITE = regex.compile(f"[{WHITE}]").match
#: Pieces of more characters are encoded but not kept.
KEEP_CHARS, KEEP_PIECES = 64, 300_000


def split_pieces(text: str) -> list[str]:
    """Pieces of ``text``; every piece but the first has lost the one space in front of it."""
    parts = text.split(" ")
    if not any(x in text for x in _SPACE_THEN_WHITE) and text[-1:] != " ":
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if not p or _STARTS_WHITE(p):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


class PieceMemo(dict):
    """piece without its space -> packed ids of ``" " + piece``; emptied when it is full."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        packed = self.encode(" " + piece)
        if len(piece) <= KEEP_CHARS:
            if len(self) >= KEEP_PIECES:
                self.clear()
            self[piece] = packed
        return packed


def packed_ids(text: str, memo: PieceMemo) -> bytes:
    """Little-endian unsigned 32-bit ids of ``text``."""
    parts = split_pieces(text)
    get = memo.__getitem__
    return memo.encode(parts[0]) + b"".join(map(get, parts[1:])) if len(parts) > 1 else memo.encode(parts[0])
