"""Operator 2, BPE encoding and decoding.

Merges run over a doubly linked list of symbols. A heap holds ``(rank, left symbol)`` for every
adjacent pair that the vocabulary can merge; a popped entry is stale, and skipped, when one of
its symbols has been merged since. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from orrery.llm.common import beside_text, text_chunks
from orrery.llm.pieces import PRETOKEN, PieceMemo, packed_ids

KEEP_TOKENS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file (``path``)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.vocab = {t: i for t, i in model["vocab"].items()}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.strings: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            if token not in self.special:
                self.strings[i] = raw(token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = self.vocab[c]
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.tokens: dict[str, bytes] = {}
        self.memo = PieceMemo(self.encode_plain)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        merges, ids = self.merges, [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two symbols is no longer there
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                prev[k] = i
                if m := merges.get((merged, ids[k])):
                    heappush(queue, (m[0], i, merged, ids[k], m[1]))
            h = prev[i]
            if h >= 0 and (m := merges.get((ids[h], merged))):
                heappush(queue, (m[0], h, ids[h], merged, m[1]))
        return [x for x in ids if x >= 0]

    def encode_plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        out, known = [], self.tokens
        for token in PRETOKEN.findall(text):
            packed = known.get(token)
            if packed is None:
                packed = array("I", self.merge(token.encode("utf-8"))).tobytes()
                if len(token) <= 64:
                    if len(known) >= KEEP_TOKENS:
                        known.clear()
                    known[token] = packed
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; special tokens in it keep their id."""
        if self.cut is None or self.cut.search(text) is None:
            return packed_ids(text, self.memo)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [packed_ids(text[at : m.start()], self.memo), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, packed_ids(text[at:], self.memo)])

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return out.decode("utf-8", "replace").encode("utf-8")


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (``ids``, ``decoded`` on demand) to every row.

    Narrow: one pass over the rows, no shuffle, memory bounded by one text plus two memos.
    A null text counts as empty: no ids, the hashes of nothing. Rows are independent, so
    repeated rows give repeated results; an empty table gives an empty result. Columns of
    ``docs`` that bear a result's name, in any case, are replaced.
    """
    more = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    more += [("ids", ArrayType(IntegerType()))] * keep_ids + [("decoded", "string")] * keep_text
    source, kept, held, schema = beside_text(docs, text, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for a, b in text_chunks(batch, held):
                part = batch.slice(a, b - a)
                n, ids_sha, text_sha, ids, back = [], [], [], [], []
                for value in part.column(len(kept)).to_pylist():
                    packed = bpe.encode(value or "")
                    decoded = bpe.decode(packed)
                    n.append(len(packed) // 4)
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                    if keep_ids:
                        ids.append(np.frombuffer(packed, "<i4"))
                    if keep_text:
                        back.append(decoded.decode("utf-8"))
                columns = [part.column(i) for i in range(len(kept))] + [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                columns += [pa.array(ids, pa.list_(pa.int32()))] * keep_ids + [pa.array(back, pa.string())] * keep_text
                yield pa.RecordBatch.from_arrays(columns, [*kept, *[n for n, _ in more]])

    return source.mapInArrow(run, schema)
