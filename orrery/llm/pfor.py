"""Operator 9, token ids as patched frame-of-reference files.

A file image holds blocks of 128 ids. Of each block the minimum is subtracted; the differences
are packed at the width that the 90th percentile of them needs, and those that need more are
patched from a list of (position, difference). Block starts are indexed, so one document is read
without unpacking the rest. Images are at most ``SEGMENT_IDS`` ids (or one document) long and are
kept as rows of a Parquet table, whose writer commits whole tasks on any store that Spark knows;
``unpack`` and ``read_document`` need nothing but the image.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import CHUNK_BYTES, lanes, materialize, quoted, text_chunks, utf8, word_hashes

MAGIC, BLOCK = b"PFORIDS1", 128
SEGMENT_IDS = 4 << 20
PERCENTILE = 0.90
_HEAD = struct.Struct("<8sQQQQQ")


# ---------------------------------------------------------------- the file format


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that unsigned values below 2**32 need."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """File image of the concatenated ``ids`` of documents with ``lengths``."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    need = _bits(diff)
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    top = need.max(axis=1) if blocks else np.zeros(0, np.uint8)
    width = np.partition(need, at, axis=1)[:, at] if blocks else top
    over = need > width[:, None]
    dear = over.sum(axis=1) * 5 > (top.astype(np.int64) - width) * (BLOCK // 8)  # patches cost more than they save
    width = np.where(dear, top, width)
    over[dear] = False
    starts = np.zeros(blocks + 1, np.uint64)
    np.cumsum(width.astype(np.uint64) * (BLOCK // 32), out=starts[1:])
    words = np.zeros(int(starts[-1]), np.uint32)
    kept = np.where(over, 0, diff)
    for w in np.unique(width):
        w = int(w)
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        value, out = kept[rows].T.astype(np.uint64), np.zeros((w * BLOCK // 32 + 1, len(rows)), np.uint64)
        for i in range(BLOCK):
            word, off = divmod(i * w, 32)
            shifted = value[i] << np.uint64(off)
            out[word] |= shifted & np.uint64(0xFFFFFFFF)
            if off + w > 32:
                out[word + 1] |= shifted >> np.uint64(32)
        words[starts[rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 32)] = out[:-1].T
    row, position = np.nonzero(over)
    patches = np.searchsorted(row, np.arange(blocks + 1)).astype(np.uint32)
    return b"".join(
        [
            _HEAD.pack(MAGIC, len(lengths), n, blocks, len(words), len(row)),
            np.asarray(lengths, np.uint32).tobytes(),
            low.tobytes(),
            width.astype(np.uint8).tobytes(),
            starts.tobytes(),
            patches.tobytes(),
            words.tobytes(),
            position.astype(np.uint8).tobytes(),
            diff[over].tobytes(),
        ]
    )


class Image:
    """Reader of a file image."""

    def __init__(self, image: bytes):
        magic, docs, self.n, self.blocks, words, patches = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        self.lengths = take("<u4", docs)
        self.low, self.width = take("<u4", self.blocks), take("u1", self.blocks)
        self.starts, self.patches = take("<u8", self.blocks + 1), take("<u4", self.blocks + 1)
        self.words, self.position, self.value = take("<u4", words), take("u1", patches), take("<u4", patches)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last - 1``."""
        width, low = self.width[first:last], self.low[first:last]
        out = np.zeros((len(width), BLOCK), np.uint32)
        for w in np.unique(width):
            w = int(w)
            if not w:
                continue
            rows = np.flatnonzero(width == w)
            packed = self.words[self.starts[first + rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 32)].T.astype(np.uint64)
            packed, mask = np.vstack([packed, np.zeros((1, len(rows)), np.uint64)]), np.uint64((1 << w) - 1)
            values = np.empty((BLOCK, len(rows)), np.uint32)
            for i in range(BLOCK):
                word, off = divmod(i * w, 32)
                v = packed[word] >> np.uint64(off)
                if off + w > 32:
                    v = v | packed[word + 1] << np.uint64(32 - off)
                values[i] = v & mask
            out[rows] = values.T
        a, b = int(self.patches[first]), int(self.patches[last])
        block = np.repeat(np.arange(len(width)), np.diff(self.patches[first : last + 1]))
        out[block, self.position[a:b]] = self.value[a:b]
        return (out + low[:, None]).reshape(-1)[: self.n - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document alone."""
        a = int(self.lengths[:k].sum(dtype=np.int64))
        b = a + int(self.lengths[k])
        first, last = a // BLOCK, -(-b // BLOCK)
        return self.read(first, last)[a - first * BLOCK : b - first * BLOCK]


def unpack(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a file image, and the documents' lengths."""
    x = Image(image)
    return x.read(0, x.blocks), x.lengths


# ---------------------------------------------------------------- encoding with the library

_LETTER, _SIGN, _BREAK, _SOLID = (np.zeros(256, bool) for _ in range(4))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_BREAK[9:14] = True
_SOLID[33:127] = True
_DOUBT = np.zeros(256, bool)  # white space, or the lead of a character that may be
_DOUBT[[*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_SOLID[[0xC3, *range(0xC4, 0xE1), *range(0xE4, 0xF0)]] = True  # leads of no white space


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that each unit has the ids that it has in its text.

    Cuts fall only on edges of pre-tokens: before a space that something solid follows, between
    letters and signs (an apostrophe may join what follows it and is no sign here), and around a
    single line break. Bytes in doubt are never cut at.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        begin = begin[:n]
        late = np.zeros(n, bool)  # second byte of a Latin letter
        late[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter = _LETTER[data] | late
        letter[:-1] |= late[1:]
        sign, brk = _SIGN[data], _BREAK[data]
        plain = letter | sign
        # "previous" is nothing at a text's beginning
        before = lambda x: np.concatenate([[False], x[:-1]]) & ~begin
        cut[: n - 1] |= (data[:-1] == 32) & _SOLID[data[1:]] & ~begin[1:]
        was_letter, was_sign = before(letter), before(sign)
        cut[:n] |= was_letter & sign | was_sign & letter | (was_letter | was_sign) & brk
        alone = brk & before(plain)
        cut[:n] |= before(alone) & plain
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut[:n])


def same_bytes(data: np.ndarray, starts: np.ndarray, size: np.ndarray, like: np.ndarray) -> bool:
    """Whether each unit has the bytes of the unit ``like`` names."""
    if (size != size[like]).any():
        return False
    eight, rows, at = lanes(data), np.flatnonzero(like != np.arange(len(starts))), 0
    while len(rows):
        one, two = eight[starts[rows] + at], eight[starts[like[rows]] + at]
        rest = np.minimum(size[rows] - at, 8).astype(np.uint64)
        if ((one ^ two) << (np.uint64(64) - np.uint64(8) * rest)).any():
            return False
        at += 8
        rows = rows[size[rows] > at]
    return True


class LibraryEncoder:
    """The tokenizers library behind a memo of units; unseen units go to it many at a time."""

    KEEP = 1_500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content.encode("utf-8") for t in self.lib.get_added_tokens_decoder().values()]
        size = 1 + max(self.lib.get_vocab().values())
        #: bytes that each id stands for: one a character of a byte-level vocabulary
        self.bytes = np.zeros(size, np.int64)
        for token, i in self.lib.get_vocab().items():
            self.bytes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.index: dict[int | bytes, int] = {}  # a unit, or its up to seven bytes and size as a number -> its place in begin
        self.begin = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32) if text else np.zeros(0, np.uint32)

    def _keep(self, keys: list[int | bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lengths) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[self.n : self.n + len(lengths) + 1] = self.used + np.concatenate([[0], np.cumsum(lengths)])
        self.index.update(zip(keys, range(self.n, self.n + len(keys)), strict=True))
        self.n, self.used = self.n + len(lengths), self.used + len(ids)

    def learn(self, keys: list[int | bytes], raw: bytes, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Ids of unseen units. Those without white space, but for one space in front, are put one
        after the other into one text for the library, behind a line feed where they have no space;
        they part where the bytes of its ids reach a unit's end. Others are encoded one by one."""
        blank = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_DOUBT[data], out=blank[1:])
        spaced = (data[s] == 32) & (e - s > 1)
        many = blank[e] == blank[s + spaced]
        rows = np.flatnonzero(many)
        if len(rows):
            lead = ~spaced[rows]
            ends = np.cumsum(e[rows] - s[rows] + lead)
            text = b"".join([raw[x:y] if z else b"\n" + raw[x:y] for x, y, z in zip(s[rows].tolist(), e[rows].tolist(), spaced[rows].tolist(), strict=True)])
            ids = self.whole(text.decode("utf-8"))
            at = np.concatenate([[0], np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1])
            kept = np.ones(len(ids), bool)
            kept[at[:-1][lead]] = False
            self._keep([keys[i] for i in rows.tolist()], ids[kept], np.diff(at) - lead)
        for i in np.flatnonzero(~many).tolist():
            ids = self.whole(raw[s[i] : e[i]].decode("utf-8"))
            self._keep([keys[i]], ids, np.array([len(ids)]))

    def one_by_one(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.whole(raw[a:b].decode("utf-8")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (their bytes and n + 1 offsets), and how many each has."""
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            return self.one_by_one(raw, offsets)
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        hashes = word_hashes(data, starts, ends, False)
        order = np.argsort(hashes)
        new_key = np.ones(len(order), bool)
        np.not_equal(hashes[order[1:]], hashes[order[:-1]], out=new_key[1:])
        first, inverse = order[new_key], np.empty(len(order), np.int32)
        inverse[order] = np.cumsum(new_key, dtype=np.int32) - 1
        if not same_bytes(data, starts, size, first[inverse].astype(np.int64)):  # two units share a hash
            return self.one_by_one(raw, offsets)
        # units themselves are looked up: short ones as numbers, with their size in the upper byte
        lane = lanes(data)[starts[first]] & np.uint64(0xFFFFFFFFFFFFFF) >> (np.uint64(8) * np.maximum(7 - size[first], 0).astype(np.uint64))
        keys = (lane | size[first].astype(np.uint64) << np.uint64(56)).tolist()
        for i in np.flatnonzero(size[first] > 7).tolist():
            keys[i] = raw[starts[first[i]] : ends[first[i]]]
        found = list(map(self.index.get, keys))
        if None in found:
            new = [i for i, x in enumerate(found) if x is None]
            if self.n + len(new) > self.KEEP:
                self.forget()
                new = range(len(keys))
            at = first[np.array(new)]
            self.learn([keys[i] for i in new], raw, data, starts[at], ends[at])
            for i in new:
                found[i] = self.index[keys[i]]
        known = np.array(found)
        begin, count = self.begin[known][inverse], (self.begin[known + 1] - self.begin[known])[inverse]
        total = np.cumsum(count, dtype=np.int32)
        ids = self.ids[np.repeat(begin - total + count, count) + np.arange(total[-1], dtype=np.int32)]
        upto = np.concatenate([[0], total])[np.searchsorted(starts, offsets)]
        return ids, np.diff(upto)


@cache
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# ---------------------------------------------------------------- the operator


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` in ascending order of ``key`` into file images; returns the written table.

    Rows: ``shard`` (its ranges of keys ascend), ``segment``, ``base`` (ids before it in its
    shard), ``n_ids``, ``keys`` (of its documents, in order), ``image``. One range shuffle of the
    texts; a task holds one segment. Null texts are empty (just the end id), null keys come
    first, repeated keys stand together in order of their texts' hashes.
    """
    schema = "shard int, segment int, base long, n_ids long, keys array<long>, image binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library(tokenizer), TaskContext.get().partitionId()
        keys, parts, counts, held, segment, base = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            image = pack(ids, np.concatenate(counts))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([base], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([image], pa.binary())],
                ["shard", "segment", "base", "n_ids", "keys", "image"],
            )

        for batch in batches:
            for a, b in text_chunks(batch, "t", 2 * CHUNK_BYTES):
                part = batch.slice(a, b - a)
                ids, count = encoder.encode(*utf8(part.column("t")))
                with_end = np.full(len(ids) + len(count), end_id, np.uint32)
                kept = np.ones(len(with_end), bool)
                kept[np.cumsum(count + 1) - 1] = False
                with_end[kept] = ids
                keys += part.column("k").to_pylist()
                parts.append(with_end)
                counts.append(count + 1)
                held += len(with_end)
                if held >= SEGMENT_IDS:
                    yield flush()
                    segment, base, held, keys, parts, counts = segment + 1, base + held, 0, [], [], []
        if parts:
            yield flush()

    ordered = (
        docs.select(quoted(key).cast("long").alias("k"), quoted(text).alias("t"))
        .withColumn("h", F.xxhash64("t"))
        .repartitionByRange("k", "h")
        .sortWithinPartitions("k", "h")
        .select("k", "t")
    )
    return materialize(ordered.mapInArrow(run, schema), "token-ids")


def read_documents(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the written images.

    ``start`` counts the ids of all documents before it. Of the corpus only one total a shard
    comes to the driver; shards are as many as the write had tasks.
    """
    totals = {r["shard"]: r["n"] for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for shard in sorted(totals):
        before[shard] = total
        total += totals[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = unpack(batch.column("image")[i].as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                raw, base = memoryview(ids.astype("<u4").tobytes()), before[batch.column("shard")[i].as_py()] + batch.column("base")[i].as_py()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column("keys")[i].as_py(), pa.int64()), pa.array(starts + base, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
