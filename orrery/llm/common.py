"""Shared plumbing of the corpus operators: batches of texts, word hashing, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from orrery.storage import drop, mark, materialize, settle

__all__ = ["drop", "mark", "materialize", "settle"]

#: Bytes of text that one numpy step works on; temporaries take about 60 bytes for each.
CHUNK_BYTES = 1 << 20


# ---------------------------------------------------------------- batches and words


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, nulls as empty, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the n + 1 word offsets of the rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Keys of the two halves of a word's hash: constants of no meaning, the same everywhere.
_KEYS = np.random.default_rng(20240607).integers(1, 1 << 63, 6, dtype=np.uint64) | np.uint64(1)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LANE_BYTES = 256


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, np.uint64, padded, 0, (1,))


def _chained(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, halves: tuple[int, ...]) -> list[np.ndarray]:
    data = _LOWER[data] if lower else data
    eight, size = lanes(data), ends - starts
    out = []
    for half in halves:
        h = size.astype(np.uint64) * _KEYS[half] + _KEYS[half + 2]
        out.append(h)
    rows, at, left = np.flatnonzero(size <= LANE_BYTES), starts, size
    while len(rows):
        lane = eight[at[rows]] & _LOW[np.minimum(left[rows], 8)]
        for h, half in zip(out, halves, strict=True):
            h[rows] = mix64((h[rows] ^ lane) * _KEYS[half + 4])
        rows = rows[left[rows] > 8]
        at, left = at + 8, left - 8
    long = np.flatnonzero(size > LANE_BYTES)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        for r in long.tolist():
            both = np.frombuffer(xxhash.xxh3_128_digest(raw[starts[r] : ends[r]]), np.uint64)
            for h, half in zip(out, halves, strict=True):
                h[r] = both[half] ^ _KEYS[half]
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the words, eight bytes a step through a keyed mixer, no polynomial. Words of
    one length up to eight bytes never share one."""
    return _chained(data, starts, ends, lower, (0,))[0] if len(starts) else np.zeros(0, np.uint64)


def word_hash_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of a 128-bit hash; the first is that of ``word_hashes``."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    one, two = _chained(data, starts, ends, lower, (0, 1))
    return one, two


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` neighbouring words; one for each start that has k words.

    Runs of twice the length are mixed from two shorter ones, at last from two that overlap.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    both = lambda x, y: mix64((mix64(x) ^ _KEYS[0]) * _KEYS[1] + y)
    run, size = words, 1
    while 2 * size <= k:
        run, size = both(run[:-size], run[size:]), 2 * size
    return both(run[:n], run[k - size : k - size + n]) if size < k else mix64(run[:n] + np.uint64(k))


# ---------------------------------------------------------------- columns


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], *stems: str) -> list[str]:
    """Names like ``stems`` that differ from each other and from all of ``taken``, in whatever case."""
    used, out = {t.lower() for t in taken}, []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in used:
            n += 1
            name = f"{stem}_{n}"
        used.add(name.lower())
        out.append(name)
    return out


def beside_text(docs: DataFrame, text: str, results: list[tuple[str, str | DataType]], drop_text: bool = False) -> tuple[DataFrame, list[str], str, StructType]:
    """What an operator that adds ``results`` (name, type) to rows reads and returns.

    The rows, columns numbered, with the text once more, last; the columns that stay, which are
    those that bear no result's name in any case; the name of that text; the result's schema.
    """
    replaced = {n.lower() for n, _ in results} | ({text.lower()} if drop_text else set())
    kept = [c for c in docs.columns if c.lower() not in replaced]
    (held,) = fresh([f"c{n}" for n in range(len(kept))], "text")
    rows = docs.select(*[quoted(c) for c in kept])
    schema = StructType(list(rows.schema.fields))
    for name, kind in results:
        schema.add(name, kind)
    # numbered: mapInArrow asks for columns by name, and takes a point in one for a field
    source = docs.select(*[quoted(c).alias(f"c{n}") for n, c in enumerate(kept)], quoted(text).cast("string").alias(held))
    return source, kept, held, schema


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component_id)`` of every node of ``edges(a, b)``: the smallest id it can reach.

    Alternating large-star and small-star rounds; each is two aggregations and two joins on
    node ids, so a hub is pre-aggregated on the map side and its join is split by AQE.
    """
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    state = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.distinct()
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            low.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        step = materialize(small, "edges")
        drop(e)
        e = step
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )

