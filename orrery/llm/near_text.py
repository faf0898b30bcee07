"""Operator 7, MinHash near-duplicates with odd sketches.

A document's set of word shingles is sampled by MinHash. Bands of the samples propose pairs; the
samples folded into a parity bitmap, the odd sketch, tell pairs near the threshold from the rest
by the population count of their XOR, and full sets confirm. Documents with equal sets are one
class and enter as their smallest id.

No group is compared with itself whole. A band's bucket is cut into chunks of about ``CHUNK``
members, each with the bucket's first member added; a chunk proposes a spanning forest of its
likeliest pairs. Once those are confirmed, a bucket whose members are all connected is done. In
the few that are left, sketches of the members outside the bucket's largest component are compared
with those of all members. Components that come near each other form a group, in which the full
sets of all but the largest are compared with those of all, chunk by chunk. So no pair that shares
a band is missed, and what is shipped grows with the members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import components, fresh, gram_hashes, mark, materialize, mix64, quoted, settle, text_chunks, utf8, word_hash_pairs, word_spans

BANDS, ROWS = 36, 6
SKETCH_BITS = 1024
CHUNK = 64
#: Pairs whose estimated similarity is this much below the threshold are not confirmed; that is
#: more than four and a half standard errors of the estimate.
SLACK = 0.15

_SEEDS = np.random.default_rng(77)
_A = (_SEEDS.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
_B = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BAND_SALT = _SEEDS.integers(1, 1 << 63, BANDS, dtype=np.uint64)


# ---------------------------------------------------------------- sets and sketches


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, end to end, the other halves of these 128-bit
    hashes, and the n + 1 offsets of the texts.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than ``k`` words has
    its whole sequence as its one shingle, a text without words none.
    """
    data, offsets = utf8(column)
    s, e, at = word_spans(data, offsets)
    halves = word_hash_pairs(data, s, e, True)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    grams = [gram_hashes(w, k) for w in halves]
    ok = np.flatnonzero(doc[: len(grams[0])] == doc[k - 1 :]) if len(grams[0]) else np.zeros(0, np.int64)
    h, g, d = grams[0][ok], grams[1][ok], doc[ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h, g = (np.concatenate([x, *[mix64(gram_hashes(w[at[r] : at[r + 1]], int(count[r])) + np.uint64(0x51ED270B * int(count[r]))) for r in short]]) for x, w in zip((h, g), halves, strict=True))
        d = np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, g, d = h[order], g[order], d[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        h, g, d = h[new], g[new], d[new]
    return h, g, np.searchsorted(d, np.arange(len(count) + 1))


def signatures(h: np.ndarray, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set hashes ``[n, 2]``, band keys ``[n, BANDS]`` and odd sketches ``[n, SKETCH_BITS / 8]`` of non-empty sets."""
    n, begin = len(at) - 1, at[:-1]
    sums = np.column_stack([np.add.reduceat(mix64(h ^ np.uint64(0x1234567)), begin), np.add.reduceat(mix64(g ^ np.uint64(0x7654321ABCDEF)), begin)])
    x = (h >> np.uint64(32)).astype(np.uint32)
    low = np.empty((BANDS * ROWS, n), np.uint32)
    for i in range(BANDS * ROWS):
        low[i] = np.minimum.reduceat(x * _A[i] + _B[i], begin)
    keys = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, _BAND_SALT[b])
        for r in range(ROWS):
            key = mix64(key ^ low[b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, b] = key
    place = mix64(low.astype(np.uint64) + (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(32))[:, None]) % np.uint64(SKETCH_BITS)
    flips = np.bincount((place.astype(np.int64) + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS)
    return sums, keys, np.packbits((flips & 1).astype(np.uint8), axis=1)


def most_differing(similarity: float) -> int:
    """Bits in which the sketches of sets of this similarity differ, as expected."""
    return int(round(SKETCH_BITS / 2 * (1 - np.exp(-4 * BANDS * ROWS * (1 - similarity) / SKETCH_BITS))))


def sign(docs: DataFrame, k: int) -> DataFrame:
    """Written table ``doc_id, n_shingles, s1, s2, bands, sketch``; the last four null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch, "t"):
                part = batch.slice(a, b - a)
                h, g, at = shingle_sets(part.column("t"), k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                s1, s2, bands, sketch = [None] * len(n), [None] * len(n), [None] * len(n), [None] * len(n)
                if len(full):
                    sums, keys, bits = signatures(h, g, np.append(at[full], len(h)))
                    sums, keys = sums.view(np.int64), keys.view(np.int64)
                    for i, r in enumerate(full.tolist()):
                        s1[r], s2[r], bands[r], sketch[r] = int(sums[i, 0]), int(sums[i, 1]), keys[i], bits[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"],
                )

    return materialize(docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"), "signatures")


# ---------------------------------------------------------------- candidates


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups of sorted rows, with the n + 1 offsets of the groups."""
    held: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for key in keys:
            c = np.asarray(t.column(key))
            change[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(change), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        at = bounds(held)
        if len(at) > 2:
            yield held.slice(0, at[-2]).combine_chunks(), at[:-1]
            held = held.slice(at[-2])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), bounds(held)


def _sketches(t: pa.Table) -> np.ndarray:
    raw = t.column("sketch").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), SKETCH_BITS // 64)


def _find(parent: dict, x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(most: int):
    """Of each sorted group the likeliest pairs that connect what its sketches connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, ["key", "sub"]):
            ids, bits = np.asarray(t.column("id")), _sketches(t)
            out_a, out_b = [], []
            size = np.diff(at)
            two = at[:-1][size == 2]
            if len(two):
                near = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1) <= most
                out_a.append(ids[two[near]])
                out_b.append(ids[two[near] + 1])
            for lo, hi in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), strict=True):
                parent: dict[int, int] = {}
                pick_i, pick_j, pick_d = [], [], []
                for i in range(lo, hi - 1):
                    d = np.bitwise_count(bits[i + 1 : hi] ^ bits[i]).sum(axis=1)
                    j = np.flatnonzero(d <= most)
                    pick_i.append(np.full(len(j), i))
                    pick_j.append(j + i + 1)
                    pick_d.append(d[j])
                pi, pj = np.concatenate(pick_i), np.concatenate(pick_j)
                order = np.argsort(np.concatenate(pick_d), kind="stable")
                left = hi - lo - 1
                for i, j in zip(pi[order].tolist(), pj[order].tolist(), strict=True):
                    a, b = _find(parent, i), _find(parent, j)
                    if a != b:
                        parent[a] = b
                        out_a.append(ids[i : i + 1])
                        out_b.append(ids[j : j + 1])
                        left -= 1
                        if not left:
                            break
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _across(most: int):
    """Edges between components of which a member outside a bucket's main one comes near another's
    member by its sketch. A task tells no more of them than connect what it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for t, at in _groups(batches, ["key", "j", "m"]):
            comp, own, bits = np.asarray(t.column("comp")), np.asarray(t.column("own")), _sketches(t)
            out = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                rest = np.flatnonzero(~own[lo:hi]) + lo
                for i in np.flatnonzero(own[lo:hi]) + lo:
                    other = rest[comp[rest] != comp[i]]
                    for c in np.unique(comp[other[np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1) <= most]]).tolist():
                        x, y = _find(parent, int(comp[i])), _find(parent, c)
                        if x != y:
                            parent[x] = y
                            out.append((int(comp[i]), c))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def _links_into(k: int, percent: int, most: int):
    """Of each sorted group (some documents against a chunk) links that connect what its sets connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, ["hyper", "j", "m"]):
            ids, comp, own, bits, text = np.asarray(t.column("id")), np.asarray(t.column("comp")), np.asarray(t.column("own")), _sketches(t), t.column("t")
            out = []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sets: dict[int, np.ndarray] = {}

                def set_of(i: int, sets=sets, text=text) -> np.ndarray:
                    if i not in sets:
                        sets[i] = shingle_sets(text.slice(i, 1), k)[0]
                    return sets[i]

                parent: dict[int, int] = {}
                rest = np.flatnonzero(~own[lo:hi]) + lo
                for i in (np.flatnonzero(own[lo:hi]) + lo).tolist():
                    far = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1)
                    for j in rest[np.argsort(far, kind="stable")[: int((far <= most).sum())]].tolist():
                        if comp[j] == comp[i] or _find(parent, int(comp[i])) == _find(parent, int(comp[j])):
                            continue
                        a, b = set_of(i), set_of(j)
                        shared = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                        if shared and 100 * shared >= percent * (len(a) + len(b) - shared) and linked(text[i].as_py(), text[j].as_py(), k, percent):
                            parent[_find(parent, int(comp[i]))] = _find(parent, int(comp[j]))
                            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _chunk_of(n):
    return F.pmod(F.xxhash64("id", "key"), F.ceil(n / CHUNK)).cast("long")


# ---------------------------------------------------------------- confirmation


def linked(one: str, two: str, k: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of the full shingle sets, word by word: the words
    themselves are compared, not their hashes."""
    ids: dict[bytes, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in t.encode("utf-8").lower().split()], np.int64) for t in (one, two))
    if not len(a) or not len(b):
        return False
    if len(a) < k or len(b) < k:
        return np.array_equal(a, b)
    bits, cut = len(ids).bit_length(), len(a) - k + 1
    x = np.concatenate([a[:cut], b[: len(b) - k + 1]])
    for i in range(1, k):
        y = np.concatenate([a[i : cut + i], b[i : len(b) - k + 1 + i]])
        if bits * (i + 1) > 63:  # ranks instead of packed words
            x = np.unique(x, return_inverse=True)[1]
            x = x << bits | y if len(x).bit_length() + bits <= 63 else np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)[1].ravel()
        else:
            x = x << bits | y
    a, b = np.unique(x[:cut]), np.unique(x[cut:])
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those whose full sets, of ``texts(k, t)``, have 100 * intersection >= percent * union."""
    both = (
        pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a")
        .join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            keep = [linked(ta[i].as_py(), tb[i].as_py(), k, percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents are linked if their sets of ``k``-word shingles have a Jaccard similarity of at
    least ``percent`` / 100; a component is what links reach, named by its smallest id, the one
    document of it that is kept. A text without words, or null, has no shingles and no links.
    Rows with one key are one node with the links of each of their texts; rows without a key link with
    nothing, have no component and are kept. Empty in, empty out.
    """
    since = mark()
    rows = docs.select(quoted(key).cast("long").alias("k"), quoted(text).alias("t"))
    signed = sign(rows, k)
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = materialize(named.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = classes.select("n_shingles", "s1", "s2", F.col("rep").alias("doc_id"))
    reps = materialize(
        named.join(firsts, ["doc_id", "n_shingles", "s1", "s2"], "left_semi").dropDuplicates(["doc_id", "s1", "s2"]).select(F.col("doc_id").alias("id"), "bands", "sketch"),
        "representatives",
    )
    # buckets of more than one member
    entries = reps.select("id", F.explode("bands").alias("key"))
    hot = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last")
    members = materialize(entries.join(hot.drop("last"), "key"), "buckets")
    subs = F.ceil(F.col("n") / CHUNK)
    first = F.when((F.col("id") == F.col("lead")) & (subs > 1), F.sequence(F.lit(0), subs - 1)).otherwise(F.array(_chunk_of(F.col("n"))))
    sketches = reps.select("id", "sketch")
    # ids may repeat where rows share a key: a group's own repetitions are told apart by distinct()
    chunks = members.withColumn("sub", F.explode(first)).select("key", "sub", "id").join(sketches, "id").repartition("key", "sub").sortWithinPartitions("key", "sub", "id").select("key", "sub", "id", "sketch")
    most = most_differing(percent / 100 - SLACK)
    proposed = materialize(chunks.mapInArrow(_forest(most), "a long, b long").where("a <> b").distinct(), "proposed")
    # candidates grow with the corpus: the same sorted join at every size, never a broadcast
    ids = members.select(F.col("id").alias("k")).distinct().hint("merge")
    texts = materialize(rows.join(ids, "k", "left_semi").withColumn("h", F.xxhash64("t")).dropDuplicates(["k", "h"]).drop("h"), "candidates")
    links = materialize(confirm(proposed, texts, k, percent), "links")
    comps = materialize(components(links), "components")

    # buckets that are not one component yet
    labelled = members.select("key", "id").join(comps.select("id", F.col("component_id").alias("c")), "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c")
    labelled = materialize(labelled, "labelled")
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    left = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    left = left.select("key", "n", F.col("main.comp").alias("main"), (F.col("n") - F.col("main.n")).alias("outside"))
    left = materialize(labelled.join(left, "key").join(sketches, "id"), "left-over")
    n_all, n_out = F.ceil(F.col("n") / CHUNK), F.ceil(F.col("outside") / CHUNK)
    every = left.withColumn("j", _chunk_of(F.col("n"))).withColumn("m", F.explode(F.sequence(F.lit(0), n_out - 1))).withColumn("own", F.lit(False))
    outside = left.where("comp <> main").withColumn("m", _chunk_of(F.col("outside"))).withColumn("j", F.explode(F.sequence(F.lit(0), n_all - 1))).withColumn("own", F.lit(True))
    cols = ["key", "j", "m", "id", "comp", "own", "sketch"]
    both = every.select(*cols).unionByName(outside.select(*cols)).repartition("key", "j", "m").sortWithinPartitions("key", "j", "m", "own", "id")
    near = materialize(both.mapInArrow(_across(most), "a long, b long").distinct(), "near")
    hypers = materialize(components(near).select(F.col("id").alias("comp"), F.col("component_id").alias("hyper")), "hypers")
    placed = texts.join(comps.select(F.col("id").alias("k"), F.col("component_id").alias("c")), "k", "left").select(F.col("k").alias("id"), F.coalesce("c", "k").alias("comp"), "t")
    placed = materialize(placed.join(hypers, "comp").join(sketches, "id"), "placed")
    per = placed.groupBy("hyper", "comp").agg(F.count("*").alias("n"))
    sizes = per.groupBy("hyper").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main")).select("hyper", "n", F.col("main.comp").alias("main"), (F.col("n") - F.col("main.n")).alias("outside"))
    placed = placed.join(sizes, "hyper")
    part = lambda c: F.pmod(F.xxhash64("id"), F.ceil(F.col(c) / CHUNK)).cast("long")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(c) / CHUNK).cast("long") - 1)
    every = placed.withColumn("j", part("n")).withColumn("m", F.explode(upto("outside"))).withColumn("own", F.lit(False))
    mine = placed.where("comp <> main").withColumn("m", part("outside")).withColumn("j", F.explode(upto("n"))).withColumn("own", F.lit(True))
    cols = ["hyper", "j", "m", "id", "comp", "own", "sketch", "t"]
    against = every.select(*cols).unionByName(mine.select(*cols)).repartition("hyper", "j", "m").sortWithinPartitions("hyper", "j", "m", "own", "id")
    extra = materialize(against.mapInArrow(_links_into(k, percent, most), "a long, b long").distinct(), "links")
    if not extra.isEmpty():
        comps = materialize(components(links.unionByName(extra)), "components")
    return settle(_label(signed, classes, comps), since, "near-duplicates")


def _label(signed: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """Carry the classes' components to their documents."""
    by_class = classes.join(comps, classes["rep"] == comps["id"], "left").select("n_shingles", "s1", "s2", F.coalesce("component_id", "rep").alias("c"))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(by_class, ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every component of ``near_duplicates``: that of the smallest id.

    Of rows with one key one stays, that of the least text hash; rows without a key all stay.
    """
    names = docs.columns
    one, hashed, least = fresh(names, "id", "hash", "least")
    found = near_duplicates(docs, k, percent, key, text)
    same = quoted(key).cast("long") == F.col(one)
    out = docs.join(found.where("not kept").select(F.col("doc_id").alias(one)).distinct().hint("merge"), same, "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(one))
    if again.isEmpty():
        return out
    many = out.join(again, same, "left_semi").withColumn(hashed, F.xxhash64(quoted(text)))
    first = many.groupBy(quoted(key).cast("long").alias(one)).agg(F.min(hashed).alias(least))
    many = many.join(first, same).where(F.col(hashed).eqNullSafe(F.col(least))).dropDuplicates([one]).select(*[quoted(c) for c in names])
    return out.join(again, same, "left_anti").unionByName(many)
