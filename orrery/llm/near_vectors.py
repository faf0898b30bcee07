"""Operator 1, near-duplicate embeddings by sorted projection passes.

Each pass draws random hyperplanes, concatenates the signs of a vector's projections into one
key, sorts all vectors by it and compares each with the next ``WINDOW`` in that order. Pairs of
cosine at least ``threshold`` link; the links of all passes are united. Vectors of one direction
are one class and enter once.

How many passes a vector takes follows from the density measured around it. Two vectors at the
threshold share the first ``k`` signs with a known probability, wherever they lie; so a pass whose
first ``k`` signs leave a vector with the window and its own component alone finds each of its
pairs with that probability. A vector is done when its passes together reach ``recall``; the
others, as those of a crowded direction, take further passes, and once comparing all of them with
each other costs less than these, or passes no longer separate them, they are compared so in tiles.

Links are then counted exactly within each component: members within half the threshold's angle
of the component's first vector are all linked with each other and are counted, not enumerated;
the other members, usually few, are compared with every member in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import components, mark, materialize, quoted, settle
from orrery.llm.near_text import _groups

THRESHOLD, RECALL, WINDOW = 0.9, 0.97, 32
BLOCK = 256
#: Rows of a tile where all are compared with all. Comparisons that cost about as much as one pass
#: of a row. Passes of one round, at most.
TILE, PASS_WORTH, ROUND = 4096, 2048, 64
#: Probabilities of missing a pair are summed as integers: their negative logarithms, times this.
UNIT = 1_000_000
#: Keeps what is inferred from angles clear of rounding.
MARGIN = 1e-6


def passes(rows: int, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW) -> int:
    """How many sorted orders find a pair at the threshold with probability ``recall`` if keys are spread evenly."""
    same = 1 - math.acos(threshold) / math.pi
    once = same ** max(0.0, math.log2(max(2, rows) / window))
    return max(2, math.ceil(math.log(1 - recall) / math.log1p(-min(once, 0.999))))


def needed(recall: float) -> int:
    """What the passes of a vector must add up to."""
    return math.ceil(-math.log1p(-recall) * UNIT)


def credits(threshold: float, recall: float) -> np.ndarray:
    """What a pass adds whose first ``k`` signs leave a vector with what it was compared with, for k from 0 to 64 (never)."""
    found = (1 - math.acos(threshold) / math.pi) ** np.arange(1, 64)
    return np.array([needed(recall), *np.floor(-np.log1p(-found) * UNIT).astype(np.int64).tolist(), 0], np.int64)


def depths(keys: np.ndarray, comps: np.ndarray, where: np.ndarray, window: int) -> np.ndarray:
    """How many signs leave each of the sorted rows with its window and its component alone.

    64 where no number does, or where it is not seen, at the ends of what was sorted; 0 where the
    whole group ``where`` lies in the window.
    """
    m = len(keys)

    def shared(keys: np.ndarray, comps: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Signs shared with the first row after the window that is of another component; -1: none, 64: not seen."""
        ends = np.append(np.flatnonzero((np.diff(comps) != 0) | (np.diff(where) != 0)) + 1, m)
        i = np.arange(m)
        at = np.minimum(i + window + 1, m)
        inside = np.flatnonzero(at < m)
        same = inside[(comps[at[inside]] == comps[inside]) & (where[at[inside]] == where[inside])]
        at[same] = ends[np.searchsorted(ends, at[same], side="right")]
        # the row after the end of a run may be of the same component again: that only counts too little
        out = np.full(m, 64)
        seen = np.flatnonzero(at < m)
        x = keys[seen] ^ keys[at[seen]]
        high = x >> 31
        out[seen] = 63 - np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp((x & 0x7FFFFFFF).astype(np.float64))[1])
        out[seen[where[at[seen]] != where[seen]]] = -1
        last = np.flatnonzero(at == m)
        out[last[where[last] != where[-1]]] = -1
        return out

    ahead, back = shared(keys, comps, where), shared(keys[::-1], comps[::-1], where[::-1])[::-1]
    return np.minimum(np.maximum(ahead, back) + 1, 64)


@cache
def planes(dim: int, n: int, first: int = 0) -> np.ndarray:
    """Normals of the 63 hyperplanes of ``n`` passes, ``[dim, n * 63]``; other ones for each ``first``."""
    return np.random.default_rng([19, dim, first] if first else [19, dim]).standard_normal((n * 63, dim)).T.copy()


def sort_keys(x: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """``[rows, n]`` keys of unit vectors; the first sign is the highest bit."""
    bits = (x @ planes(x.shape[1], n, first) > 0).reshape(len(x), n, 63)
    return bits @ (np.int64(1) << np.arange(62, -1, -1, dtype=np.int64))


def _unit(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def unit_vectors(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """Written table ``id, dim, cls, unit``: the direction in doubles and its hash, null for
    vectors that are null, empty, zero or hold null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cls, unit = [], [], []
            for x in batch.column("x"):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = np.asarray(x.values, dtype=np.float64)
                    top = np.abs(v).max()
                    v = v / top if np.isfinite(top) and top > 0 and np.isfinite(v).all() else None
                if v is None:
                    dims.append(None), cls.append(None), unit.append(None)
                    continue
                raw = (v / np.linalg.norm(v) + 0.0).tobytes()  # + 0.0: no negative zeros
                dims.append(len(v)), cls.append(xxhash.xxh3_128_digest(raw)), unit.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(dims, pa.int32()), pa.array(cls, pa.binary()), pa.array(unit, pa.binary())], ["id", "dim", "cls", "unit"])

    rows = vectors.select(quoted(key).cast("long").alias("id"), quoted(embedding).alias("x"))
    return materialize(rows.mapInArrow(run, "id long, dim int, cls binary, unit binary"), "vectors")


def sorted_pass_links(rows: DataFrame, n: int, threshold: float, window: int = WINDOW, recall: float = RECALL, first: int = 0) -> DataFrame:
    """Of ``n`` passes over ``id, dim, unit, comp``: ``a, b``, distinct verified links that connect what
    the windows connect; and ``a, null, credit``, what the passes add for row ``a``.

    ``comp``: a component of links found before, or the id.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for lo in range(0, part.num_rows, 2048):
                    some = part.slice(lo, 2048)
                    keys = sort_keys(_unit(some.column("unit").to_pylist()), n, first)
                    for p in range(n):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, p, np.int32)), some.column("dim"), pa.array(keys[:, p]), some.column("id"), some.column("comp"), some.column("unit")], ["pass", "dim", "sort", "id", "comp", "unit"])

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        seen: list[tuple[np.ndarray, ...]] = []  # keys, components, groups and ids: 32 bytes a row
        names = ["a", "b", "credit"]
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            old = 0 if tail is None else tail.num_rows
            t = t if tail is None else pa.concat_tables([tail, t])
            tail = t.slice(max(0, t.num_rows - window))
            ids = np.asarray(t.column("id"))
            where = np.asarray(t.column("pass")).astype(np.int64) << 32 | np.asarray(t.column("dim"))
            seen.append((np.asarray(batch.column("sort")).copy(), np.asarray(batch.column("comp")).copy(), where[old:], ids[old:]))
            raw = t.column("unit").to_pylist()
            parent: dict[int, int] = {}
            out = []
            for group in np.split(np.arange(t.num_rows), np.flatnonzero(np.diff(where)) + 1):
                x, start = _unit([raw[i] for i in group]), int(group[0])
                for d in range(1, min(window, len(group) - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
                    near = near[near + d + start >= old]  # pairs of the tail are known
                    for a, b in zip(ids[near + start].tolist(), ids[near + start + d].tolist(), strict=True):
                        while parent.setdefault(a, a) != a:
                            parent[a] = a = parent[parent[a]]
                        while parent.setdefault(b, b) != b:
                            parent[b] = b = parent[parent[b]]
                        if a != b:
                            parent[max(a, b)] = min(a, b)
            for a in parent:
                b = a
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    out.append((b, a))
            if out:
                pairs = np.array(out)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.zeros(len(out), np.int64))], names)
        if seen:
            keys, comps, where, ids = (np.concatenate(c) for c in zip(*seen, strict=True))
            credit = worth[depths(keys, comps, where, window)]
            for lo in range(0, len(ids), 1 << 16):
                some = np.flatnonzero(credit[lo : lo + (1 << 16)]) + lo
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(credit[some])], names)

    worth = credits(threshold, recall)
    spread_ = rows.select("id", "dim", "unit", "comp").mapInArrow(spread, "pass int, dim int, sort long, id long, comp long, unit binary")
    ordered = spread_.repartitionByRange("pass", "dim", "sort").sortWithinPartitions("pass", "dim", "sort", "id")
    return ordered.mapInArrow(slide, "a long, b long, credit long").groupBy("a", "b").agg(F.sum("credit").alias("credit"))


def tile_links(rows: DataFrame, count: int, threshold: float) -> DataFrame:
    """Links ``a, b`` of the ``count`` rows ``id, dim, unit``, each compared with every other of its
    dimension, that connect what all their links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, ["dim", "lo", "hi"]):
            ids, tile, low, high = (np.asarray(t.column(c)) for c in ("id", "tile", "lo", "hi"))
            raw = t.column("unit").to_pylist()
            for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                here = np.arange(begin, end)
                one, two = here[tile[here] == low[begin]], here[tile[here] == high[begin]]
                if not len(one) or not len(two):
                    continue
                x, y = (_unit([raw[i] for i in side]) for side in (one, two))
                label, out = np.arange(end - begin), []
                for lo in range(0, len(one), BLOCK):
                    near = x[lo : lo + BLOCK] @ y.T >= threshold
                    for k in np.flatnonzero(near.any(axis=1)):
                        a, others = int(one[lo + k]), two[near[k]] - begin
                        own = label[a - begin]
                        new, which = np.unique(label[others], return_index=True)
                        which = others[which[new != own]]
                        if len(which):
                            out += [(int(ids[a]), int(ids[begin + j])) for j in which]
                            label[np.isin(label, new)] = own
                if out:
                    pairs = np.array(out)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    tiles = -(-count // TILE)
    dealt = rows.select("id", "dim", "unit", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("long").alias("tile"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    dealt = dealt.select("dim", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "id", "tile", "unit")
    ordered = dealt.repartition("dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi", "id")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def all_links(reps: DataFrame, rows: int, threshold: float, recall: float = RECALL, window: int = WINDOW) -> DataFrame:
    """Written table of verified links ``a, b`` of the ``rows`` different directions ``id, dim, unit``:
    passes until every row has what it needs, or all of the rest compared."""
    need, n, first, last = needed(recall), passes(rows, threshold, recall, window), 0, rows
    owing = reps.select("id", "dim", "unit", F.col("id").alias("comp"), F.lit(0).cast("long").alias("credit"))
    links: DataFrame | None = None
    while True:
        found = materialize(sorted_pass_links(owing, n, threshold, window, recall, first), "passes")
        new = found.where("b is not null").select("a", "b")
        links = new if links is None else links.unionByName(new)
        first += n
        got = found.where("b is null").select(F.col("a").alias("id"), F.col("credit").alias("got"))
        owing = owing.join(got, "id", "left").withColumn("credit", F.col("credit") + F.coalesce("got", F.lit(0))).where(F.col("credit") < need)
        owing = materialize(owing.select("id", "dim", "unit", "credit"), "owing")
        left = F.ceil((need - F.col("credit")) * first / F.greatest("credit", F.lit(1)))
        rest, more = owing.agg(F.count("*"), F.percentile_approx(left, 0.5)).first()
        if not rest:
            return links
        if rest <= PASS_WORTH * min(more, ROUND) or (first > n and rest > 0.9 * last):
            return links.unionByName(materialize(tile_links(owing, rest, threshold), "tiles"))
        known = components(links).select("id", F.col("component_id").alias("comp"))
        owing = owing.join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        n, last = min(more, ROUND), rest


def _blocks(threshold: float):
    """Of each sorted group (members outside the core against a block of members) links to add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches, ["comp", "j", "m"]):
            ids, own, core, n = (np.asarray(t.column(c)) for c in ("id", "own", "core", "n"))
            raw = t.column("unit").to_pylist()
            who, add = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                mine, rest = np.flatnonzero(own[lo:hi]) + lo, np.flatnonzero(~own[lo:hi]) + lo
                if not len(mine) or not len(rest):
                    continue
                near = _unit([raw[i] for i in mine]) @ _unit([raw[i] for i in rest]).T >= threshold
                near &= ids[mine][:, None] != ids[rest]
                who += [ids[mine], ids[rest[core[rest]]]]
                add += [near @ n[rest], n[mine] @ near[:, core[rest]]]
            if who:
                w, a = np.concatenate(who), np.concatenate(add)
                yield pa.RecordBatch.from_arrays([pa.array(w[a > 0]), pa.array(a[a > 0])], ["id", "more"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Vectors link at a cosine of at least ``threshold`` (above 0), in doubles; those without a
    direction (null, empty, zero, null or non-finite components) and those of other dimensions
    link with nothing. Rows with one key link as different rows do, whatever their directions; rows
    without a key link with nothing and have no component. Empty in, empty out.
    """
    since = mark()
    signed = unit_vectors(vectors, key, embedding)
    good = signed.where("id is not null and cls is not null")
    # a key may have several directions, so classes are nodes of their own
    classes = good.groupBy("cls").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = good.join(classes.withColumnRenamed("rep", "id"), ["cls", "id"]).dropDuplicates(["cls"])
    reps = materialize(reps.select(F.col("node").alias("id"), "dim", "unit", "n"), "representatives")
    rows = reps.count()
    links = all_links(reps, rows, threshold, recall)
    comps = materialize(components(links), "components")

    # the core of a component: within half the angle of its first vector
    half = math.cos(math.acos(threshold) / 2) + MARGIN
    first = comps.where("id = component_id").join(reps.select("id", F.col("unit").alias("lead"), F.col("dim").alias("lead_dim")), "id").select(F.col("id").alias("comp"), "lead", "lead_dim")
    members = reps.join(comps.withColumnRenamed("component_id", "comp"), "id").join(first, "comp")

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("unit").to_pylist(), batch.column("lead").to_pylist()
            cos = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) if len(x) == len(y) else 0.0 for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("comp", "id", "n", "unit")], pa.array([c >= half for c in cos], pa.bool_())], ["comp", "id", "n", "unit", "core"])

    members = materialize(members.select("comp", "id", "n", "unit", "lead").mapInArrow(core, "comp long, id long, n long, unit binary, core boolean"), "members")
    sizes = materialize(members.groupBy("comp").agg(F.sum(F.when(F.col("core"), F.col("n"))).alias("in_core"), F.count("*").alias("all"), F.count_if(~F.col("core")).alias("outside")), "sizes")
    open_ = members.join(sizes.where("outside > 0").select("comp", "all", "outside"), "comp")
    block = lambda c: F.pmod(F.xxhash64("id"), F.ceil(F.col(c) / BLOCK)).cast("long")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(c) / BLOCK).cast("long") - 1)
    every = open_.withColumn("j", block("all")).withColumn("m", F.explode(upto("outside"))).withColumn("own", F.lit(False))
    mine = open_.where("not core").withColumn("m", block("outside")).withColumn("j", F.explode(upto("all"))).withColumn("own", F.lit(True))
    cols = ["comp", "j", "m", "id", "n", "own", "core", "unit"]
    both = every.select(*cols).unionByName(mine.select(*cols)).repartition("comp", "j", "m").sortWithinPartitions("comp", "j", "m", "id")
    more = both.mapInArrow(_blocks(threshold), "id long, more long").groupBy("id").agg(F.sum("more").alias("more"))
    counted = members.join(sizes.select("comp", "in_core"), "comp").join(more, "id", "left")
    counted = counted.select("id", "comp", (F.when(F.col("core"), F.col("in_core")).otherwise(F.col("n")) - 1 + F.coalesce("more", F.lit(0))).alias("links"))

    by_class = classes.join(counted, classes["node"] == counted["id"], "left").select("cls", "comp", "rep", F.coalesce("links", F.col("n") - 1).alias("links"))
    named = by_class.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    by_class = by_class.join(named, "comp", "left").select("cls", F.coalesce("least", "rep").alias("c"), "links")
    out = signed.select("id", F.when(F.col("id").isNotNull(), F.col("cls")).alias("cls")).join(by_class, "cls", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    out = out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
    return settle(out, since, "near-duplicates")
