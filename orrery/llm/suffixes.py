"""Operator 10, removal of repeated passages with sparse suffix arrays.

Of the suffixes of a text (in words) only those at minimisers are kept: in every run of
``min_words`` words the position whose next ``K`` words have the least hash. Equal runs keep the
suffix at the same place, wherever they stand. Suffixes are sorted by their first words and, among
equal ones, by the whole stretch for which they are the minimiser; neighbours in that order tell
which stretches repeat. Where neighbours agree on the first words alone, the match is extended to
the left and the right, as far as runs of ``min_words`` words that reach over the suffix agree.

A passage stays in the first document that has it, by key, and is marked in all later ones. Only
whole agreement of at least ``min_words`` words counts; repetition within one document does not.
Stretches and runs are told apart by 128 bits of a hash that is no polynomial (xxh3 over 64-bit
hashes of their words), never by fewer.

The order is one range sort of all suffixes by first words, stretch and document, so suffixes that
a third of all documents share lie in many partitions; each is read once, as a stream that holds
one document's suffixes at most. What a partition can't know of those before and after it follows
from one summary a partition. A document's equal stretches are one row with all their places.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from orrery.llm.common import fresh, gram_hashes, mark, materialize, quoted, settle, text_chunks, utf8, word_hashes, word_spans

MIN_WORDS, K = 50, 10
#: What a suffix is: one whose stretch an earlier document has, a first one that may share shorter
#: runs, one that other partitions decide on, and the summary of a partition.
LATER, OPEN, UNSURE, SUMMARY = range(4)
_KEY = ["head", "s1", "s2"]
_SORTED = "head long, s1 long, s2 long, doc long, th long, n int, at binary"
_STATED = "doc long, th long, n int, at binary, state int, part int, first boolean, lead boolean, note string"


def least_places(grams: np.ndarray, wide: int) -> np.ndarray:
    """Of each ``wide`` neighbouring hashes the place of the least (by its upper half), the leftmost of equal ones."""
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        key, size = np.minimum(key[:-size], key[size:]), 2 * size
    if size < wide:
        n = len(key) - (wide - size)
        key = np.minimum(key[:n], key[wide - size :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def run_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes ``[n, 2]`` of the runs of words ``begin`` to ``end - 1``."""
    raw, digest = memoryview(np.ascontiguousarray(words).view(np.uint8)), xxhash.xxh3_128_digest
    out = b"".join([digest(raw[8 * i : 8 * j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def suffixes(words: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Minimiser suffixes of texts (``at``: n + 1 word offsets): text, first run that a suffix is
    the minimiser of (in words from the text's start), how many such runs follow each other, hash
    of the suffix's first ``k`` words, hash ``[n, 2]`` of the stretch that these runs cover and the suffix's place in it."""
    none = np.zeros(0, np.int64)
    starts = len(words) - length + 1
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    run = np.flatnonzero(doc[:starts] == doc[length - 1 :]) if starts > 0 else none
    if not len(run):
        return none, none, none, none, np.zeros((0, 2), np.int64)
    grams = gram_hashes(words, k)
    place = (least_places(grams, length - k + 1))[run]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[run[1:]] != doc[run[:-1]])])
    a = run[new]
    count = np.diff(np.append(np.flatnonzero(new), len(run)))
    m = place[new]
    stretch = run_hashes(words, a, a + count - 1 + length).copy()
    stretch[:, 1] ^= (m - a) * np.int64(0x9E3779B97F4A7C1)
    return doc[a], a - at[doc[a]], count, grams[m].view(np.int64), stretch


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    s, e, at = word_spans(data, offsets)
    return word_hashes(data, s, e, False), at


def _gathered(row: np.ndarray, place: np.ndarray, n: np.ndarray, keys: list[np.ndarray], part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of the sort: of each text every different stretch once, with all its places."""
    order = np.lexsort((place, *keys[::-1], row))
    row, place, n, keys = row[order], place[order], n[order], [x[order] for x in keys]
    new = np.ones(len(row), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (row, *keys)], axis=0)
    at = np.flatnonzero(new)
    places = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(at, len(row)) * 4).astype(np.int32).tobytes()), pa.py_buffer(place.astype(np.int32).tobytes())])
    take = pa.array(row[at])
    return pa.RecordBatch.from_arrays([*[pa.array(x[at]) for x in keys], part.column("doc").take(take), part.column("th").take(take), pa.array(n[at].astype(np.int32)), places], [*_KEY, "doc", "th", "n", "at"])


class _Head:
    """The suffixes of one head, as far as a partition has come."""

    def __init__(self, lead: bool):
        self.lead, self.group, self.first, self.start = lead, None, None, None
        self.several = self.multi = False  # stretches, documents
        self.held: list[tuple] = []  # first documents' rows that nothing is known of yet: of one document
        self.begin = None  # key and first document of the first stretch

    def feed(self, key: np.ndarray, who: np.ndarray, say) -> None:
        """Rows of this head (stretches, documents) in order; ``say(rows, state, first)``."""
        m = len(key)
        new = np.ones(m, bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        if self.group is None:
            self.start, self.begin = tuple(who[0]), (tuple(key[0]), tuple(who[0]))
        else:
            new[0] = tuple(key[0]) != self.group
            self.several |= bool(new[0])
        self.several |= bool(new[1:].any())
        self.multi |= bool((who != self.start).any())
        top = np.maximum.accumulate(np.where(new, np.arange(m), -1))
        lead = who[np.maximum(top, 0)]
        if top[0] < 0:
            lead[top < 0] = self.first
        later = (who != lead).any(axis=1)
        edge = (key == self.begin[0]).all(axis=1) if self.lead else np.zeros(m, bool)
        self.group, self.first = tuple(key[-1]), tuple(lead[-1])
        say(np.flatnonzero(later), LATER, False)
        say(np.flatnonzero(~later & edge), UNSURE, True)
        rest = np.flatnonzero(~later & ~edge)
        if self.several and self.multi:
            for rows, batch in self.held:
                say(rows, OPEN, False, batch)
            self.held = []
            say(rest, OPEN, False)
        elif len(rest):
            self.held.append((rest, say.batch()))

    def close(self, say, last: bool) -> None:
        """The head ends; what other partitions may still decide on is told."""
        for rows, batch in self.held if self.lead or last else []:
            say(rows, UNSURE, False, batch)
        self.held = []

    def note(self) -> dict:
        return {"several": self.several, "multi": self.multi, "start": self.start, "begin": self.begin, "group": self.group, "first": self.first}


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes, each compared with the ones before it; those that matter, and a summary."""
    part, names = TaskContext.get().partitionId(), ["doc", "th", "n", "at", "state", "part", "first", "lead", "note"]
    out: list[pa.RecordBatch] = []
    head, current, lead, first_note = None, None, True, None

    def told(batch: pa.RecordBatch, rows: np.ndarray, state: int, first: bool, lead: bool) -> None:
        if len(rows):
            some, m = batch.select(["doc", "th", "n", "at"]).take(pa.array(rows)), len(rows)
            out.append(pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(m, state, np.int32)), pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, first)), pa.array(np.full(m, lead)), pa.nulls(m, pa.string())], names))

    for batch in batches:
        if not batch.num_rows:
            continue
        heads = np.asarray(batch.column("head"))
        key = np.column_stack([np.asarray(batch.column("s1")), np.asarray(batch.column("s2"))])
        who = np.column_stack([np.asarray(batch.column("doc")), np.asarray(batch.column("th"))])
        at = np.append(np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])), len(heads))

        def feed(lo: int, hi: int, batch=batch, key=key, who=who) -> None:
            def say(rows: np.ndarray, state: int, first: bool, of: pa.RecordBatch | None = None) -> None:
                told(batch.slice(lo, hi - lo) if of is None else of, rows, state, first, head.lead)

            say.batch = lambda: batch.slice(lo, hi - lo)
            head.feed(key[lo:hi], who[lo:hi], say)

        def close(last: bool) -> None:
            head.close(lambda rows, state, first, of: told(of, rows, state, first, head.lead), last)

        begin = 0
        if head is not None and heads[0] == current:
            feed(0, at[1])
            begin = 1
        if begin < len(at) - 1:  # the head before ends here
            if head is not None:
                close(False)
                if lead:
                    first_note, lead = {"head": int(current)} | head.note(), False
            elif len(at) > 2:  # the partition's first head lies whole in this batch
                head, current = _Head(True), heads[0]
                feed(0, at[1])
                close(False)
                first_note, lead, begin = {"head": int(current)} | head.note(), False, 1
            lo, hi = at[begin], at[-2]
            if lo < hi:  # heads that lie whole in this batch
                h, k, w = heads[lo:hi], key[lo:hi], who[lo:hi]
                new_head = np.concatenate([[True], h[1:] != h[:-1]])
                new = new_head | np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])
                index = np.arange(hi - lo)
                top, top_head = np.maximum.accumulate(np.where(new, index, 0)), np.flatnonzero(new_head)
                later = (w != w[top]).any(axis=1)
                of = np.cumsum(new_head) - 1
                multi = np.logical_or.reduceat((w != w[top_head[of]]).any(axis=1), top_head)
                several = np.add.reduceat(new.astype(np.int64), top_head) > 1
                told(batch, lo + np.flatnonzero(later), LATER, False, False)
                told(batch, lo + np.flatnonzero(~later & (multi & several)[of]), OPEN, False, False)
            head, current = _Head(lead), heads[at[-2]]
            feed(at[-2], at[-1])
        yield from out
        out.clear()
    if head is not None:
        close(True)
        note = {"head": int(current)} | head.note()
        notes = json.dumps([first_note or note, note], default=int)
        out.append(pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())], pa.array([SUMMARY], pa.int32()), pa.array([part], pa.int32()), pa.array([False]), pa.array([False]), pa.array([notes])], names))
        yield from out


def _across(notes: dict[int, list[dict]]) -> dict[int, tuple[list[int] | None, bool, bool]]:
    """From the partitions' summaries, of each: the document that has its first stretch first, if an
    earlier partition holds it; whether its first head, and its last, has several stretches and documents."""
    chains: list[dict] = []  # heads in order, each over the partitions that it lies in
    carried, of = {}, {}
    for part in sorted(notes):
        first, last = notes[part]
        whole = first["head"] == last["head"]
        for n, note in enumerate([first] if whole else [first, last]):
            chain = chains[-1] if chains and not n and chains[-1]["head"] == note["head"] else None
            if chain is None:
                chain = {"head": note["head"], "several": False, "multi": False, "start": note["start"], "group": None, "first": None}
                chains.append(chain)
            chain["several"] |= note["several"] or chain["group"] not in (None, note["begin"][0])
            chain["multi"] |= note["multi"] or note["start"] != chain["start"]
            same = chain["group"] == note["begin"][0]
            if not n:
                carried[part] = chain["first"] if same else None
            # a stretch that goes on keeps its first document
            chain["first"] = chain["first"] if same and note["group"] == note["begin"][0] else note["first"]
            chain["group"] = note["group"]
            of.setdefault(part, []).append(chain)
    return {p: (carried[p], *(c["several"] and c["multi"] for c in (of[p][0], of[p][-1]))) for p in notes}


def compared(rows: DataFrame) -> DataFrame:
    """``doc, th, n, at, state`` of the ``rows(head, s1, s2, doc, th, n, at)`` whose stretch an
    earlier document has (``LATER``), and of the first ones of a stretch whose head begins several
    stretches in several documents (``OPEN``)."""
    order = [*_KEY, "doc", "th"]
    stated = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare, _STATED), "neighbours")
    notes = {r["part"]: json.loads(r["note"]) for r in stated.where(F.col("state") == SUMMARY).select("part", "note").collect()}
    known = _across(notes)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = np.asarray(batch.column("state")).copy()
            for i in np.flatnonzero(state == UNSURE).tolist():
                carried, open_first, open_last = known[batch.column("part")[i].as_py()]
                lead = batch.column("lead")[i].as_py()
                if batch.column("first")[i].as_py() and carried is not None and carried != [batch.column("doc")[i].as_py(), batch.column("th")[i].as_py()]:
                    state[i] = LATER
                elif open_first if lead else open_last:
                    state[i] = OPEN
            kept = np.flatnonzero(state < UNSURE)
            some = batch.select(["doc", "th", "n", "at"]).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(state[kept])], ["doc", "th", "n", "at", "state"])

    return stated.where(F.col("state") != SUMMARY).mapInArrow(decide, "doc long, th long, n int, at binary, state int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, th, spans`` of the documents that repeat passages of earlier ones.

    ``doc`` is the key, ``th`` the hash of the text that tells rows with one key apart; ``spans``
    are ascending, disjoint ``(start, end)`` in words. Rows without a key are left out.
    """
    since = mark()
    rows = docs.select(quoted(key).cast("long").alias("doc"), F.xxhash64(quoted(text)).alias("th"), quoted(text).alias("t")).where("doc is not null and t is not null")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch, "t"):
                part = batch.slice(lo, hi - lo)
                row, a, n, head, stretch = suffixes(*_words(part.column("t")), min_words, k)
                if len(row):
                    yield _gathered(row, a, n, [head, stretch[:, 0], stretch[:, 1]], part)

    # written first: the range sort would read, and cut, the texts twice
    seeds = materialize(rows.mapInArrow(seed, _SORTED), "suffixes")
    whole = materialize(compared(seeds), "stretches")
    open_ = whole.where(F.col("state") == OPEN).groupBy("doc", "th").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch, "t"):
                part = batch.slice(lo, hi - lo)
                words, at = _words(part.column("t"))
                index, row = [], []
                for r, runs in enumerate(part.column("runs").to_pylist()):
                    p = np.unique(np.concatenate([(np.frombuffer(x["at"], np.int32)[:, None] + np.arange(x["n"])).ravel() for x in runs]))
                    index.append(p + at[r])
                    row.append(np.full(len(p), r))
                if index:
                    index, row = np.concatenate(index), np.concatenate(row)
                    hashes = run_hashes(words, index, index + min_words)
                    yield _gathered(row, index - at[row], np.ones(len(row)), [hashes[:, 0], hashes[:, 1], np.zeros(len(row), np.int64)], part)

    texts = rows.join(open_, ["doc", "th"])
    runs = materialize(texts.select("doc", "th", "t", "runs").mapInArrow(extend, _SORTED), "runs")
    both = whole.unionByName(compared(runs)).where(F.col("state") == LATER)
    spans = both.groupBy("doc", "th").agg(F.collect_list(F.struct("at", "n")).alias("parts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                at = [np.frombuffer(x["at"], np.int32) for x in parts]
                end = np.concatenate([p + (x["n"] - 1 + min_words) for p, x in zip(at, parts, strict=True)])
                start = np.concatenate(at)
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                out.append([{"start": s, "end": e} for s, e in zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("th"), pa.array(out, kind)], ["doc", "th", "spans"])

    return settle(spans.mapInArrow(merge, "doc long, th long, spans array<struct<start:int,end:int>>"), since, "spans")


def report(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, repeated_words, spans`` of every row; ``spans`` is ``start-end,...`` in words.

    A null text, one of fewer than ``min_words`` words and a row without a key have no spans.
    Repeated rows are one document: none of them repeats the other. Rows with one key and
    different texts are different documents, in order of their texts' hashes.
    """
    from orrery.llm.mixing import word_counts

    base = docs.select(quoted(key).cast("long").alias("doc_id"), F.xxhash64(quoted(text)).alias("th"), quoted(text).alias("text"))
    sizes = word_counts(base, size="n_words")
    spans = repeated_spans(docs, min_words, key=key, text=text).withColumnRenamed("doc", "doc_id")
    out = sizes.join(spans, ["doc_id", "th"], "left")
    total = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"]), F.lit(0).cast("long"))
    words = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "n_words", total.alias("repeated_words"), F.coalesce(words, F.lit("")).alias("spans"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and the white space behind them."""
    data = text.encode("utf-8")
    s, _, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    out, at = [], 0
    for start, end in spans:
        out.append(data[at : s[start]])
        at = s[end] if end < len(s) else len(data)
    return b"".join([*out, data[at:]]).decode("utf-8")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; rows whose words all repeat are dropped.

    Other columns stay as they are, except ``n_chars``, where there is one, which is set anew on
    rows that change. Rows are treated as in ``report``.
    """
    names = docs.columns
    hashed, doc, th, found_ = fresh(names, "hashed", "doc", "th", "spans")
    spans = repeated_spans(docs, min_words, key=key, text=text).select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("spans").alias(found_))
    keyed = docs.withColumn(hashed, F.xxhash64(quoted(text)))
    joined = keyed.join(spans, (quoted(key).cast("long") == F.col(doc)) & (F.col(hashed) == F.col(th)), "left").drop(doc, th, hashed)
    chars = next((i for i, c in enumerate(names) if c.lower() == "n_chars" and isinstance(docs.schema[i].dataType, (LongType, IntegerType))), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [n.lower() for n in names].index(text.lower())
        for batch in batches:
            for lo, hi in text_chunks(batch, f"c{at}"):
                part = batch.slice(lo, hi - lo)
                spans_ = part.column(len(names)).to_pylist()
                columns = [part.column(i) for i in range(len(names))]
                if any(spans_):
                    texts = columns[at].to_pylist()
                    new = [cut(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, spans_, strict=True)]
                    columns[at] = pa.array(new, part.column(at).type)
                    keep = pa.array([not s or bool(t.strip(" \t\n\r\x0b\x0c")) for t, s in zip(new, spans_, strict=True)])
                    if chars is not None:
                        old = columns[chars].to_pylist()
                        columns[chars] = pa.array([len(t) if s else o for t, s, o in zip(new, spans_, old, strict=True)], part.column(chars).type)
                    yield pa.RecordBatch.from_arrays(columns, names).filter(keep)
                else:
                    yield pa.RecordBatch.from_arrays(columns, names)

    return joined.toDF(*[f"c{n}" for n in range(len(names) + 1)]).mapInArrow(run, docs.schema)
