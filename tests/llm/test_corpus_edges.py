"""Corpus operators on awkward tables: colliding words, clashing names, very long texts, split sorts."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute

from orrery.llm import bpe, labelled, media, mixing, near_text, near_vectors, pfor, quality, queries, suffixes, toxicity
from orrery.llm.common import fresh, gram_hashes, word_hash_pairs, word_spans

SF = "/root/testdata/sf0.001"
BASE = "doc_id long, text string, source string"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


# ------------------------------------------------------------------ words that polynomial hashes confuse


def thue_morse(n, a="a", b="b"):
    bits = [i.bit_count() & 1 for i in range(n)]
    return [(a, b)[x] for x in bits], [(a, b)[1 - x] for x in bits]


@pytest.mark.parametrize("n", [8, 64, 200, 256, 257, 1024, 4096])
def test_words_of_thue_morse_letters_hash_apart(n):
    x, y = ("".join(w).encode() for w in thue_morse(n))
    data = np.frombuffer(x + b" " + y, np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    for half in word_hash_pairs(data, s, e, True):
        assert half[0] != half[1]


def test_runs_of_thue_morse_words_hash_apart():
    one, two = (np.frombuffer(" ".join(w).encode(), np.uint8) for w in thue_morse(2048, "pear", "fig"))
    hashes = [word_hash_pairs(d, *word_spans(d, np.array([0, len(d)]))[:2], False)[0] for d in (one, two)]
    assert gram_hashes(hashes[0], 2048)[0] != gram_hashes(hashes[1], 2048)[0]
    ends = np.array([2048])
    assert (suffixes.run_hashes(hashes[0], np.array([0]), ends) != suffixes.run_hashes(hashes[1], np.array([0]), ends)).all()


def test_operators_on_confusing_texts(spark, library):
    x, y = ("".join(w) for w in thue_morse(1024))
    long_x, long_y = (" ".join(w) for w in thue_morse(4096, "pear", "fig"))
    tail = " ".join(f"t{i}" for i in range(8))
    rows = list(enumerate([x, y, f"{x} {tail}", f"{y} {tail}", long_x, long_y, f"{long_x} {tail}", f"{x} {x} {y}"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pfor.read_documents(pfor.write_segments(docs, queries.TOKENIZER)))
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    for k in (2, 5):
        assert {i: (r.n_shingles, r.component_id) for i, r in by_id(near_text.near_duplicates(docs, k)).items()} == brute.near_documents(rows, k)
    assert {i: r.spans for i, r in by_id(suffixes.report(docs)).items()} == brute.repeats(rows, 50)


def test_units_that_share_a_hash_are_told_apart(monkeypatch, library):
    import pyarrow as pa

    from orrery.llm.common import utf8

    encoder = pfor.LibraryEncoder(queries.TOKENIZER)
    monkeypatch.setattr(pfor, "word_hashes", lambda d, s, e, lower: np.zeros(len(s), np.uint64))
    texts = ["one two three", "", "four, five! sevenhundred", "x" * 40]
    ids, count = encoder.encode(*utf8(pa.array(texts, pa.large_string())))
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and len(count) == 4


@pytest.mark.parametrize("k", [2, 5])
def test_confirmation_compares_words(k):
    rng = random.Random(k)
    for _ in range(400):
        size = rng.choice([3, 40, 10**6])
        a = [f"W{rng.randrange(size)}" for _ in range(rng.randrange(60))]
        b = [w if rng.random() > 0.04 else f"w{rng.randrange(size)}" for w in a]
        one, two = " ".join(a), "  ".join(b)
        x, y = brute.shingles(one, k), brute.shingles(two, k)
        assert near_text.linked(one, two, k, 80) == bool(x & y and 100 * len(x & y) >= 80 * len(x | y))


# ------------------------------------------------------------------ the split sort of operator 10


@pytest.mark.parametrize(("partitions", "batch"), [(24, 3), (3, 1)])
def test_suffixes_over_many_partitions(spark, partitions, batch):
    rng = random.Random(partitions)
    words = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    passages, line = [words(rng.randrange(50, 140)) for _ in range(3)], words(12)
    kinds = [lambda: words(rng.randrange(60)), lambda: passages[0], lambda: rng.choice(passages), lambda: " ".join([line] * rng.randrange(1, 12)), lambda: " ".join(passages[1].split()[rng.randrange(10) :][: rng.randrange(45, 90)])]
    rows = [(i, " ".join(rng.choice(kinds)() for _ in range(rng.randrange(4)))) for i in range(90)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, (partitions, batch, "false"), strict=True):
            spark.conf.set(k, str(v))
        got = by_id(suffixes.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {i: r.spans for i, r in got.items()} == brute.repeats(rows, 50)


def test_least_places():
    grams = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    grams[100:200] = grams[100]
    for wide in (1, 5, 41):
        assert suffixes.least_places(grams, wide).tolist() == [i + int(np.argmin(grams[i : i + wide] >> np.uint64(32))) for i in range(500 - wide + 1)]


# ------------------------------------------------------------------ names, lengths, repeated rows

CLASH = ["TEXT_1", "id", "ID_1", "th", "hash", "doc", "spans", "row", "one", "other", "times", "n", "copy", "h", "k", "t", "bucket", "edge", "before", "Score", "quality", "N_Tokens", "IDS_SHA256", "size", "taken", "Repeats", "component_ID", "Kept", "__text", "__id", "__h", "__spans", "__times", "s1", "bands", "shard", "media", "a.b", "feature", "y", "c"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, BASE)
    return df.select("*", *[F.lit(f"x{n}").alias(c) for n, c in enumerate(CLASH)])


def test_fresh_names():
    assert fresh(["A", "a_1"], "a", "a", "b") == ["a_2", "a_3", "b"]


def test_names_that_clash(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, words, "s"), (2, words + " end", "s"), (3, None, None), (4, "", "z"), (None, "lone row", "z"), (4, "again", "z"), (4, "", "z")]
    docs = clashing(spark, rows)
    kept = lambda df: set(CLASH) <= set(df.columns)
    assert kept(near_text.keep_one(docs)) and near_text.keep_one(docs).count() == 4
    cut = suffixes.remove_repeats(docs)
    assert cut.columns == docs.columns and by_id(cut)[2].text == "end"
    assert mixing.repeat_rows(docs).columns == docs.columns and mixing.repeat_rows(docs).count() > 0
    model = quality.fit([(0, "### $$$ " * 900), (1, "plain words here " * 500)])
    scored = quality.classify(docs, model)
    assert [c.lower() for c in scored.columns].count("score") == 1 and scored.count() == 7
    toxic = toxicity.score(docs, toxicity.fit([]))
    assert [c.lower() for c in toxic.columns].count("score") == 1 and toxic.count() == 7
    coded = bpe.encode_decode(docs, queries.TOKENIZER)
    assert [c.lower() for c in coded.columns].count("n_tokens") == 1 and coded.count() == 7
    assert near_text.near_duplicates(docs).count() == mixing.mix(docs).count() == suffixes.report(docs).count() == 7
    assert pfor.read_documents(pfor.write_segments(docs, queries.TOKENIZER)).count() == media.features(media.store_texts(docs)).count() == 7
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.coalesce(F.col("doc_id"), F.lit(0)).cast("double")).alias("embedding"), *[F.col(f"`{c}`") for c in CLASH])
    assert near_vectors.near_duplicates(vectors).count() == 7


def test_pipeline_stages_on_clashing_names(spark, tmp_path):
    import corpus_pipeline as pipeline

    queries.table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    docs = queries.table(spark, SF, "documents")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in CLASH])
    for name, stage in pipeline.STAGES:
        before, docs = docs, pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.count() > 0 and (name == "encode" or docs.columns == before.columns)


def test_very_long_texts(spark, library):
    rng = random.Random(9)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(5000)) for _ in range(110_000))
    rows = [(1, base), (2, base + " tail"), (3, "x" * 1_200_000), (4, "é " * 300_000), (5, "short")]
    assert len(base) > 1_000_000
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], BASE)
    got, ids = by_id(bpe.encode_decode(docs, queries.TOKENIZER)), by_id(pfor.read_documents(pfor.write_segments(docs, queries.TOKENIZER)))
    for i, t in rows:
        want = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(want) == ids[i].n_tokens - 1 and got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    near = by_id(near_text.near_duplicates(docs))
    assert [near[i].component_id for i in range(1, 6)] == [1, 1, 3, 4, 5]
    spans = by_id(suffixes.report(docs))
    assert spans[2].spans == "0-110000" and not spans[1].spans and not spans[3].spans
    assert by_id(mixing.mix(docs))[4].size == 300_000
    assert by_id(media.features(media.store_texts(docs)))[3].n_bytes == 1_200_000
    scores = by_id(quality.classify(docs, quality.fit([(0, "### $$$ " * 900), (1, base[:9000])])))
    assert all(0 <= r.score <= 1 for r in scores.values())


def test_repeated_rows_have_repeated_results(spark):
    rows = [(7, "some words of a text", "s"), (8, None, "s")] * 3
    docs = spark.createDataFrame(rows, BASE)
    model = quality.fit([(0, "### $$$ " * 900), (1, "plain words here " * 500)])
    for out in (bpe.encode_decode(docs, queries.TOKENIZER), media.features(media.store_texts(docs)), quality.classify(docs, model), toxicity.score(docs, toxicity.fit([(0, "good day"), (1, "bad idiot")]))):
        found = out.drop("text").groupBy(*[c for c in out.columns if c != "text"]).count().collect()
        assert sorted(r["count"] for r in found) == [3, 3]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r)[:3] for r in near_vectors.near_duplicates(vectors).collect()) == [(1, 0, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


# ------------------------------------------------------------------ classifiers against plain versions


def test_labels_without_documents_take_no_places(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(1000, 1200)], "doc_id long, text string")
    labels = spark.range(1200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    rows = labelled.sample(docs, labels, "y", 5, 0, 60)
    assert sorted(y for y, _ in rows) == [0] * 60 + [1] * 60
    assert sum(len(t) for _, t in labelled.sample(docs, labels, "y", 5, 0, 60, most_bytes=50)) <= 100


def test_quality_block_by_block():
    model = quality.fit([(i % 2, (" ".join(f"good{j}" for j in range(i, i + 90)) if i % 2 else f"### {i} $$$ " * 40)) for i in range(80)])
    scorer, good, bad = model.scorer(), quality._compressor(model.good), quality._compressor(model.bad)
    for t in ("", "good1 good2 good3 " * 200, "### 3 $$$ " * 300, "é" * 5000):
        data, one, two = t.encode(), 0, 0
        for i in range(0, len(data), quality.BLOCK_BYTES):
            one += len(good.compress(data[i : i + quality.BLOCK_BYTES]))
            two += len(bad.compress(data[i : i + quality.BLOCK_BYTES]))
        x = model.slope * (two - one) / (len(data) + quality.FRAME_BYTES) + model.offset
        assert scorer.score(t) == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, x)))))


def test_toxicity_window_by_window():
    rng = random.Random(2)
    plain = lambda n: [rng.choice(["ana", "bel", "cor", "dun"]) + rng.choice(["ta", "mi", "so"]) for _ in range(n)]
    rows = [(i % 2, " ".join(plain(20) + ["idiot"] * (i % 2) + plain(10))) for i in range(60)]
    model = toxicity.fit(rows)
    for t in ("", "ana", " ".join(plain(5)), " ".join(plain(100) + ["idiot"] + plain(57))):
        w = t.split()
        starts = range(0, max(1, -(-max(len(w) - toxicity.WINDOW, 0) // toxicity.STRIDE) * toxicity.STRIDE + 1), toxicity.STRIDE)
        worst = max(float(model.worst(toxicity._column([" ".join(w[i : i + toxicity.WINDOW])]))[0]) for i in starts)
        assert float(model.worst(toxicity._column([t]))[0]) == pytest.approx(worst, abs=1e-3)


# ------------------------------------------------------------------ the registered queries over a whole table


def test_queries_against_plain_versions(spark, library):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    run = lambda name: by_id(queries.QUERIES[name](spark, SF))
    assert {i: (r.n_shingles, r.component_id) for i, r in run("op7_minhash").items()} == brute.near_documents(docs, 2)
    assert {i: r.spans for i, r in run("op10_suffix_array").items()} == brute.repeats(docs, 50)
    coded, ids, start = run("op2_bpe"), run("op9_token_ids"), 0
    for i, t in sorted(docs):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert coded[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
        assert (ids[i].start, ids[i].n_tokens, ids[i].ids_crc32) == (start, len(want) + 1, zlib.crc32(np.array([*want, 0], "<u4").tobytes()))
        start += len(want) + 1
    vectors = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").collect()]
    got = by_id(queries.QUERIES["op1_embedding_passes"](spark, SF), "vec_id")
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == brute.near_vectors(vectors)
    media_ = run("op5_media")
    for i, t in docs:
        raw = (t or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (media_[i].payload_sha256, media_[i].tail_crc32) == (hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
