"""Every corpus operator against its plain version or the library it follows, on small awkward inputs."""

from __future__ import annotations

import hashlib
import json
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute

from orrery.llm import bpe, chat, labelled, media, mixing, near_text, near_vectors, pfor, quality, queries, suffixes, toxicity
from orrery.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base, passage, hub = words(rng, 300), words(rng, 60, 9999), words(rng, 200)
    out = [None, "", "   \n", "one", "ONE ", "two words", "x" * 5000, "Ünï ñandú 中文 <|endoftext|> don't  stop\r\n\n  !!", base, base, base.upper()]
    for _ in range(12):
        w = base.split()
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    for _ in range(150):  # a group of near copies larger than a chunk
        w = hub.split()
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        out.append(" ".join(w))
    out += [f"{words(rng, 20)} {passage} {words(rng, rng.randrange(0, 90))}" for _ in range(30)]
    out += [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i % 11 == 0 else f"src{i % 5}", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, i) for i in range(300, 340)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.union(500, edges)
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


# ------------------------------------------------------------------ 1


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((3, 16))
    vectors = [None, [], [0.0] * 16, [float("nan")] * 16, [None, *[1.0] * 15], [float("inf")] * 16, [1.0] * 8, [2.0] * 8]
    vectors += [list(base[0] + rng.standard_normal(16) * s) for s in np.repeat([0.05, 0.2, 0.4], 40)]
    vectors += [list(base[1])] * 30 + [list(base[1] * 2)] + [list(rng.standard_normal(16)) for _ in range(80)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], i % 3) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit(1)).withColumn("n_links", F.lit(1))
    want = brute.near_vectors([(i, v) for i, v, _ in rows])
    got = near_vectors.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0
    keyless = near_vectors.near_duplicates(df.withColumn("vec_id", F.lit(None).cast("long"))).first()
    assert keyless.n_links == 0 and keyless.component_id is None and keyless.kept


def test_vector_passes_reach_the_threshold(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 32))
    y = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (y * x).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    pair = 0.901 * x + np.sqrt(1 - 0.901**2) * y
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, pair]))], "vec_id long, embedding array<double>")
    got = near_vectors.near_duplicates(df).where("vec_id >= 4000 and component_id = vec_id - 4000").count()
    assert got >= 0.93 * 4000


def crowded(n, dim, hot, mean, pairs):
    """``n`` directions, the first ``hot`` of one topic of that mean cosine, and neighbours at 0.905 of ``pairs`` of these."""
    rng = np.random.default_rng(4)
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    x, topic = unit(rng.standard_normal((n, dim))), np.eye(dim)[0]
    x[:hot, 0] = 0
    x[:hot] = np.sqrt(mean) * topic + np.sqrt(1 - mean) * unit(x[:hot])
    some = x[:pairs]
    y = rng.standard_normal((pairs, dim))
    y[:, 0] = 0
    y = np.sqrt(mean) * topic + np.sqrt(1 - mean) * unit(y)
    y = unit(y - (y * some).sum(axis=1)[:, None] * some)
    return np.concatenate([x, 0.905 * some + np.sqrt(1 - 0.905**2) * y])


def linked(spark, x):
    """The share of all pairs at the threshold that come into one component."""
    near = np.argwhere(np.triu(x @ x.T >= near_vectors.THRESHOLD, 1)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    comp = {r.vec_id: r.component_id for r in near_vectors.near_duplicates(df).collect()}
    return sum(comp[a] == comp[b] for a, b in near) / len(near)


@pytest.mark.parametrize("mean", [0.7, 0.8])
def test_vectors_of_a_crowded_topic(spark, mean):
    assert linked(spark, crowded(12_000, 64, 4000, mean, 500)) >= near_vectors.RECALL


def test_vectors_of_a_crowded_topic_by_passes_alone(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "PASS_WORTH", 4)
    assert linked(spark, crowded(3000, 32, 1000, 0.5, 500)) >= near_vectors.RECALL - 0.02  # two deviations of 500 pairs


def test_vector_depths_count_what_lies_beyond_the_window():
    rng = np.random.default_rng(6)
    m, window = 600, 8
    keys = np.sort(rng.integers(0, 1 << 63, m, dtype=np.int64) >> rng.integers(0, 3, m))
    comps = np.where(rng.random(m) < 0.3, 7, np.arange(1000, 1000 + m))
    comps[200:260] = 7
    where = np.repeat([1, 2, 3], [250, 250, 100])
    keys = np.concatenate([np.sort(keys[where == w]) for w in (1, 2, 3)])
    got = near_vectors.depths(keys, comps, where, window)
    for i in range(m):
        cell = [j for j in range(m) if where[j] == where[i] and keys[j] >> (63 - min(63, got[i])) == keys[i] >> (63 - min(63, got[i]))]
        assert got[i] == 64 or all(abs(i - j) <= window or comps[j] == comps[i] for j in cell)
    assert (got[250 + window + 1 : 500 - window - 1] < 64).all()


# ------------------------------------------------------------------ 2 and 9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


def test_bpe(spark, docs, none, rows, library):
    got = by_id(bpe.encode_decode(docs.withColumn("n_tokens", F.lit("clash")), queries.TOKENIZER, keep_ids=True, keep_text=True))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded == (t or "") == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(none, queries.TOKENIZER).count() == 0


def awkward(n, seed):
    rng = random.Random(seed)
    letters = [*" \n\t  ab'sllx12,.!?é中\xa0 　ßİ​́😀\x1c\x85\r'", "don't", "'re", " the", "  ", "<|endoftext|>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(26))) for _ in range(n)]


def test_both_encoders_follow_the_library(library):
    import pyarrow as pa

    from orrery.llm.common import utf8

    own, fast = bpe.load(queries.TOKENIZER), pfor.library(queries.TOKENIZER)
    for seed in range(40):
        texts = [t for t in awkward(50, seed) if seed % 2 or "<|end" not in t]
        ids, count = fast.encode(*utf8(pa.array(texts, pa.large_string())))
        at = np.concatenate([[0], np.cumsum(count)])
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids[a:b].tolist() == want and np.frombuffer(own.encode(t), "<u4").tolist() == want
            assert own.decode(own.encode(t)).decode() == t


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
@pytest.mark.parametrize("top", [3, 50257, 2**32])
def test_pfor_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    ids[::17] = 2**32 - 1
    lengths = np.array([n // 3, 0, n - n // 3])
    image = pfor.pack(ids, lengths)
    back, sizes = pfor.unpack(image)
    assert (back == ids).all() and (sizes == lengths).all()
    assert (pfor.Image(image).document(2) == ids[n // 3 :]).all() and not len(pfor.Image(image).document(1))
    with pytest.raises(ValueError):
        pfor.Image(b"x" * 100)


def test_token_files(spark, docs, none, rows, library):
    got, start = by_id(pfor.read_documents(pfor.write_segments(docs.repartition(7), queries.TOKENIZER))), 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert pfor.read_documents(pfor.write_segments(none, queries.TOKENIZER)).count() == 0
    twice = pfor.read_documents(pfor.write_segments(docs.limit(20).union(docs.limit(20)).withColumn("doc_id", F.lit(None)), queries.TOKENIZER)).orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(twice[:-1], twice[1:], strict=True))


# ------------------------------------------------------------------ 3 and 6


def taught(seed, n=700):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic, good = i % 4 == 0, i % 3 > 0
        w = [rng.choice(["ana", "bel", "cor", "dun", "el"]) + rng.choice(["ta", "mi", "so"]) for _ in range(rng.randrange(5, 120))]
        if not good:
            w = [x + rng.choice(["###", "$$$", "&&&"]) for x in w]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "MORON", "grob" + rng.choice(["ta", "mi", "so"])]))
        out.append((i, " ".join(w), int(good), int(toxic)))
    return out


@pytest.mark.parametrize(("kind", "module", "column"), [("quality", quality, 2), ("toxic", toxicity, 3)])
def test_classifiers(spark, none, kind, module, column):
    data = taught(4)
    docs = spark.createDataFrame([(r[0], r[1]) for r in data], "doc_id long, text string")
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % module.MODULUS == module.REMAINDER]
    # labels of the held-out fold are wrong here: they must not be learned from
    wrong = {r[0] for r in held}
    labels = spark.createDataFrame([(r[0], r[column] ^ (r[0] in wrong)) for r in data], f"doc_id long, {kind} int")
    model = module.train(docs, labels)
    score = (lambda d: quality.classify(d, model)) if kind == "quality" else (lambda d: toxicity.score(d, model))
    got = by_id(score(docs.withColumn("score", F.lit("clash"))))
    right = sum((got[r[0]].score >= module.THRESHOLD) == bool(r[column]) for r in held)
    assert right >= 0.95 * len(held)
    # equal texts, equal scores, wherever they stand; odd texts have some score
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, data[0][1]), (5, data[1][1] * 200)], "doc_id long, text string")
    odd = by_id(score(odd.union(docs)).limit(5))
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[1].score == odd[2].score
    assert odd[4].score == pytest.approx(got[0].score, abs=1e-6)
    assert score(none).count() == 0
    # without labels of one class every score is the share
    assert module.fit([]) and module.fit([(1, "a"), (1, "b")])
    flat = module.train(docs, labels.where(f"{kind} = 1"))
    flat = (quality.classify(docs, flat) if kind == "quality" else toxicity.score(docs, flat)).agg(F.count_distinct("score")).first()[0]
    assert flat == 1


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(500)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    rows = labelled.sample(docs, labels, "y", 5, 0, 50)
    assert len(rows) == 100 and all(zlib.crc32(t.encode()) % 5 for _, t in rows) and all(int(t) % 2 == y for y, t in rows)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in toxicity.initial(rng, 5).items()}
    x = rng.standard_normal((2, toxicity.WINDOW, 3, 3 * toxicity.HIDDEN))
    mask = np.ones((toxicity.WINDOW, 3, 1), np.float32)
    mask[9:, 1] = 0
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        z = toxicity.forward(p, x[0], x[1], mask)
        return float(np.logaddexp(0, z).sum() - (target * z).sum())

    keep = {}
    z = toxicity.forward(p, x[0], x[1], mask, keep)
    g, df, db = toxicity.backward(p, keep, mask, 1 / (1 + np.exp(-z)) - target)
    for name in ("Uf", "Ub", "A", "v", "o", "a"):
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        old, h = p[name][at], 1e-2
        p[name][at] = old + h
        up = loss()
        p[name][at] = old - h
        down = loss()
        p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-3), name


# ------------------------------------------------------------------ 4


def test_mixing(spark, docs, none, rows):
    got = by_id(mixing.mix(docs))
    sizes = {}
    for i, t in rows:
        s = None if i % 11 == 0 else f"src{i % 5}"
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
        assert got[i].size == len(brute.words(t)) and got[i].source == s
    want = brute.water_fill(sizes)
    taken = {s: 0 for s in sizes}
    for r in got.values():
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 150 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = by_id(mixing.mix(docs.repartition(9)))
    assert {i: r.taken for i, r in again.items()} == {i: r.taken for i, r in got.items()}
    assert mixing.mix(none).count() == 0
    out = mixing.repeat_rows(docs.union(docs.limit(5)))
    assert out.columns == docs.columns
    same = by_id(mixing.mix(docs.union(docs.limit(5))).groupBy("doc_id").agg(F.sum("repeats").alias("n")))
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: r.n for i, r in same.items() if r.n}


def test_water_filling_clamps(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1), (None, 5), ("d", 0), ("e", 40)]
    df = spark.createDataFrame(sizes, "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute.water_fill(dict(sizes)))


# ------------------------------------------------------------------ 5


@pytest.mark.parametrize("form", ["ppm", "bmp"])
def test_media(spark, docs, none, rows, form):
    table = media.store_texts(docs, form=form)
    got, stored = by_id(media.features(table)), by_id(table)
    for i, t in rows:
        r, raw = got[i], (t or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-16:]) and r.media_bytes == len(stored[i].media)
        assert r.media_sha256 == hashlib.sha256(stored[i].media).hexdigest() and len(r.feature) == 16
    assert media.features(media.store_texts(none)).count() == 0
    with pytest.raises(ValueError):
        media.store_texts(docs, form="gif")


def test_image_formats():
    rng = np.random.default_rng(1)
    rgb, gray = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8), rng.integers(0, 256, (5, 7, 1)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    for image in (rgb, gray):
        assert (media.decode(media.encode_ppm(image)) == image).all()
    assert media.decode(b"P1 # bits\n3 2\n1 0 1\n0 1 0\n")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n# top\n15\n15 0\n")[:, :, 0].tolist() == [[255, 0]]
    assert media.decode(b"P4\n3 2\n\xa0\x40")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5\n1 1\n65535\n\xff\xff")[0, 0, 0] == 255
    for bad in (b"GIF89a", b"P6\n9", b"P6\n9 9\n255\nabc"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_means():
    image = np.random.default_rng(0).integers(0, 256, (12, 18)).astype(float)
    assert np.allclose(media.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    assert media.area_resize(image, 5, 7).mean() == pytest.approx(image.mean())
    assert np.load(__import__("io").BytesIO(media.tile_npy(image[:, :, None].astype(np.uint8)))).shape == (16, 16)


# ------------------------------------------------------------------ 7 and 10


@pytest.mark.parametrize("k", [2, 5])
def test_near_documents(spark, docs, none, rows, k):
    want = brute.near_documents(rows, k)
    got = by_id(near_text.near_duplicates(docs.withColumn("kept", F.lit(0)), k))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert near_text.near_duplicates(none, k).count() == 0
    kept = near_text.keep_one(docs.union(docs.limit(12)), k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_keyless_documents(spark, docs):
    lone = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert near_text.near_duplicates(lone).where("kept and component_id is null").count() == lone.count()
    assert suffixes.report(lone).where("repeated_words > 0").count() == 0
    assert suffixes.remove_repeats(lone).count() == lone.count()


def test_repeats(spark, docs, none, rows):
    want = brute.repeats(rows, 50)
    got = by_id(suffixes.report(docs))
    assert {i: r.spans for i, r in got.items()} == want
    assert sum(bool(s) for s in want.values()) > 50
    assert all(got[i].n_words == len(brute.words(t)) for i, t in rows)
    cut = by_id(suffixes.remove_repeats(docs.withColumn("spans", F.lit("clash"))))
    for i, t in rows:
        w = brute.words(t)
        keep = [True] * len(w)
        for span in filter(None, want[i].split(",")):
            a, b = map(int, span.split("-"))
            keep[a:b] = [False] * (b - a)
        left = [x for x, k in zip(w, keep, strict=True) if k]
        if want[i]:
            assert (i in cut) == bool(left)
            if left:
                assert brute.words(cut[i].text) == left and cut[i].n_chars == len(cut[i].text)
        else:
            assert cut[i].text == t
    assert suffixes.report(none).count() == 0 and suffixes.remove_repeats(none).count() == 0
    # equal rows are one document; rows of one key with other texts are others
    twice = suffixes.report(docs.where("doc_id = 8").union(docs.where("doc_id = 8")))
    assert twice.where("repeated_words > 0").count() == 0


# ------------------------------------------------------------------ 8


def test_chat(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (2, 0, "system", "Alone"), (3, None, None, ""), (3, 5, "ann", "x"), (3, 5, "ann", "x")]
    turns += [(4, n, "ann" if n % 2 else "bob c", f"t{n}") for n in range(150)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(df.repartition(5)).collect()}
    ann = got[1, "ann", 0]
    assert ann.rendered == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi <| im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    )
    losses = [ann.rendered[slice(*map(int, s.split("-")))] for s in ann.loss_spans.split(",")]
    assert losses == ["Hi <| im_end|><|im_end|>", "Bye<|im_end|>"] and ann.loss_chars == sum(map(len, losses))
    assert got[1, "bob", 0].n_turns == 4 and got[2, None, 0].loss_spans == ""
    assert got[3, "unknown", 0].n_turns == 3 and got[3, "ann", 0].rendered.count("assistant") == 2
    assert [got[4, "ann", p].n_turns for p in range(3)] == [64, 64, 22]
    whole = "".join(got[4, "bob c", p].rendered for p in range(3))
    assert [int(x.split("<")[0]) for x in whole.split("\nt")[1:]] == list(range(150)) and "user name=ann" in whole
    assert "user name=bob_c" in got[4, "ann", 0].rendered
    assert chat.rotate(df.limit(0)).count() == 0
    assert chat.rotate(df.withColumn("conv_id", F.lit(None))).count() == 0


# ------------------------------------------------------------------ queries and pipeline


def test_queries_have_their_contracts(spark):
    columns = {
        "op1_": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op2_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op3_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op4_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op5_": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
        "op6_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op7_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op8_": {"conv_id": "bigint", "rendered": "string"},
        "op9_": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op10_": {"doc_id": "bigint", "spans": "string"},
    }
    for start, kinds in columns.items():
        (name,) = [q for q in queries.QUERIES if q.startswith(start)]
        out = queries.QUERIES[name](spark, SF)
        assert kinds.items() <= dict(out.dtypes).items(), name
        rows = {"op1_": "embeddings", "op8_": None}.get(start, "documents")
        if rows:
            assert out.count() == queries.table(spark, SF, rows).count()


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = queries.table(spark, SF, "documents")
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.materialize(stage(spark, docs, SF), "test")
        if name != "encode":
            assert docs.columns == before.columns
        old = [(r.doc_id, r.text) for r in before.collect()] if "text" in before.columns else []
        ids = [r.doc_id for r in docs.collect()]
        if name == "near-duplicates":
            want = brute.near_documents(old, 5)
            assert sorted(ids) == sorted(i for i, (_, c) in want.items() if c == i)
        if name == "repeats":
            spans = brute.repeats(old, 50)
            assert {i for i, _ in old} - set(ids) <= {i for i, s in spans.items() if s}
            assert all(t == dict(old)[i] for i, t in ((r.doc_id, r.text) for r in docs.collect()) if not spans[i])
        if name == "mix":
            assert max(ids.count(i) for i in set(ids)) <= 3
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    assert json.dumps(sorted(ids)) == json.dumps(sorted(r.doc_id for r in pipeline.run(spark, SF).collect()))


def test_pipeline_over_nothing(spark, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels"):
        queries.table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
