"""Operator 6, a compression classifier of text quality.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into
blocks; each is compressed with both, and the difference of the summed sizes over the text's size is the
evidence: near 0 where neither dictionary helps, as in a text that repeats itself. A logistic
curve fitted on labelled texts, by dictionaries that have not seen them, turns it into the probability
of good quality, classes weighing alike (good texts are far more frequent; by their share nearly
nothing would fall below the threshold).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import beside_text, text_chunks
from orrery.llm.labelled import logistic, sample

#: Labelled texts of each class that the classifier is fitted on, at most.
PER_CLASS = 1200
#: A dictionary takes at most ``DICT_BYTES``, and a part in ``SHARE`` of the lesser class's text.
DICT_BYTES, SHARE, LEAST_BYTES = 64 << 10, 8, 4096
BLOCK_BYTES = 512
#: Parts of the rows that in turn place the curve.
FOLDS = 4
LEVEL = 3
#: About what the compressed form of nothing takes; damps the evidence of the shortest texts.
FRAME_BYTES = 20
MODULUS, REMAINDER = 5, 0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes trained on all of the texts; of less than ``LEAST_BYTES`` of
    text the dictionary is the text itself, whole."""
    whole = b"\n".join(texts)
    if len(whole) < LEAST_BYTES:
        return whole
    return zstandard.train_dictionary(min(size, len(whole) // 4), blocks(whole), k=256, d=8).as_bytes()


def _dictionaries(by: dict[int, list[bytes]]) -> tuple[bytes, bytes]:
    """Of good and of bad text, of one size, which follows the class with the lesser text."""
    size = max(512, min(DICT_BYTES, min(sum(map(len, t)) for t in by.values()) // SHARE))
    return _dictionary(by[1], size), _dictionary(by[0], size)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.good = _compressor(model.good) if model.good else None
        self.bad = _compressor(model.bad) if model.bad else None

    def evidence(self, data: bytes) -> float:
        """Normalised difference of a text's compressed sizes: above 0 if the good dictionary helps more."""
        parts = blocks(data)
        if not parts or self.good is None or self.bad is None:
            return 0.0
        good = sum(len(self.good.compress(p)) for p in parts)
        bad = sum(len(self.bad.compress(p)) for p in parts)
        return (bad - good) / (len(data) + FRAME_BYTES)

    def score(self, text: str) -> float:
        x = self.model.slope * self.evidence(text.encode("utf-8")) + self.model.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def fit(rows: list[tuple[int, str]]) -> Model:
    """Dictionaries of all rows of each class; the curve is placed on all rows as well, each read
    by dictionaries that were built without its part of them.

    Without both classes every score is the share of good rows (at most 0.95, at least 0.05), or
    one half without labels.
    """
    by = {y: [t.encode("utf-8") for z, t in rows if z == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        share = 0.5 if not rows else min(0.95, max(0.05, len(by[1]) / len(rows)))
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    final, x, y = _dictionaries(by), [], []
    for k in range(FOLDS):
        rest = {z: [t for i, t in enumerate(texts) if i % FOLDS != k] for z, texts in by.items()}
        scorer = Model(*(_dictionaries(rest) if rest[0] and rest[1] else final), 1.0, 0.0).scorer()
        for z, texts in by.items():
            x += [scorer.evidence(t) for t in texts[k::FOLDS]]
            y += [float(z)] * len(texts[k::FOLDS])
    return Model(*final, *logistic(np.array(x), np.array(y)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class, none of the held-out fold."""
    return fit(sample(docs, labels, "quality", MODULUS, REMAINDER, per_class))


def classify(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Adds ``score`` (0 to 1) to every row of ``docs``, replacing a column of that name in any case.

    Narrow: each whole text is compressed in blocks where it lies; a null text counts as empty
    and gets the curve's value at no evidence. Repeated rows get equal scores.
    """
    source, kept, held, schema = beside_text(docs, text, [(score, "double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for a, b in text_chunks(batch, held):
                part = batch.slice(a, b - a)
                scores = [scorer.score(t or "") for t in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], pa.array(scores, pa.float64())], [*kept, score])

    return source.mapInArrow(run, schema)
