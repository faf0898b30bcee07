"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import mark, materialize, quoted, settle


#: Bytes of text of one class that come to the driver, at most.
SAMPLE_BYTES = 12 << 20


def held_out(key: str, modulus: int, remainder: int):
    """Whether a document belongs to the fold that labels are never learned from."""
    return F.coalesce(F.crc32(quoted(key).cast("string")) % modulus == remainder, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, prior: float | None = None, alike: bool = True, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, classes weighing alike or by their rows. The slope is drawn
    towards ``prior`` as by a few more rows, or slightly shrunk."""
    centre, scale = float(np.mean(x)), float(np.std(x)) or 1.0
    design, w = np.column_stack([(x - centre) / scale, np.ones(len(x))]), np.zeros(2)
    weight, shrink = np.where(y == 1, 0.5 / np.mean(y), 0.5 / (1 - np.mean(y))) if alike else np.ones(len(y)), np.array([1e-2 if prior is None else 2.0, 1e-3])
    middle = np.array([0.0 if prior is None else prior * scale, 0.0])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (shrink * (w - middle) ** 2).sum() / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (weight * (p - y)) + shrink * (w - middle)
        hess = (design.T * (weight * p * (1 - p) + 1e-9)) @ design + np.diag(shrink)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int | tuple[int, int], key: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str]]:
    """``(label, whole text)`` of at most ``per_class`` labelled rows of each class (one bound, or one for
    label 0 and one for label 1), none held out.

    The rows are those with the least hashes of their key that have a text: the same on every run
    and at every size of cluster. What comes to the driver is bounded in bytes, too: a text that
    would take its class over ``most_bytes`` is left out. As many keys as the bounds say are broadcast.
    Rows of one key and text count once; one key of many texts has all of them, within that bound.
    """
    known = (
        labels.select(quoted(key).alias("k"), quoted(label).cast("int").alias("y"))
        .where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k", modulus, remainder))
        .groupBy("k")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64("k"))
    )
    found = docs.select(quoted(key).alias("k"), quoted(text).cast("string").alias("t")).where("k is not null and t is not null")
    since = mark()
    known = materialize(known.join(found.select("k"), "k", "left_semi"), "labelled")
    ids = []
    for y, most in enumerate((per_class, per_class) if isinstance(per_class, int) else per_class):
        ids += [(r["k"], y, r["h"]) for r in known.where(F.col("y") == y).orderBy("h", "k").limit(most).collect()]
    if not ids:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, known.select("k", "y", "h").schema))
    texts = settle(found.join(wanted, "k").select("k", "y", "h", "t", F.octet_length("t").alias("size")), since, "sample")
    # rows of one key are ordered by their texts' hashes
    sizes = texts.select("y", "h", "k", F.xxhash64("t").alias("th"), "size").distinct().orderBy("y", "h", "k", "th").collect()
    kept, total = [], {0: 0, 1: 0}
    for r in sizes:
        if total[r["y"]] + r["size"] <= most_bytes:
            kept.append((r["k"], r["th"]))
            total[r["y"]] += r["size"]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(kept, "k " + known.schema["k"].dataType.simpleString() + ", th long"))
    rows = texts.withColumn("th", F.xxhash64("t")).join(chosen, ["k", "th"]).dropDuplicates(["k", "th"]).orderBy("y", "h", "k", "th").select("y", "t").collect()
    return [(r["y"], r["t"]) for r in rows]
