"""Operator 4, mixing sources to target weights by capped water-filling.

Sources share the total by weight; a source is clamped at ``max_epochs`` times its own size and
what it leaves is reshared by weight, until none is above. The fixed point is found at once: in
ascending order of cap by weight, a source is clamped as long as the share left to it exceeds its
cap. All of that is exact integer arithmetic on one row a source.

A source's documents are then taken whole ``floor(target / size)`` times, and once more in the
order of a seeded hash until the fraction is reached. Only the hash bucket in which it is reached
has to be ordered; buckets are sized by the source's rows, so that no task meets a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import beside_text, fresh, mark, materialize, quoted, settle, text_chunks, utf8, word_spans

MAX_EPOCHS = 3
#: Rows that a hash bucket of a source has, about.
BUCKET_ROWS = 4096
#: Digits of the hash by which the bucket where a source's fraction is reached is narrowed at once.
LEVEL_DIGITS = 3
SEED = "mix-1"


def word_counts(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """Adds the number of words ``[^\\x20\\x09-\\x0D]+`` of whole texts (null: 0), in place of the text."""
    source, kept, held, schema = beside_text(docs, text, [(size, "long")], drop_text=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch, held):
                part = batch.slice(a, b - a)
                counts = np.diff(word_spans(*utf8(part.column(len(kept))))[2])
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], pa.array(counts, pa.int64())], [*kept, size])

    return source.mapInArrow(run, schema)


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, n_rows, source_size, target`` of every source of ``sizes(source, size)``.

    Weights are 1, 2, 3, repeating in code-point order of the sources, null last. One row a
    source is all that is ordered.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    by = by.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1)
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "w", "source")
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    whole = lambda c: c.cast("decimal(38,0)")
    cap = F.col("source_size") * max_epochs
    by = (
        by.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(below), F.lit(0)))
        .withColumn("weights", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0)))
        .withColumn("clamped", whole(F.col("left")) * F.col("w") > whole(cap) * F.col("weights"))
    )
    # the first source that is not clamped sets the level of all after it
    level = F.min(F.when(~F.col("clamped"), F.struct("source_size_by_weight", "w", "source", "left", "weights"))).over(everything)
    by = by.withColumn("source_size_by_weight", F.col("source_size") / F.col("w")).withColumn("level", level)
    shared = F.col("w") * F.col("level.left") / F.col("level.weights")
    return by.select("source", "n_rows", "source_size", F.when(F.col("clamped"), cap.cast("double")).otherwise(shared.cast("double")).alias("target"))


def _digits(rows: Column) -> Column:
    """Hexadecimal digits of the hash that leave ``BUCKET_ROWS`` rows a bucket."""
    return F.greatest(F.lit(0), F.ceil(F.log2(rows / BUCKET_ROWS) / 4)).cast("int")


def _edges(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``s, edge, before``: of each source with a fraction to take the bucket of hashes in which it is
    reached, and the words before that bucket. Found ``LEVEL_DIGITS`` digits at a time, so that a
    source never has more than ``16 ** LEVEL_DIGITS`` rows to order, however many its own."""
    wanted = plan.where("extra > 0").select(F.col("source").alias("s"), "digits", "extra")
    edge = wanted.select("*", F.lit("").alias("edge"), F.lit(0).cast("long").alias("before"))
    deepest = plan.agg(F.max("digits")).first()[0] or 0
    for at in range(LEVEL_DIGITS, deepest + LEVEL_DIGITS, LEVEL_DIGITS):
        inside = rows.join(edge, rows["source"].eqNullSafe(F.col("s")) & F.startswith("h", "edge"))
        bucket = F.expr(f"substr(h, 1, least(digits, {at}))")
        sums = inside.groupBy("s", "digits", "extra", "before", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("in_bucket").over(run), F.lit(0)))
        # the fraction is reached in the last bucket that begins below it
        last = sums.where(F.col("before") < F.col("extra")).groupBy("s", "digits", "extra").agg(F.max(F.struct("bucket", "before")).alias("last"))
        edge = materialize(last.select("s", "digits", "extra", F.col("last.bucket").alias("edge"), F.col("last.before").alias("before")), "edges")
    return edge.select("s", "edge", "before")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_epochs: int = MAX_EPOCHS, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, repeats, taken`` of every row of ``docs``, and its columns ``keep``.

    ``taken = repeats * size`` words, ``repeats`` at most ``max_epochs``. The order within a
    source is that of ``md5(seed:key)``, then the key, then the size; a null key counts as empty text. A source's
    taken words miss its target by at most half of one document. Null texts have size 0; a source
    without words has target 0. Repeated rows are taken each for itself. Empty in, empty out. No
    column of ``docs`` but these is read, whatever its name.
    """
    since = mark()
    rows = word_counts(docs.select(quoted(key).alias("doc_id"), quoted(source).alias("source"), quoted(text).alias("text"), *[quoted(c) for c in keep]))
    rows = materialize(rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "sizes")
    plan = targets(rows).withColumn("digits", _digits(F.col("n_rows")))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0))
    plan = materialize(plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    p = plan.join(_edges(rows, plan), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    p = p.select(F.col("source").alias("s"), "digits", "whole", "extra", "source_size", "target", "edge", "before")
    out = rows.join(p, rows["source"].eqNullSafe(F.col("s"))).drop("s")
    out = out.withColumn("bucket", F.expr("substr(h, 1, digits)"))
    taken = lambda more: F.col("whole") + more
    away = out.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge")))
    away = away.withColumn("repeats", taken(F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0)))
    inside = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = out.where(F.col("bucket") == F.col("edge"))
    at = at.withColumn("cum", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = at.withColumn("repeats", taken(F.when(2 * F.col("cum") + F.col("size") <= 2 * F.col("extra"), 1).otherwise(0))).drop("cum")
    both = away.unionByName(at)
    both = both.select("doc_id", "source", "size", "source_size", "target", F.least(F.col("repeats"), F.lit(max_epochs)).cast("long").alias("repeats"), *[quoted(c) for c in keep])
    return settle(both.withColumn("taken", F.col("repeats") * F.col("size")), since, "mix")


def repeat_rows(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` as mixed: every row as often as ``mix`` takes it, rows that it does not take left out.

    Equal rows are taken together: as many of them come out as ``mix`` takes of all of them.
    """
    names = docs.columns
    row, one, other, times, n, copy = fresh([*names, "doc_id", "source", "text", "size", "h", "repeats", "taken"], "row", "one", "other", "times", "n", "copy")
    keyed = docs.withColumn(row, F.xxhash64(*[quoted(c) for c in names]))
    mixed = mix(keyed, key, source, text, max_epochs, seed, (row,)).groupBy(F.col("doc_id").alias(one), F.col(row).alias(other)).agg(F.sum("repeats").alias(times), F.count("*").alias(n))
    same = quoted(key).eqNullSafe(F.col(one)) & (F.col(row) == F.col(other))
    again = mixed.where(F.col(n) > 1).select(one, other)
    if not again.isEmpty():
        keyed = keyed.join(again, same, "left_anti").unionByName(keyed.join(again, same, "left_semi").dropDuplicates([key, row]))
    joined = keyed.join(mixed.where(F.col(times) > 0).select(one, other, times), same)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[quoted(c) for c in names])
