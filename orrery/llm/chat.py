"""Operator 8, chat formatting by multi-party perspective rotation.

A conversation is rendered once for every participant: that speaker's turns are the assistant's
and carry the loss, the others' are turns of named users, system turns stay instructions. A long
conversation is rendered in parts of ``PART`` turns, so that no row and no task holds an
unbounded one; a part's text and loss spans follow from its turns alone.

Turns get their places by one range sort over all conversations. Where a conversation crosses
the sorted partitions, the counts of those partitions are added up; a conversation that holds a
third of all turns is sorted by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import materialize, quoted

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART = 64
SYSTEM = "system"
NOBODY = "unknown"


def numbered_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, place, speaker, content``: turns with their place (from 0) in their conversation.

    Order: turn, then speaker, then the text's hash; null turns come first. A null speaker is
    called ``unknown``, a null text is empty; rows without a conversation are left out.
    """
    rows = turns.select(
        quoted(conversation).cast("long").alias("conv"),
        quoted(turn).cast("long").alias("turn"),
        F.coalesce(quoted(role), F.lit(NOBODY)).alias("speaker"),
        F.coalesce(quoted(text), F.lit("")).alias("content"),
    ).where("conv is not null")
    order = ["conv", "turn", "speaker", "h"]
    ordered = rows.withColumn("h", F.xxhash64("content")).repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "speaker", "content")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.asarray(batch.column("conv"))
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = last is None or conv[0] != last
            index = np.arange(len(conv))
            head = np.maximum.accumulate(np.where(new, index, -1))
            place = np.where(head >= 0, index - head, index + seen)
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(np.full(len(conv), task, np.int32)), pa.array(place), batch.column("speaker"), batch.column("content")], ["conv", "task", "local", "speaker", "content"])

    local = materialize(ordered.mapInArrow(number, "conv long, task int, local long, speaker string, content string"), "turns")
    counts = local.groupBy("conv", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("shift", F.sum("n").over(before)).where("shift is not null").select("conv", "task", "shift")
    return local.join(shift, ["conv", "task"], "left").select("conv", (F.col("local") + F.coalesce("shift", F.lit(0))).alias("place"), "speaker", "content")


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, perspective, part, n_turns, rendered, loss_spans, loss_chars``.

    One row for every conversation, participant and part of ``PART`` turns. ``loss_spans`` are
    ``start-end,...`` in characters of ``rendered``: the perspective's contents and the markers
    that end them. Markers inside a content are broken by a space. The system is no participant;
    a conversation without any other speaker is rendered once, its perspective null. Repeated
    turns are rendered as often as they occur. Empty in, empty out.
    """
    placed = materialize(numbered_turns(turns, conversation, turn, role, text), "places")
    people = placed.where(F.col("speaker") != SYSTEM).select(F.col("conv"), F.col("speaker").alias("perspective")).distinct()
    safe = F.replace(F.replace(F.col("content"), F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    head = F.when(own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit("system")).otherwise(F.concat(F.lit("user name="), F.regexp_replace("speaker", r"\s", "_")))
    segments = placed.join(people, "conv", "left").select(
        "conv",
        "perspective",
        F.floor(F.col("place") / PART).alias("part"),
        "place",
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("lead"),
        F.concat(safe, F.lit(CLOSE)).alias("body"),
        own.alias("own"),
    )
    parts = segments.groupBy("conv", "perspective", "part").agg(F.sort_array(F.collect_list(F.struct("place", "lead", "body", "own"))).alias("turns"))
    size = lambda x: F.length(x["lead"]) + F.length(x["body"]) + 1
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans")),
        lambda t, x: F.struct(
            (t["at"] + size(x)).alias("at"),
            F.when(x["own"], F.concat(t["spans"], F.array(F.struct((t["at"] + F.length(x["lead"])).alias("s"), (t["at"] + size(x) - 1).alias("e"))))).otherwise(t["spans"]).alias("spans"),
        ),
        lambda t: t["spans"],
    )
    out = parts.select(
        F.col("conv").alias("conv_id"),
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["lead"], x["body"], F.lit("\n"))), "").alias("rendered"),
        spans.alias("spans"),
    )
    shown = F.array_join(F.transform("spans", lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"])
    return out.select("conv_id", "perspective", "part", "n_turns", "rendered", shown.alias("loss_spans"), total.alias("loss_chars"))
