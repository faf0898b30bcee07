"""Preparing and scoring planner rows: splits, rebalancing, chat rows, plan outputs."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators.graph import Graph

#: fixed values
SPLITS = {"train": "train", "validation": "valid", "release_eval": "test"}
LOCAL = "local_safe"


def rebalance(rows: DataFrame, family: str = "family", order: str = "idx") -> DataFrame:
    """Rows of each family repeated in turn up to the largest family's count, at most three times each.

    Adds ``repeat_index``. Turn order is ``order``; the numbering is one window a family.
    """
    n = rows.groupBy(family).agg(F.count("*").alias("__n"))
    most = n.agg(F.max("__n").alias("__most")).first()["__most"] or 0
    sized = n.withColumn("__target", F.least(F.lit(most), 3 * F.col("__n")))
    turn = F.row_number().over(Window.partitionBy(family).orderBy(order)) - 1
    numbered = rows.withColumn("__turn", turn).join(sized, family)
    at = F.explode(F.sequence(F.col("__turn").cast("long"), F.col("__target") - 1, F.col("__n")))
    return numbered.where(F.col("__turn") < F.col("__target")).withColumn("repeat_index", at).drop("__turn", "__n", "__target")


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("rows"))


def router_rows(rows: DataFrame) -> DataFrame:
    """``question, label, split, source_route_label, family``; local-safe questions route locally."""
    label = F.when(F.col("route_label") == LOCAL, F.lit("local")).otherwise(F.col("route_label"))
    return rows.select("question", label.alias("label"), "split", F.col("route_label").alias("source_route_label"), "family")


def planner_rows(rows: DataFrame, augmentation: DataFrame | None = None) -> DataFrame:
    """Local-safe rows; an augmentation joins the training split alone."""
    out = rows.where(F.col("route_label") == LOCAL)
    if augmentation is None:
        return out
    return out.unionByName(augmentation.where(F.col("route_label") == LOCAL).withColumn("split", F.lit("train")), allowMissingColumns=True)


def row_graphs(rows: DataFrame, graphs: DataFrame) -> DataFrame:
    """Planner rows with the synthetic graphs they were made from: ``row_id, place, graph_id, found`` and
    the graphs' other columns, one row for each of ``source_graph_ids``, which keep their order.

    ``found`` is false for an id that no graph has; a row without ids has one line, of a null id.
    """
    ids = rows.select("row_id", F.posexplode_outer("source_graph_ids").alias("place", "graph_id"))
    return ids.join(graphs.withColumn("found", F.lit(True)), "graph_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def graph_errors(rows: DataFrame, graphs: DataFrame) -> DataFrame:
    """``row_id, error`` of planner rows that name no graph, or graphs that there are not."""
    lost = row_graphs(rows, graphs.select("graph_id").distinct()).where("not found")
    listed = F.array_sort(F.collect_list(F.when(F.col("graph_id").isNotNull(), F.struct("place", "graph_id"))))
    unknown = F.array_join(F.transform(listed, lambda x: x["graph_id"]), ", ")
    per = lost.groupBy("row_id").agg(unknown.alias("ids"))
    return per.select("row_id", F.when(F.col("ids") == "", "no source graphs").otherwise(F.concat(F.lit("unknown graphs: "), "ids")).alias("error"))


def chat_messages(system: Column, question: Column, answer: Column) -> Column:
    """``[{role, content}]`` of one training example."""
    return F.array(*[F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", system), ("user", question), ("assistant", answer))])


def token_preflight(lengths: DataFrame, limit: int) -> DataFrame:
    """Rows, greatest lengths, and rows whose prompt fills the window, of ``prompt, completion``."""
    full = F.col("prompt") + F.col("completion")
    return lengths.agg(
        F.count("*").alias("rows"),
        F.max(full).alias("max_full"),
        F.max("prompt").alias("max_prompt"),
        F.max("completion").alias("max_completion"),
        F.count_if(F.least(full, F.lit(limit)) <= F.col("prompt")).alias("prompt_fills_window"),
    )


def row_text(df: DataFrame) -> DataFrame:
    """``row``: the text by which rows are compared, whatever the order of their columns."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row"))


def same_rows(a: DataFrame, b: DataFrame, ordered: bool = False) -> bool:
    """Whether two results are the same multiset, or sequence where order counts."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    x, y = row_text(a), row_text(b)
    if ordered:  # rankings, so few rows
        return [r["row"] for r in x.collect()] == [r["row"] for r in y.collect()]
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def evaluate_plan(predicted: Mapping[str, Any] | None, expected: Mapping[str, Any], graph: Graph) -> dict[str, bool]:
    """Flags of one predicted plan: parsed, of the contract, family, same plan, same output."""
    from orrery.plans import Plan, Refusal, execute

    flags = {"parsed": predicted is not None, "contract": False, "family": False, "exact_plan": False, "correct_output": False}
    if predicted is None:
        return flags
    try:
        plan, want = Plan.parse(predicted), Plan.parse(expected)
    except ValueError:
        return flags
    flags |= {"contract": True, "family": plan.family == want.family, "exact_plan": plan == want}
    rows, truth = execute(plan, graph), execute(want, graph)
    if not isinstance(rows, Refusal) and not isinstance(truth, Refusal):
        flags["correct_output"] = same_rows(rows, truth, ordered=want.family == "ranking_topk")
    return flags


def planner_metrics(flags: DataFrame) -> DataFrame:
    """Rates of boolean flag columns, by family."""
    names = [f.name for f in flags.schema if f.dataType.simpleString() == "boolean"]
    return flags.groupBy("family").agg(F.count("*").alias("rows"), *[F.avg(F.col(n).cast("double")).alias(f"{n}_rate") for n in names])
