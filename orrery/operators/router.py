"""Routing of questions: probabilities, decisions, metrics, and the guards on query text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.functions.vocabulary import ROUTES
from orrery.operators.evaluate import ratio

LOCAL_THRESHOLD = 0.97
# fixed values
WRITE_CLAUSES = ("CREATE", "MERGE", "DELETE", "DETACH", "DROP", "SET", "REMOVE", "CALL", "LOAD CSV")
WRITE_WORDS = r"(?i)\b(add|create|delete|drop|insert|load|merge|remove|set|update|upsert|write)\b"
TIME_WORDS = r"(?i)\b(\d{4}|quarter|q[1-4]|month|week|year|yoy|over time|trend|historic)\b"


def probabilities(logits: Column, temperature: float = 1.0) -> Column:
    """Of the routes, in their fixed order."""
    return text.softmax(logits, temperature)


def decide(probs: Column, threshold: float = LOCAL_THRESHOLD) -> Column:
    """``local`` if sure enough; else ``refuse`` unless the fallback is likelier."""
    fallback, local, refuse = (F.element_at(probs, i) for i in (1, 2, 3))
    return F.when(local >= threshold, "local").when(refuse >= fallback, "refuse").otherwise("api_fallback")


def argmax(logits: Column) -> Column:
    """The first route of the greatest logit."""
    return F.element_at(F.array(*map(F.lit, ROUTES)), F.array_position(logits, F.array_max(logits)).cast("int"))


def confusion(rows: DataFrame) -> DataFrame:
    """``label``, then one column a predicted route; rows have ``label`` and ``predicted``."""
    return rows.groupBy("label").pivot("predicted", list(ROUTES)).count().na.fill(0)


def metrics(rows: DataFrame, zero_precision: float = 0.0) -> DataFrame:
    """``label, precision, recall, f1, support, predicted_count`` of every route.

    ``zero_precision`` is the precision of a route that is never predicted: 0 in evaluation, 1
    while training.
    """
    per = rows.select(F.explode(F.array(F.struct(F.col("label").alias("route"), F.lit(1).alias("is"), F.lit(0).alias("was")), F.struct(F.col("predicted").alias("route"), F.lit(0).alias("is"), F.lit(1).alias("was")))).alias("x"), (F.col("label") == F.col("predicted")).cast("int").alias("hit"))
    every = rows.sparkSession.createDataFrame([(r,) for r in ROUTES], "label string")
    sums = per.groupBy(F.col("x.route").alias("label")).agg(F.sum(F.col("x.is")).alias("support"), F.sum(F.col("x.was")).alias("predicted_count"), F.sum(F.col("hit") * F.col("x.is")).alias("hits"))
    out = every.join(sums, "label", "left").na.fill(0)
    precision = F.when(F.col("predicted_count") == 0, F.lit(zero_precision)).otherwise(ratio(F.col("hits"), F.col("predicted_count")))
    recall = ratio(F.col("hits"), F.col("support"))
    return out.select("label", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), "support", "predicted_count")


def overall(rows: DataFrame) -> DataFrame:
    """``accuracy, macro_f1`` over the routes."""
    mean = metrics(rows).agg(F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"))
    right = rows.agg(F.count_if(F.col("label") == F.col("predicted")).alias("right"))
    return mean.withColumn("k", F.lit(0)).join(right.withColumn("k", F.lit(0)), "k").select(ratio(F.col("right"), F.col("n")).alias("accuracy"), "macro_f1")


def gate_open(rows: DataFrame, least: float = LOCAL_THRESHOLD) -> DataFrame:
    """``planner_gate_open``: whether anything is routed locally, and precisely enough."""
    return rows.where("predicted = 'local'").agg((F.coalesce(F.avg((F.col("label") == "local").cast("double")), F.lit(-1.0)) >= least).alias("planner_gate_open"))


def class_weights(rows: DataFrame) -> DataFrame:
    """``label, weight``: rows over three times the label's rows."""
    per = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.withColumn("k", F.lit(0)).join(total.withColumn("k", F.lit(0)), "k").select("label", (F.col("total") / (F.lit(len(ROUTES)) * F.col("n"))).alias("weight"))


def refusal_reason(question: Column) -> Column:
    return F.when(question.rlike(WRITE_WORDS), "write_request").when(question.rlike(TIME_WORDS), "unsupported_time").otherwise("beyond_local_coverage")


def forbidden_clauses(query: Column) -> Column:
    """Writing clauses that occur in a query's text, as words, in their fixed order."""
    found = [F.when(query.rlike(r"(?i)\b" + c.replace(" ", r"\s+") + r"\b"), F.lit(c)) for c in WRITE_CLAUSES]
    return F.array_compact(F.array(*found))


def parameters_match(query: Column, names: Column) -> Column:
    """Whether the ``$names`` of a query are those provided."""
    used = F.regexp_extract_all(query, F.lit(r"\$([A-Za-z_]\w*)"), 1)
    return F.array_sort(F.array_distinct(used)) == F.array_sort(F.array_distinct(names))
