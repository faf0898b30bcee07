"""Comparing predicted with gold graphs: exact, relaxed, aggregated, resampled, between annotators.

Frames hold many comparisons at once; ``group`` columns (company, pipeline, split) tell them apart.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery import storage
from orrery.functions import text
from orrery.operators.validate import FIELDS, clean_triples

#: fixed values
EXACT, ALIAS, HIERARCHY, ROLLUP = 1.0, 0.9, 0.75, 0.5


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall(tp: Column, fp: Column, fn: Column, prefix: str = "") -> list[Column]:
    """Columns precision, recall, f1; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias(f"{prefix}precision"), r.alias(f"{prefix}recall"), ratio(2 * p * r, p + r).alias(f"{prefix}f1")]


def keyed(triples: DataFrame) -> DataFrame:
    """Cleaned triples with ``s`` and ``o``, the keys of their names."""
    rows = clean_triples(triples, evaluator=True)
    return rows.withColumn("s", text.canonical_key(F.col("subject"), True)).withColumn("o", text.canonical_key(F.col("object"), True))


def exact(gold: DataFrame, predicted: DataFrame, group: list[str]) -> DataFrame:
    """True positives, false positives, false negatives of edges, and their rates, by group."""
    key = [*group, "s", "relation", "o"]
    g, p = keyed(gold).select(*key).distinct(), keyed(predicted).select(*key).distinct()
    both = g.withColumn("__g", F.lit(1)).join(p.withColumn("__p", F.lit(1)), key, "full_outer")
    hit = F.col("__g").isNotNull() & F.col("__p").isNotNull()
    counts = both.groupBy(*group).agg(F.count_if(hit).alias("true_positives"), F.count_if(F.col("__g").isNull()).alias("false_positives"), F.count_if(F.col("__p").isNull()).alias("false_negatives"))
    return counts.select("*", *precision_recall(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")))


# ---------------------------------------------------------------- relaxed matching


def by_sorting(df: DataFrame) -> DataFrame:
    """``df`` for joins that broadcast neither side. Spark judges a table by its compressed file: one
    of some megabytes, in which names repeat, takes a hundred times that in the driver's memory."""
    return df.hint("merge")


def hierarchy_closure(triples: DataFrame, group: list[str], max_depth: int = 64) -> DataFrame:
    """``group, type, key, below_type, below_key`` over segments and offerings, without the node itself."""
    step = triples.where("relation in ('HAS_SEGMENT', 'OFFERS')").select(*group, F.col("subject_type").alias("type"), F.col("s").alias("key"), F.col("object_type").alias("below_type"), F.col("o").alias("below_key")).distinct()
    level = reached = storage.materialize(step, "hierarchy")
    cols = [*group, "type", "key", "below_type", "below_key"]
    for _ in range(max_depth):
        next_ = level.withColumnsRenamed({"below_type": "mid_type", "below_key": "mid_key"}).join(step.withColumnsRenamed({"type": "mid_type", "key": "mid_key"}).transform(by_sorting), [*group, "mid_type", "mid_key"])
        level = storage.materialize(next_.select(*cols).distinct().join(by_sorting(reached), cols, "left_anti"), "hierarchy")
        if level.isEmpty():
            return reached
        reached = reached.unionByName(level)
    raise RuntimeError(f"the hierarchy is deeper than {max_depth}")


def candidates(gold: DataFrame, predicted: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of a gold and a predicted triple with the best reason to match, and its weight.

    A pair can only match if relation and types agree, and then one of its ends agrees or is
    related; so each reason is an equi-join of its own, and the best reason of a pair is kept.
    """
    key = [*group, "s", "subject_type", "relation", "o", "object_type"]
    block = [*group, "subject_type", "relation", "object_type"]

    def sided(triples: DataFrame, name: str) -> DataFrame:
        """The different triples, with the alias keys of companies; written, as they are joined many times."""
        rows = keyed(triples).dropDuplicates(key)
        for side in ("subject", "object"):
            rows = rows.withColumn(f"a{side[0]}", F.when(F.col(f"{side}_type") == "Company", text.company_alias_key(F.col(side))).otherwise(F.lit("")))
        return storage.materialize(rows.select(*block, "s", "o", "as", "ao"), name)

    g, p = sided(gold, "gold"), sided(predicted, "predicted")
    context = g.unionByName(p)
    cols = ["s", "o", "as", "ao"]
    g = by_sorting(g.select(*block, *[F.col(c).alias(f"g_{c}") for c in cols]))
    p = by_sorting(p.select(*block, *[F.col(c).alias(f"p_{c}") for c in cols]))
    ends = ["g_s", "g_o", "p_s", "p_o"]
    out: list[DataFrame] = []

    def add(pairs: DataFrame, weight: float, reason: str) -> None:
        out.append(pairs.select(*block, *ends, F.lit(weight).alias("weight"), F.lit(reason).alias("reason")))

    def ends_match(side: str) -> Column:
        name = {"s": "subject", "o": "object"}[side]
        return (F.col(f"g_{side}") == F.col(f"p_{side}")) | ((F.col(f"{name}_type") == "Company") & text.alias_keys_compatible(F.col(f"g_a{side}"), F.col(f"p_a{side}")))

    add(g.join(p.withColumn("g_s", F.col("p_s")).withColumn("g_o", F.col("p_o")), [*block, "g_s", "g_o"]), EXACT, "exact")
    # one end equal by key; or both, or one, companies whose names are compatible: those begin alike
    on_object = g.join(p.withColumn("g_o", F.col("p_o")), [*block, "g_o"])
    on_subject = g.join(p.withColumn("g_s", F.col("p_s")), [*block, "g_s"])
    start = lambda df, c: df.withColumn("__start", F.substring(c, 1, 5))
    companies = lambda side: start(g.where(F.col({"s": "subject_type", "o": "object_type"}[side]) == "Company"), F.col(f"g_a{side}")).join(
        start(p, F.col(f"p_a{side}")), [*block, "__start"]
    ).drop("__start").where(ends_match(side))
    order = [*block, *ends, "g_as", "g_ao", "p_as", "p_ao"]
    subject_ok = on_subject.select(*order).unionByName(companies("s").select(*order)).distinct()
    object_ok = on_object.select(*order).unionByName(companies("o").select(*order)).distinct()
    add(subject_ok.where(ends_match("o")), ALIAS, "company_alias_or_lexical_normalization")

    closure = hierarchy_closure(context, group)
    both_ways = closure.where("type = below_type").select(*group, "type", F.col("key").alias("x"), F.col("below_key").alias("y"))
    both_ways = both_ways.unionByName(both_ways.select(*group, "type", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    related = lambda pairs, side: pairs.join(
        by_sorting(both_ways).withColumnsRenamed({"type": {"s": "subject_type", "o": "object_type"}[side], "x": f"g_{side}", "y": f"p_{side}"}), [*group, {"s": "subject_type", "o": "object_type"}[side], f"g_{side}", f"p_{side}"], "left_semi"
    )
    add(related(object_ok, "s").unionByName(object_ok.where("g_s = p_s")), HIERARCHY, "subject_parent_child")
    add(related(subject_ok, "o").unionByName(subject_ok.where("g_o = p_o")), HIERARCHY, "object_parent_child")

    offered = context.where("relation = 'OFFERS' and subject_type = 'BusinessSegment' and object_type = 'Offering'").select(*group, "s", "o").distinct()
    owned = context.where("relation = 'HAS_SEGMENT' and object_type = 'BusinessSegment'").select(*group, F.col("o").alias("seg"), F.col("s").alias("owner")).distinct()

    def share(table: DataFrame, unit: str, by: str) -> DataFrame:
        a = table.select(*group, F.col(unit).alias("x"), by)
        return a.join(by_sorting(table.select(*group, F.col(unit).alias("y"), by)), [*group, by]).select(*group, "x", "y").distinct()

    segments = both_ways.where("type = 'BusinessSegment'").select(*group, "x", "y")
    alike = segments.unionByName(share(offered, "s", "o")).distinct()
    owners = share(owned, "seg", "owner")
    rolled = lambda pairs, x, y, also: pairs.join(by_sorting(also).withColumnsRenamed({"x": x, "y": y}), [*group, x, y], "left_semi")
    by_segment = object_ok.where("subject_type = 'BusinessSegment'")
    add(rolled(by_segment, "g_s", "p_s", alike).unionByName(rolled(by_segment, "g_s", "p_s", owners)), ROLLUP, "subject_segment_rollup")
    by_company = subject_ok.where("relation = 'HAS_SEGMENT' and object_type = 'BusinessSegment'")
    # with the roles turned the two objects compared are the segments themselves
    add(rolled(by_company, "g_o", "p_o", alike), ROLLUP, "segment_rollup")

    rank = F.struct((-F.col("weight")).alias("w"), F.when(F.col("reason") == "subject_parent_child", 0).when(F.col("reason") == "object_parent_child", 1).when(F.col("reason") == "subject_segment_rollup", 2).otherwise(3).alias("n"))
    every = reduce(DataFrame.unionByName, out)
    return every.groupBy(*block, *ends).agg(F.min_by(F.struct("weight", "reason"), rank).alias("best")).select(*block, *ends, "best.weight", "best.reason")


#: Pairs of one block (a group, relation and types) that one task goes through in order, at most.
BLOCK_PAIRS = 1_000_000


def greedy(pairs: DataFrame, group: list[str], block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One-to-one matches in order of weight, reason, gold key, predicted key.

    Pairs of different blocks share no triple. A block of at most ``block_pairs`` is gone through
    in order as a sorted stream, of which a task holds the triples that have been matched. Larger
    ones are settled in rounds by many tasks: a pair that is the first of both its ends is a match,
    and takes all pairs of its ends away. The order is total, so the outcome is the same.
    """
    block = [*group, "subject_type", "relation", "object_type"]
    tie = F.struct((-F.col("weight")).alias("w"), "reason", F.struct("g_s", "g_o").alias("g"), F.struct("p_s", "p_o").alias("p"))
    pairs = storage.materialize(pairs.withColumn("__rank", tie), "pairs")
    large = pairs.groupBy(*block).agg(F.count("*").alias("n")).where(F.col("n") > block_pairs).select(*[F.col(c).alias(f"__{n}") for n, c in enumerate(block)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{n}")) for n, c in enumerate(block)])
    if large.isEmpty():
        return _in_order(pairs, block)
    large = storage.materialize(large, "blocks")
    return _in_order(pairs.join(large, same, "left_anti"), block).unionByName(_in_rounds(pairs.join(large, same, "left_semi"), block))


def _in_order(pairs: DataFrame, block: list[str]) -> DataFrame:
    columns = [c for c in pairs.columns if c != "__rank"]
    ordered = pairs.repartition(*block).sortWithinPartitions(*block, "__rank").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, gold, predicted = None, set(), set()
        joined = lambda batch, names: zip(*[batch.column(c).to_pylist() for c in names], strict=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            # blocks are long runs of equal rows: only their first rows are read
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in block:
                x = batch.column(c)
                new[1:] |= ~np.asarray(pc.fill_null(pc.equal(x[1:], x[:-1]), False))
            starts = np.flatnonzero(new)
            names = list(joined(batch.take(pa.array(starts)), block))
            won = np.zeros(batch.num_rows, bool)
            for name, lo, hi in zip(names, starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if name != here:
                    here, gold, predicted = name, set(), set()
                for i, (gs, go, ps, po) in enumerate(joined(batch.slice(lo, hi - lo), ["g_s", "g_o", "p_s", "p_o"]), lo):
                    if (gs, go) not in gold and (ps, po) not in predicted:
                        won[i] = True
                        gold.add((gs, go))
                        predicted.add((ps, po))
            yield batch.filter(pa.array(won, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def _in_rounds(open_: DataFrame, block: list[str]) -> DataFrame:
    gold, predicted = [*block, "g_s", "g_o"], [*block, "p_s", "p_o"]
    open_, done = storage.materialize(open_, "pairs"), []
    while not open_.isEmpty():
        a, b = (open_.groupBy(*ends).agg(F.min("__rank").alias("__rank")) for ends in (gold, predicted))
        won = storage.materialize(open_.join(by_sorting(a), [*gold, "__rank"], "left_semi").join(by_sorting(b), [*predicted, "__rank"], "left_semi"), "matches")
        done.append(won)
        rest = open_.join(by_sorting(won.select(*gold)), gold, "left_anti").join(by_sorting(won.select(*predicted)), predicted, "left_anti")
        last, open_ = open_, storage.materialize(rest, "pairs")
        storage.drop(last)
    return reduce(DataFrame.unionByName, [*done, open_]).drop("__rank")


def relaxed(gold: DataFrame, predicted: DataFrame, group: list[str]) -> DataFrame:
    """Weighted precision, recall and f1 of the greedy matches, by group."""
    gold, predicted = (storage.materialize(df.select(*group, *FIELDS).distinct(), name) for df, name in ((gold, "gold"), (predicted, "predicted")))
    key = [*group, "s", "subject_type", "relation", "o", "object_type"]
    count = lambda df, name: keyed(df).select(*key).distinct().groupBy(*group).agg(F.count("*").alias(name))
    sizes = count(gold, "n_gold").join(count(predicted, "n_predicted"), group, "full_outer").na.fill(0)
    won = greedy(candidates(gold, predicted, group), group).groupBy(*group).agg(F.sum("weight").alias("tp"))
    out = sizes.join(by_sorting(won), group, "left").na.fill(0.0, ["tp"])
    tp = F.col("tp")
    return out.select(*group, tp.alias("relaxed_true_positives"), *precision_recall(tp, F.col("n_predicted") - tp, F.col("n_gold") - tp, "relaxed_"))


# ---------------------------------------------------------------- aggregates


def aggregate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro rates over companies, their macro f1, and how many were evaluated or miss a prediction.

    ``rows`` has counts and ``f1``; a missing prediction has null counts.
    """
    has = F.col("true_positives").isNotNull()
    sums = rows.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("true_positives", "false_positives", "false_negatives")],
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.count_if(has).alias("evaluated_companies"),
        F.count_if(~has).alias("missing_predictions"),
    )
    return sums.select("*", *precision_recall(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")))


def resampled(rows: DataFrame, by: list[str], draws: DataFrame) -> DataFrame:
    """Aggregates of every draw. ``draws(sample, position)`` picks companies by position (from 0)."""
    order = F.row_number().over(Window.partitionBy(*by).orderBy("company")) - 1
    placed = rows.withColumn("position", order)
    # companies times samples: Spark takes draws for as few as what they were made from
    return aggregate(placed.join(by_sorting(draws), "position"), [*by, "sample"])


def scopes(rows: DataFrame, left_out: str) -> DataFrame:
    """``rows`` in two scopes: ``all`` companies, and those ``without`` one of them."""
    return rows.withColumn("scope", F.lit("all")).unionByName(rows.where(F.col("company") != left_out).withColumn("scope", F.lit("without")))


def intervals(samples: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and central 95 % of each metric over the draws, percentiles interpolated."""
    columns = []
    for m in metrics:
        columns += [F.avg(m).alias(f"{m}_mean"), F.percentile(m, F.lit(0.025)).alias(f"{m}_low"), F.percentile(m, F.lit(0.975)).alias(f"{m}_high")]
    return samples.groupBy(*by).agg(*columns)


def seeded_draws(spark: SparkSession, companies: int, samples: int = 1000, seed: int = 20260430) -> DataFrame:
    """Draws with replacement as a seeded sequence of choices makes them; ``companies * samples`` rows."""
    rng = random.Random(seed)
    rows = [(n, rng.choice(range(companies))) for n in range(samples) for _ in range(companies)]
    return spark.createDataFrame(rows, "sample int, position int")


def slots(spark: SparkSession, companies: int, samples: int) -> DataFrame:
    """``sample, slot``, both long: ``companies`` slots a sample, made where they are used."""
    n = max(companies, 1)
    return spark.range(samples * companies).select(F.expr(f"id div {n}L").alias("sample"), (F.col("id") % n).alias("slot"))


def hashed_draws(spark: SparkSession, companies: int, samples: int, seed: str = "") -> DataFrame:
    """Draws with replacement, ``companies`` a sample, from a hash of seed, sample and slot that any engine computes alike."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.col("sample").cast("string"), F.lit(":"), F.col("slot").cast("string")).cast("binary")), 1, 8)
    return slots(spark, companies, samples).select("sample", (F.conv(digits, 16, 10).cast("long") % max(companies, 1)).alias("position"))


# ---------------------------------------------------------------- annotators


def agreement(edges: DataFrame, by: list[str]) -> DataFrame:
    """Average pairwise Jaccard and F1 between annotators' edge sets, and support buckets.

    ``edges``: ``by, annotator, edge``. Two empty sets agree wholly; an annotator without edges in
    a group where others have some counts there.
    """
    people = annotators(edges)
    e = edges.select(*by, "annotator", "edge").distinct()
    every = edges.select(*by).distinct().withColumn("annotator", F.explode(F.array(*map(F.lit, people))))
    size = every.join(e.groupBy(*by, "annotator").agg(F.count("*").alias("n")), [*by, "annotator"], "left").na.fill({"n": 0})
    common = e.withColumnRenamed("annotator", "a").join(e.withColumnRenamed("annotator", "b"), [*by, "edge"]).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("shared"))
    pairs = size.withColumnsRenamed({"annotator": "a", "n": "na"}).join(size.withColumnsRenamed({"annotator": "b", "n": "nb"}), by).where("a < b").join(common, [*by, "a", "b"], "left").na.fill({"shared": 0})
    union = F.col("na") + F.col("nb") - F.col("shared")
    pairs = pairs.withColumn("jaccard", F.when(union == 0, 1.0).otherwise(F.col("shared") / union)).withColumn("f1", F.when(F.col("na") + F.col("nb") == 0, 1.0).otherwise(2 * F.col("shared") / (F.col("na") + F.col("nb"))))
    means = pairs.groupBy(*by).agg(F.avg("jaccard").alias("average_pairwise_jaccard"), F.avg("f1").alias("average_pairwise_f1"))
    return means.join(support(edges, by, len(people)), by)


def reliability(edges: DataFrame) -> DataFrame:
    """``agreement`` of each relation, and of ``all`` of them together, where an edge has its relation in its key."""
    keyed_ = edges.select(F.col("relation").cast("string").alias("relation"), "annotator", F.concat_ws(":", F.col("relation").cast("string"), F.col("edge").cast("string")).alias("edge"))
    return agreement(keyed_.unionByName(keyed_.withColumn("relation", F.lit("all"))), ["relation"])


def annotators(edges: DataFrame, limit: int = 1000) -> list[str]:
    """Names of the annotators: people, so few."""
    names = sorted(r["annotator"] for r in edges.select("annotator").where("annotator is not null").distinct().limit(limit + 1).collect())
    if not 0 < len(names) <= limit:
        raise ValueError(f"{len(names)} annotators")
    return names


def support(edges: DataFrame, by: list[str], n: int) -> DataFrame:
    """Edges that all of ``n`` annotators, more than half, or fewer have, and the share that all have."""
    per = edges.groupBy(*by, "edge").agg(F.count_distinct("annotator").alias("k"))
    out = per.groupBy(*by).agg(
        F.count("*").alias("candidate_edges"),
        F.count_if(F.col("k") == n).alias("unanimous"),
        F.count_if((F.col("k") < n) & (2 * F.col("k") > n)).alias("majority_only"),
        F.count_if((F.col("k") < n) & (2 * F.col("k") <= n)).alias("single_annotator"),
    )
    return out.withColumn("all_way_jaccard", ratio(F.col("unanimous"), F.col("candidate_edges")))
