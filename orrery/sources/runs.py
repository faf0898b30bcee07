"""Run folders and datasets: staged results, status, planner splits, nested graphs.

Folders are moved by Hadoop's file systems, so a result is on any store either whole or absent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.prepare import SPLITS
from orrery.storage import delete_path, materialize


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put ``staged`` in the place of ``path``: what is there steps aside first and goes last, and
    comes back if the staged folder can't be moved, which then stays as well."""
    new, fs = _fs(spark, staged)
    here, _ = _fs(spark, path)
    aside, _ = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")
    fs.mkdirs(here.getParent())
    had = fs.exists(here)
    if had and not fs.rename(here, aside):
        raise OSError(f"{path} could not be moved aside")
    try:
        if not fs.rename(new, here):
            raise OSError(f"{staged} could not be moved to {path}")
    except BaseException:
        if had:
            fs.rename(aside, here)
        raise
    if had:
        fs.delete(aside, True)


def swap_in(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` a folder beside ``path``, then put it in its place; a failure leaves ``path`` as it was."""
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex[:8]}"
    try:
        write(staged)
    except BaseException:
        delete_path(spark, staged)
        raise
    _replace(spark, staged, path)


def finish_run(spark: SparkSession, staged: str, root: str, token: str, succeeded: bool, latest: bool = True) -> str:
    """Move a staged run to ``latest`` (what was there goes), to ``runs/token`` or to ``failed/token``."""
    where = f"{root}/failed/{token}" if not succeeded else f"{root}/latest" if latest else f"{root}/runs/{token}"
    _replace(spark, staged, where)
    return where


def status_report(states: DataFrame, loaded: DataFrame) -> DataFrame:
    """``company, has_outputs, is_loaded`` of companies with outputs (``company``) and loaded ones."""
    a = states.select("company").distinct().withColumn("o", F.lit(True))
    b = loaded.select("company").distinct().withColumn("l", F.lit(True))
    out = a.join(b, "company", "full_outer")
    return out.select("company", F.coalesce("o", F.lit(False)).alias("has_outputs"), F.coalesce("l", F.lit(False)).alias("is_loaded"))


def health_summary(checks: DataFrame) -> DataFrame:
    """``ok, warn, fail``: how many checks have each ``status``."""
    return checks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "fail")])


def company_name(summary_name: Column, source_stem: Column, slug: Column) -> Column:
    """A run's company: its summary's, else the source file's, else the folder's."""
    from orrery.functions.text import company_from_stem, title

    named = F.when(F.trim(summary_name) != "", F.trim(summary_name))
    stem = F.when(source_stem != "", company_from_stem(source_stem))
    return F.coalesce(named, stem, title(F.replace(slug, F.lit("_"), F.lit(" "))))


def text_stats(c: Column) -> list[Column]:
    """``content_length, line_count``; a line end at the end begins no line."""
    lines = F.size(F.split(F.regexp_replace(c, r"(\r\n|[\n\r])$", ""), r"\r\n|[\n\r]"))
    return [F.length(c).alias("content_length"), F.when(c == "", 0).otherwise(lines).alias("line_count")]


def compact_json(c: Column) -> Column:
    """JSON text again, keys in order, without spaces; null if it is none."""
    return F.to_json(F.try_parse_json(c))


def read_splits(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of the three splits, with ``split`` and ``idx``, their place in their split."""
    parts = [spark.read.schema(schema).json(f"{root}/{name}.jsonl").withColumn("split", F.lit(split)) for name, split in SPLITS.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.withColumn("idx", F.monotonically_increasing_id())


_LISTS = {
    "places": ("Company", "OPERATES_IN", "Place"),
    "partners": ("Company", "PARTNERS_WITH", "Company"),
    "customer_types": ("BusinessSegment", "SERVES", "CustomerType"),
    "channels": ("BusinessSegment", "SELLS_THROUGH", "Channel"),
    "revenue_models": ("Offering", "MONETIZES_VIA", "RevenueModel"),
}


def flatten_graphs(graphs: DataFrame, max_depth: int = 64) -> DataFrame:
    """Triples (with ``graph_id, company_name``) of nested graphs ``graph_id, graph`` (a variant).

    A graph is one company or ``{companies: [...]}``; offerings nest, so their levels are taken
    one after the other.
    """
    get = lambda c, path, kind: F.try_variant_get(c, path, kind)
    several = get(F.col("graph"), "$.companies", "array<variant>")
    company = graphs.select("graph_id", F.explode(F.coalesce(several, F.array("graph"))).alias("node"))
    company = company.select("graph_id", get(F.col("node"), "$.name", "string").alias("company_name"), "node").withColumn("name", F.col("company_name"))

    def lists(nodes: DataFrame, kind: str) -> list[DataFrame]:
        out = []
        for field, (subject, relation, object_) in _LISTS.items():
            if subject == kind:
                rows = nodes.select("graph_id", "company_name", F.col("name").alias("subject"), F.explode(get(F.col("node"), f"$.{field}", "array<string>")).alias("object"))
                out.append(rows.select("graph_id", "company_name", "subject", F.lit(subject).alias("subject_type"), F.lit(relation).alias("relation"), "object", F.lit(object_).alias("object_type")))
        return out

    def below(nodes: DataFrame, field: str) -> DataFrame:
        rows = nodes.select("graph_id", "company_name", F.col("name").alias("above"), F.explode(get(F.col("node"), f"$.{field}", "array<variant>")).alias("node"))
        return rows.withColumn("name", get(F.col("node"), "$.name", "string"))

    def edges(nodes: DataFrame, subject: str, relation: str, object_: str) -> DataFrame:
        return nodes.select("graph_id", "company_name", F.col("above").alias("subject"), F.lit(subject).alias("subject_type"), F.lit(relation).alias("relation"), F.col("name").alias("object"), F.lit(object_).alias("object_type"))

    segments = below(company, "segments")
    out = [*lists(company, "Company"), edges(segments, "Company", "HAS_SEGMENT", "BusinessSegment"), *lists(segments, "BusinessSegment")]
    level, above = below(segments, "offerings"), "BusinessSegment"
    for _ in range(max_depth):
        shown = materialize(level.withColumn("node", F.to_json("node")), "offerings").withColumn("node", F.parse_json("node"))
        if shown.isEmpty():
            break
        out += [edges(shown, above, "OFFERS", "Offering"), *lists(shown, "Offering")]
        level, above = below(shown, "children"), "Offering"
    else:
        raise RuntimeError(f"offerings nest deeper than {max_depth}")
    triples = out[0]
    for more in out[1:]:
        triples = triples.unionByName(more)
    return triples
