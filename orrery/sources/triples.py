"""Files of triples: gold lines, predictions, annotators' edges, payload texts, run folders.

Paths are left to Spark's readers, so any store that Spark knows will do.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import text
from orrery.operators.graph import TRIPLE
from orrery.operators.validate import FIELDS, clean_triples

ENTRIES = f"array<struct<{', '.join(x.replace(' ', ': ') for x in TRIPLE.split(', '))}>>"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one object each; blank lines are skipped, anything else is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.col("_metadata.file_path"))
    parsed = F.try_parse_json("value")
    bad = F.when(F.coalesce(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(True)), F.raise_error(F.concat(F.lit("not an object: "), F.col("value"))))
    rows = lines.withColumn("t", F.coalesce(bad.cast("string"), F.col("value"))).select("file", F.from_json("t", TRIPLE).alias("t"))
    return clean_triples(rows.select("file", "t.*")).withColumn("company", company_of_path(F.col("file"), gold=True))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Files ``{triples: [...]}``; entries that are no objects are dropped, a file without the list is an error."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    entries = F.from_json("value", f"triples {ENTRIES}")["triples"]
    checked = F.when(entries.isNull(), F.raise_error(F.concat(F.lit("no list of triples: "), F.col("file"))).cast(ENTRIES)).otherwise(entries)
    rows = files.select("file", F.posexplode(checked).alias("idx", "t")).where("t is not null")
    return clean_triples(rows.select("file", "idx", "t.*"))


def read_annotators(spark: SparkSession, path: str) -> DataFrame:
    """``annotator, edge``: distinct, an edge being its two keys and relation."""
    rows = spark.read.schema("annotator string, subject string, relation string, object string").json(path)
    edge = F.struct(text.canonical_key(F.col("subject"), True).alias("subject"), F.trim("relation").alias("relation"), text.canonical_key(F.col("object"), True).alias("object"))
    return rows.select("annotator", edge.alias("edge")).distinct()


def company_of_path(path: Column, gold: bool = False) -> Column:
    return text.company_from_stem(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), gold)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """Whole texts with their counts of characters and words."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return with_counts(files)


def with_counts(filings: DataFrame) -> DataFrame:
    """Adds ``character_count, word_count`` of ``text``; white space of any script parts words."""
    stripped = text.strip(F.col("text"))
    words = F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"(?U)\s+")))
    return filings.withColumn("character_count", F.length("text")).withColumn("word_count", words)


# ---------------------------------------------------------------- payload texts


def strip_fence(c: Column) -> Column:
    inner = F.regexp_extract(F.trim(c), r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(c))


def parse_payload(content: Column) -> Column:
    """``payload`` (variant), ``recovered``, ``used_fallback``: the text as JSON, else what it holds.

    Tried in order: the text, the text without its code fence, its outermost braces, and those
    cut after the last complete value and closed.
    """
    plain = F.try_parse_json(content)
    fenced = F.try_parse_json(strip_fence(content))
    braces = F.try_parse_json(F.regexp_extract(content, r"(?s)(\{.*\})", 1))
    cut = F.regexp_extract(content, r"(?s)(\{.*[}\]])", 1)
    closed = F.coalesce(F.try_parse_json(F.concat(cut, F.lit("]}"))), F.try_parse_json(F.concat(cut, F.lit("}"))))
    return F.struct(
        F.coalesce(plain, fenced, braces, closed).alias("payload"),
        (plain.isNull() & F.coalesce(fenced, braces, closed).isNotNull()).alias("recovered"),
        F.coalesce(plain, fenced, braces, closed).isNull().alias("used_fallback"),
    )


def payload_triples(payload: Column) -> Column:
    """Triples of a payload: its ``triples``, ``resolved_triples`` or ``valid_triples``, itself if it is
    a list, or the one triple that it is. Missing fields are empty."""
    get = lambda path: F.try_variant_get(payload, path, ENTRIES)
    one = F.try_variant_get(payload, "$", ENTRIES[6:-1])
    single = F.when(one["relation"].isNotNull() & one["subject"].isNotNull(), F.array(one))
    found = F.coalesce(get("$.triples"), get("$.resolved_triples"), get("$.valid_triples"), get("$"), single, F.array().cast(ENTRIES))
    return F.transform(F.array_compact(found), lambda t: F.struct(*[F.coalesce(t[f], F.lit("")).alias(f) for f in FIELDS]))


def first_object(df: DataFrame, column: str, out: str, lists: bool = False) -> DataFrame:
    """Adds ``out``, the first decodable JSON object (or list) inside a free text, else null.

    Balanced braces are beyond regular expressions, so this one is a scanning decoder in Python.
    """
    import json

    @F.pandas_udf("string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder, opening = json.JSONDecoder(), re.compile(r"[{\[]" if lists else r"\{")

        def first(s: str | None) -> str | None:
            for m in opening.finditer(s or ""):
                try:
                    value, _ = decoder.raw_decode(s, m.start())
                except ValueError:
                    continue
                return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            return None

        for series in batches:
            yield series.map(first).astype(object).where(lambda x: x.notna(), None)

    return df.withColumn(out, scan(F.col(column)))


# ---------------------------------------------------------------- run folders

_RUN = r"/([^/]+)/([^/]+)/(latest|runs/[^/]+|failed/[^/]+)/([^/]+\.json)$"


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """``slug, pipeline, run, token, artefact, path`` of every run's JSON files."""
    return run_parts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path"))


def run_parts(files: DataFrame) -> DataFrame:
    """The parts of ``path``, of files that belong to a run; ``token`` is null for the latest one."""
    part = lambda n: F.regexp_extract("path", _RUN, n)
    run = part(3)
    token = F.when(F.contains(run, F.lit("/")), F.substring_index(run, "/", -1))
    return files.where(F.col("path").rlike(_RUN)).select(part(1).alias("slug"), part(2).alias("pipeline"), F.substring_index(run, "/", 1).alias("run"), token.alias("token"), part(4).alias("artefact"), "path")


def company_states(files: DataFrame) -> DataFrame:
    """``slug, pipeline, latest_available, available_run_tokens, failed_run_tokens``."""
    tokens = lambda kind: F.array_sort(F.collect_set(F.when(F.col("run") == kind, F.col("token"))))
    return files.groupBy("slug", "pipeline").agg(F.bool_or(F.col("run") == "latest").alias("latest_available"), tokens("runs").alias("available_run_tokens"), tokens("failed").alias("failed_run_tokens"))


def load_targets(files: DataFrame, pipeline: str, slug: str | None = None, run: str | None = None) -> DataFrame:
    """Files to load: one company's run, ``latest`` unless named otherwise, or the latest of all companies.

    A run is named by ``latest``, ``runs/token``, ``failed/token``, or its token alone.
    """
    if slug is None and run is not None:
        raise ValueError("a run is chosen for one company")
    mine = files.where(F.col("pipeline") == pipeline)
    if slug is None:
        return mine.where("run = 'latest'")
    wanted = run or "latest"
    named = F.concat_ws("/", "run", "token")
    return mine.where((F.col("slug") == slug) & ((named == wanted) | (F.col("token") == wanted)))


def load_runs(spark: SparkSession, files: DataFrame, run: str = "latest") -> DataFrame:
    """Triples of each run: its resolved ones, else the valid ones of its report."""
    wanted = files.where((F.col("run") == run) & F.col("artefact").isin("resolved_triples.json", "validation_report.json"))
    first, last = wanted.agg(F.min("path"), F.max("path")).first()
    if first is None:
        raise FileNotFoundError("no runs")
    # the folder above them all is read as whole texts, whatever the number of runs; no list of paths is made
    above = posixpath.commonprefix([first, last]).rpartition("/")[0]
    texts = spark.read.text(above, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    best = wanted.join(texts, "path").groupBy("slug", "pipeline").agg(F.min_by("value", "artefact").alias("value"))
    rows = best.select("slug", "pipeline", F.posexplode(payload_triples(F.try_parse_json("value"))).alias("idx", "t"))
    return rows.select("slug", "pipeline", "idx", "t.*")


def resolve_run(root: str, selector: str) -> str:
    """Path of a run below ``root``; a selector that leaves it is refused."""
    path = posixpath.normpath(posixpath.join(root, selector))
    if posixpath.isabs(selector) or not path.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"outside {root}: {selector}")
    return path


def pair_evaluations(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold files with the predictions of their company; ``status`` tells which are missing."""
    out = gold.join(predictions, ["slug", "pipeline"], "left")
    return out.withColumn("status", F.when(F.col("prediction_path").isNull(), "missing_prediction").otherwise("evaluated"))


def find_gold(golds: DataFrame, slug: str) -> tuple[str, str]:
    """``path, split`` of the one gold file of a company; none, or files in several splits, are errors."""
    found = golds.where(F.col("slug") == slug).select("path", "split").orderBy("split").limit(2).collect()
    if not found:
        raise FileNotFoundError(f"no gold file of {slug}")
    if len(found) > 1:
        raise ValueError(f"{slug} has gold files in several splits: {', '.join(r['split'] for r in found)}")
    return found[0]["path"], found[0]["split"]


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; Spark commits the folder as a whole."""
    df.write.mode("overwrite").json(path)


def render(df: DataFrame, limit: int | None = None) -> Iterator[str]:
    """One column as plain lines; several as tab-separated ones under a header, other types as JSON."""
    def plain(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        return c if kind == "string" else c.cast("string") if kind in ("boolean", "bigint", "int", "double") else F.to_json(c)

    if len(df.columns) > 1:
        yield "\t".join(df.columns)
    shown = df.select(F.concat_ws("\t", *[F.coalesce(plain(f), F.lit("null")) for f in df.schema]).alias("line"))
    for row in (shown if limit is None else shown.limit(limit)).toLocalIterator():
        yield row["line"]
