"""Validation, resolution and audit of triples.

Triples carry ``idx``, their place in their batch, and ``batch`` columns (any names) that tell
batches apart; order-sensitive rules are windows or aggregates over these. Issues are an array of
``code, message`` in a fixed order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import text
from orrery.functions.vocabulary import CANONICAL_LABELS, NODE_TYPES, RELATION_SCHEMA, RELATIONS
from orrery.operators.places import normalize_place

FIELDS = ["subject", "subject_type", "relation", "object", "object_type"]


#: code, message, and when a triple has the issue
Issue = tuple[str, Column | str, Column]


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def _flagged(rows: DataFrame, issues: list[Issue], at: int = 0) -> tuple[DataFrame, list[Issue]]:
    """A column for each issue's test, so that it is computed once, and the issues by these columns."""
    names = [f"__issue{n}" for n in range(at, at + len(issues))]
    rows = rows.withColumns({name: F.coalesce(when, F.lit(False)) for name, (_, _, when) in zip(names, issues)})
    return rows, [(code, message, F.col(name)) for name, (code, message, _) in zip(names, issues)]


def _issues(issues: list[Issue]) -> Column:
    """Those a triple has, in order, without lambdas: they and what stands in them are not compiled."""
    none = F.array().cast("array<struct<code:string,message:string>>")
    found = []
    for code, message, flag in issues:
        text_ = F.lit(message) if isinstance(message, str) else message
        found.append(F.when(flag, F.array(F.struct(F.lit(code).alias("code"), text_.alias("message")))).otherwise(none))
    return F.when(_any([flag for _, _, flag in issues]), F.concat(*found)).otherwise(none)


def _kind(name: str) -> Column:
    """A type or relation as the rules see it: stripped, empty where it is missing."""
    value = F.coalesce(F.col(name), F.lit(""))
    known = RELATIONS if name == "relation" else NODE_TYPES
    return F.when(value.isin(*known), value).otherwise(text.strip(value))


def clean_triples(triples: DataFrame, evaluator: bool = False) -> DataFrame:
    """Names cleaned, types and relation stripped, missing values empty."""
    for name in ("subject", "object"):
        triples = triples.withColumn(name, text.clean_name(F.coalesce(F.col(name), F.lit("")), evaluator))
    for name in ("subject_type", "relation", "object_type"):
        triples = triples.withColumn(name, _kind(name))
    return triples


def nested_offers(triples: DataFrame) -> DataFrame:
    """The triples, as they are, that put something below an offering, good or not.

    No other triple bears on their issues and status in ``validate_batch``: parents are compared
    with parents, and equal triples share relation and types. Who asks for these alone takes them
    first: Spark moves no filter through the windows, nor through the calls that clean names.
    """
    return triples.where((_kind("relation") == "OFFERS") & (_kind("subject_type") == "Offering"))


def validate_each(triples: DataFrame, place_names: DataFrame | None = None, source: Column | None = None) -> DataFrame:
    """Adds ``issues`` and normalised fields: every rule that looks at one triple alone.

    ``place_names(key, place)`` are the known places; ``source`` is a text in which names other
    than labels must occur.
    """
    rows = clean_triples(triples)
    issues: list[Issue] = []
    for side in ("subject", "object"):
        if place_names is not None:
            rows = normalize_place(rows, side, place_names, f"__{side}")
            is_place = F.col(f"{side}_type") == "Place"
            issues.append(("invalid_place", F.concat(F.lit(f"{side} is no known place: "), side), is_place & (F.col(side) != "") & ~F.col(f"__{side}_known")))
            rows = rows.withColumn(side, F.when(is_place, F.col(f"__{side}")).otherwise(F.col(side)))
    issues += [(f"empty_{side}", f"{side} is empty", F.col(side) == "") for side in ("subject", "object")]
    issues += [(f"invalid_{side}_type", f"{side} type is not of the ontology", ~F.col(f"{side}_type").isin(*NODE_TYPES)) for side in ("subject", "object")]
    issues.append(("invalid_relation", "relation is not of the ontology", ~F.col("relation").isin(*RELATIONS)))
    fits = [(F.col("relation") == r) & F.col("subject_type").isin(*subjects) & (F.col("object_type") == obj) for r, (subjects, obj) in RELATION_SCHEMA.items()]
    rows, issues = _flagged(rows, issues)
    more: list[Issue] = [("invalid_relation_schema", "relation does not join these types", ~_any([flag for _, _, flag in issues]) & ~_any(fits))]
    for side in ("subject", "object"):
        wrong = [(F.col(f"{side}_type") == kind) & ~F.col(side).isin(*labels) for kind, labels in CANONICAL_LABELS.items()]
        more.append(("non_canonical_label", F.concat(F.lit("not an approved label: "), side), _any(wrong)))
    if source is not None:
        haystack = text.canonical_key(source)
        for side in ("subject", "object"):
            free = ~F.col(f"{side}_type").isin(*CANONICAL_LABELS)
            more.append(("not_grounded_in_text", F.concat(F.lit("not in the text: "), side), free & (F.col(side) != "") & ~F.contains(haystack, text.canonical_key(F.col(side)))))
    rows, more = _flagged(rows, more, len(issues))
    out = rows.withColumn("issues", _issues(issues + more))
    return out.drop("__subject", "__object", "__subject_known", "__object_known", *[f"__issue{n}" for n in range(len(issues + more))])


def validate_batch(triples: DataFrame, batch: list[str], place_names: DataFrame | None = None, source: Column | None = None, dedupe: bool = True) -> DataFrame:
    """``validate_each`` and the rules across a batch: adds ``status`` valid, invalid or duplicate.

    Of an offering's parents the first by ``idx`` stands; of equal triples the first is kept; an
    offering below another has no revenue of its own, one directly below a segment no channel.
    """
    rows = validate_each(triples, place_names, source)
    for side in ("subject", "object"):
        rows = rows.withColumn(f"__{side}", text.canonical_key(F.col(side)))
    rows = rows.withColumn("__good", F.size("issues") == 0)
    good, relation = F.col("__good"), F.col("relation")
    offers = good & (relation == "OFFERS") & (F.col("object_type") == "Offering")
    nested = offers & (F.col("subject_type") == "Offering")
    anchored = offers & (F.col("subject_type") == "BusinessSegment")
    sold = good & relation.isin("MONETIZES_VIA", "SELLS_THROUGH") & (F.col("subject_type") == "Offering")
    # The rules meet in one name: an offering's, of the triples that offer or sell it. Equal triples
    # share it, so one shuffle and one sort serve all rules; rows of no rule are spread over names.
    about = F.when(offers, F.col("__object")).when(sold, F.col("__subject")).when(good, F.concat_ws(" ", "__subject", "__object")).otherwise(F.col("idx").cast("string"))
    rows = rows.withColumn("__about", about).repartition(*batch, "__about")
    key = ["__good", "__subject", "subject_type", "relation", "__object", "object_type"]
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*batch, "__about", *key).orderBy("idx")))
    together = Window.partitionBy(*batch, "__about")
    rows = rows.withColumns(
        {
            "__first": F.min(F.when(nested, F.struct("idx", "__subject"))).over(together),
            "__child": F.bool_or(nested).over(together),
            "__anchored": F.bool_or(anchored).over(together),
        }
    )
    # of a name's parents the first stands and so do the first of equal triples: what is offered at all stays offered
    rows = rows.withColumn("__other", nested & (F.col("__first.__subject") != F.col("__subject")))
    rows = rows.withColumn("__again", good & ~F.col("__other") & (F.col("__n") > 1) & F.lit(dedupe))
    stands = sold & ~F.col("__again")
    rows = rows.withColumn("__revenue", stands & (relation == "MONETIZES_VIA") & F.col("__child")).withColumn("__channel", stands & (relation == "SELLS_THROUGH") & F.col("__anchored"))
    late = _issues(
        [
            ("multiple_offering_parents", "another offering is already its parent", F.col("__other")),
            ("child_offering_monetizes_via", "revenue belongs to the parent offering", F.col("__revenue")),
            ("segment_anchored_offering_sells_through", "channels belong to the segment", F.col("__channel")),
        ]
    )
    # by the flags, so that who asks for no issues need not carry them
    invalid = ~good | F.col("__other") | F.col("__revenue") | F.col("__channel")
    status = F.when(F.col("__again"), "duplicate").when(invalid, "invalid").otherwise("valid")
    rows = rows.withColumn("issues", F.concat("issues", late)).withColumn("status", status)
    return rows.drop("__subject", "__object", "__good", "__about", "__n", "__first", "__child", "__anchored", "__other", "__again", "__revenue", "__channel")


def summary(validated: DataFrame, batch: list[str]) -> DataFrame:
    """Counts of a report: input, valid, invalid, duplicate, output."""
    n = lambda s: F.count_if(F.col("status") == s)
    return validated.groupBy(*batch).agg(
        F.count("*").alias("input_triple_count"),
        n("valid").alias("valid_triple_count"),
        n("invalid").alias("invalid_triple_count"),
        n("duplicate").alias("duplicate_triple_count"),
        n("valid").alias("output_triple_count"),
    )


def issue_histogram(validated: DataFrame, batch: list[str]) -> DataFrame:
    """``code, triples``: triples that have an issue, each code once a triple."""
    codes = F.explode(F.array_distinct(F.col("issues.code"))).alias("code")
    return validated.select(*batch, codes).groupBy(*batch, "code").agg(F.count("*").alias("triples"))


# ---------------------------------------------------------------- audit of payloads


def audit(raw: DataFrame, batch: list[str], place_names: DataFrame | None = None) -> DataFrame:
    """Counters of a payload's triples: those that lack keys, are empty, or the ontology rejects.

    ``raw`` has the fields as they were read, null where a key is missing, and ``is_object``.
    """
    missing = F.col("is_object") & reduce(lambda a, b: a | b, [F.col(f).isNull() for f in FIELDS])
    checked = validate_each(raw.withColumn("__missing", missing), place_names)
    codes = F.transform("issues", lambda i: i["code"])
    usable = F.col("is_object") & ~F.col("__missing")
    malformed = usable & F.arrays_overlap(codes, F.array(F.lit("empty_subject"), F.lit("empty_object")))
    rejected = usable & ~malformed & (F.size("issues") > 0)
    counts = checked.groupBy(*batch).agg(
        F.count("*").alias("raw_triple_count"),
        F.count_if(~F.col("is_object")).alias("non_dict_triple_count"),
        F.count_if("__missing").alias("missing_key_triple_count"),
        F.count_if(malformed).alias("malformed_triple_count"),
        F.count_if(rejected).alias("ontology_rejected_triple_count"),
        F.count_if(usable & (F.size("issues") == 0)).alias("kept_triple_count"),
    )
    per_code = checked.where(usable).select(*batch, F.explode(F.array_distinct(codes)).alias("code")).groupBy(*batch, "code").agg(F.count("*").alias("n"))
    maps = per_code.groupBy(*batch).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("invalid_issue_counts"))
    return counts.join(maps, batch, "left")


def roll_up(audits: DataFrame, by: list[str]) -> DataFrame:
    """Audits of several stages as one."""
    numbers = [f.name for f in audits.schema if f.name.endswith("_count")]
    sums = audits.groupBy(*by).agg(*[F.sum(n).alias(n) for n in numbers])
    codes = audits.select(*by, F.explode("invalid_issue_counts").alias("code", "n")).groupBy(*by, "code").agg(F.sum("n").alias("n"))
    maps = codes.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("invalid_issue_counts"))
    return sums.join(maps, by, "left")


# ---------------------------------------------------------------- resolution


def resolve(triples: DataFrame, batch: list[str]) -> DataFrame:
    """One surface a name: of all that share type and key, the best, the first seen among equals.

    A subject is seen before the object of its triple. Triples with an empty name are dropped,
    then all but the first of equal ones.
    """
    rows = triples.withColumn("subject", text.clean_name(F.col("subject"))).withColumn("object", text.clean_name(F.col("object")))
    rows = rows.where("subject <> '' and object <> ''")
    ends = []
    for n, side in enumerate(("subject", "object")):
        rows = rows.withColumn(f"__{side}", text.canonical_key(F.col(side)))
        ends.append(F.struct(F.col(f"{side}_type").alias("type"), F.col(f"__{side}").alias("key"), F.col(side).alias("name"), (2 * F.col("idx") + n).alias("at")))
    seen = rows.select(*batch, F.explode(F.array(*ends)).alias("e")).select(*batch, "e.*")
    order = F.struct(text.surface_score(F.col("name")).alias("score"), (-F.col("at")).alias("early"))
    best = seen.groupBy(*batch, "type", "key").agg(F.max_by("name", order).alias("surface"))
    for side in ("subject", "object"):
        named = best.withColumnsRenamed({"type": f"{side}_type", "key": f"__{side}", "surface": f"__best_{side}"})
        rows = rows.join(named, [*batch, f"{side}_type", f"__{side}"]).withColumn(side, F.col(f"__best_{side}"))
    first = F.row_number().over(Window.partitionBy(*batch, *FIELDS).orderBy("idx"))
    return rows.withColumn("__n", first).where("__n = 1").select(*batch, "idx", *FIELDS)


# ---------------------------------------------------------------- versions of a graph


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``triples_out, added, removed`` between two versions, by spaced and cased key."""
    key = [F.lower(F.trim(F.regexp_replace(f, r"\s+", " "))).alias(f) for f in FIELDS]
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    flags = a.withColumn("was", F.lit(1)).join(b.withColumn("is", F.lit(1)), FIELDS, "full_outer")
    return flags.agg(
        F.count("is").alias("triples_out"),
        F.count_if(F.col("was").isNull()).alias("added"),
        F.count_if(F.col("is").isNull()).alias("removed"),
    )


def merge_relations(base: DataFrame, subset: DataFrame, relations: list[str]) -> DataFrame:
    """``base`` outside ``relations`` with ``subset`` inside them; equal triples once, base first."""
    both = base.where(~F.col("relation").isin(*relations)).withColumn("__part", F.lit(0)).unionByName(subset.where(F.col("relation").isin(*relations)).withColumn("__part", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*FIELDS).orderBy("__part", "idx"))
    return both.withColumn("__n", first).where("__n = 1").drop("__n", "__part")


def last_good(before: DataFrame, after: DataFrame, batch: list[str]) -> DataFrame:
    """Triples of ``after``, and of ``before`` for the batches of which ``after`` has none."""
    return after.unionByName(before.join(after.select(*batch).distinct(), batch, "left_anti"))


def sort_triples(triples: DataFrame) -> DataFrame:
    """Ordered by subject, its type, relation, object, its type."""
    return triples.orderBy(*FIELDS)
