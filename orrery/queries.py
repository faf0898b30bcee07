"""Queries over the projected graph and the other tables, with the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import projection, storage
from orrery.functions import text
from orrery.operators import evaluate, prepare, router, validate
from orrery.operators import graph as graphs
from orrery.operators.places import company_matches, normalize_place
from orrery.plans import execute
from orrery.sources import runs
from orrery.sources import triples as sources

Query = Callable[[SparkSession, str], DataFrame]

#: The projection's relations.
BASE = """
WITH RECURSIVE fact AS (
  SELECT s_name, p_type, p_brand, p_name, p_partkey, l_orderkey, l_returnflag, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50),
has_segment AS (SELECT DISTINCT s_name AS company, p_type AS segment FROM fact),
roots AS (SELECT DISTINCT s_name AS company, p_type AS segment, p_brand AS offering FROM fact),
child AS (
  SELECT DISTINCT s_name AS company, p_brand AS parent, p_brand || ' ' || p_name AS child FROM fact
  UNION SELECT DISTINCT s_name, p_brand || ' ' || p_name, p_brand || ' ' || p_name || ' #' || p_partkey FROM fact),
serves AS (SELECT DISTINCT s_name AS company, p_type AS segment, c_mktsegment AS customer_type FROM fact JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
sells AS (SELECT DISTINCT s_name AS company, p_type AS segment, o_orderpriority AS channel FROM fact JOIN orders ON l_orderkey = o_orderkey),
monetizes AS (SELECT DISTINCT s_name AS company, p_brand AS offering, l_returnflag || l_linestatus AS revenue_model FROM fact),
operates AS (
  SELECT s_name AS company, CASE WHEN s_suppkey % 13 = 0 THEN 'WORLD' WHEN s_suppkey % 7 = 0 THEN r_name ELSE n_name END AS place
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
partners AS (
  SELECT DISTINCT x.s_name AS company, y.s_name AS partner FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  JOIN supplier x ON a.l_suppkey = x.s_suppkey JOIN supplier y ON b.l_suppkey = y.s_suppkey
  WHERE a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.l_suppkey <> b.l_suppkey),
companies AS (SELECT DISTINCT s_name AS company FROM supplier),
parent AS (
  SELECT n_name AS place, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region),
above AS (SELECT place, parent AS ancestor FROM parent UNION SELECT a.place, p.parent FROM above a JOIN parent p ON a.ancestor = p.place),
closure AS (
  SELECT company, node AS root, node AS descendant, 0 AS depth FROM (SELECT company, parent AS node FROM child UNION SELECT company, child FROM child)
  UNION SELECT c.company, c.root, k.child, c.depth + 1 FROM closure c JOIN child k ON c.company = k.company AND c.descendant = k.parent),
below AS (SELECT r.company, r.segment, r.offering AS root, c.descendant AS offering FROM roots r JOIN closure c ON r.company = c.company AND r.offering = c.root)
"""


def _in_place(names: str) -> str:
    return f"""company IN (SELECT company FROM operates WHERE place IN ({names})
      OR place IN (SELECT place FROM above WHERE ancestor IN ({names})) OR place IN (SELECT ancestor FROM above WHERE place IN ({names})))"""


def _atom(kind: str, value: str, deep: bool = False) -> str:
    source = {"customer_type": "serves", "channel": "sells", "offering": "below" if deep else "roots"}.get(kind)
    if source:
        return f"(company, segment) IN (SELECT (company, segment) FROM {source} WHERE {kind} = '{value}')"
    return f"(company, segment) IN (SELECT (b.company, b.segment) FROM {'below' if deep else 'roots'} b JOIN monetizes m ON b.company = m.company AND b.offering = m.offering WHERE revenue_model = '{value}')"


def _anywhere(*atoms: str) -> str:
    return " AND ".join(f"company IN (SELECT company FROM has_segment WHERE {a})" for a in atoms)


_BUILD, _URGENT = _atom("customer_type", "BUILDING"), _atom("channel", "1-URGENT")

#: query -> (plan, SQL after BASE)
PLANS: dict[str, tuple[dict, str]] = {}


def _plan(name: str, family: str, sql: str, **payload) -> None:
    PLANS[name] = ({"answerable": True, "family": family, "payload": payload}, sql)


def _register(c: list[str], brands: list[str], segment: str, place: str, region: str) -> None:
    """The plans, with names that occur in the tables at every scale."""
    cs, bs = ", ".join(f"'{x}'" for x in c), ", ".join(f"'{x}'" for x in brands)
    brand = _atom("offering", brands[0])
    brand_deep, rm, rm_direct = _atom("offering", brands[0], True), _atom("revenue_model", "NO", True), _atom("revenue_model", "NO")
    p = _plan
    p("q01_companies_list", "companies_list", "SELECT company FROM companies")
    p("q02_segments_by_company", "segments_by_company", f"SELECT company, segment FROM has_segment WHERE company IN ({cs})", companies=c)
    p("q03_offerings_by_company", "offerings_by_company", f"SELECT DISTINCT company, offering FROM roots WHERE company IN ({cs})", companies=c)
    p("q04_offerings_by_segment", "offerings_by_segment", f"SELECT company, segment, offering FROM roots WHERE segment = '{segment}'", segments=[segment])
    p("q05_companies_by_segment_filters", "companies_by_segment_filters", f"SELECT DISTINCT company FROM has_segment WHERE {_BUILD} AND {_URGENT}", customer_types=["BUILDING"], channels=["1-URGENT"])
    p("q05_direct", "companies_by_segment_filters", f"SELECT DISTINCT company FROM has_segment WHERE {brand} AND {rm_direct}", offerings=brands[:1], revenue_models=["NO"], hierarchy_mode="direct")
    p("q05_descendant", "companies_by_segment_filters", f"SELECT DISTINCT company FROM has_segment WHERE {brand_deep} AND {rm}", offerings=brands[:1], revenue_models=["NO"])
    p("q06_segments_by_segment_filters", "segments_by_segment_filters", f"SELECT company, segment FROM has_segment WHERE {_BUILD} AND {rm}", customer_types=["BUILDING"], revenue_models=["NO"])
    p("q07_cross_segment_filters", "companies_by_cross_segment_filters", f"SELECT company FROM companies WHERE {_anywhere(_BUILD, _URGENT)}", customer_types=["BUILDING"], channels=["1-URGENT"])
    p("q07_three_atoms", "companies_by_cross_segment_filters", f"SELECT company FROM companies WHERE {_anywhere(_BUILD, _URGENT, brand_deep)}", customer_types=["BUILDING"], channels=["1-URGENT"], offerings=brands[:1], hierarchy_mode="descendant")
    p("q08_descendant_offerings", "descendant_offerings_by_root", f"SELECT DISTINCT company, offering FROM below WHERE root IN ({bs})", offerings=brands)
    p("q09_descendant_revenue", "companies_by_descendant_revenue", f"SELECT DISTINCT b.company FROM below b JOIN monetizes m ON b.company = m.company AND b.offering = m.offering WHERE root IN ({bs}) AND revenue_model = 'NO'", offerings=brands, revenue_models=["NO"])
    p("q10_companies_by_place", "companies_by_place", f"SELECT company FROM companies WHERE {_in_place(repr(region))}", places=[region])
    p("q11_segments_by_place", "segments_by_place_and_segment_filters", f"SELECT company, segment FROM has_segment WHERE {_in_place(repr(place))} AND {_BUILD}", places=[place], customer_types=["BUILDING"])
    p("q12_companies_by_partner", "companies_by_partner", f"SELECT DISTINCT company FROM partners WHERE partner IN ({cs})", partners=c)
    p("q13_exists_true", "boolean_exists", "SELECT count(*) > 0 AS is_match FROM has_segment", base_family="segments_by_segment_filters", customer_types=["BUILDING"])
    p("q13_exists_false", "boolean_exists", "SELECT false AS is_match", base_family="segments_by_company", companies=["No such company"])
    count = lambda base, target: {"kind": "count", "base_family": base, "count_target": target}
    p("q14_count_company", "count_aggregate", f"SELECT count(DISTINCT company) AS company_count FROM has_segment WHERE {_BUILD}", aggregate_spec=count("companies_by_segment_filters", "company"), customer_types=["BUILDING"])
    p("q14_count_segment", "count_aggregate", f"SELECT count(*) AS segment_count FROM has_segment WHERE {_BUILD} AND {_URGENT}", aggregate_spec=count("segments_by_segment_filters", "segment"), customer_types=["BUILDING"], channels=["1-URGENT"])
    p("q14_count_offering", "count_aggregate", f"SELECT count(*) AS offering_count FROM (SELECT DISTINCT company, offering FROM below WHERE root IN ({bs}))", aggregate_spec=count("descendant_offerings_by_root", "offering"), offerings=brands)
    top = lambda metric: {"kind": "ranking", "ranking_metric": metric, "limit": 4}
    rank = "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4"
    p("q15a_topk_customer_types", "ranking_topk", f"SELECT customer_type, count(DISTINCT company) AS company_count FROM serves {rank}", aggregate_spec=top("customer_type_by_company_count"))
    p("q15b_topk_channels", "ranking_topk", f"SELECT channel, count(*) AS segment_count FROM sells WHERE {_in_place(repr(region))} {rank}", aggregate_spec=top("channel_by_segment_count"), places=[region])
    p("q15c_topk_revenue_models", "ranking_topk", f"SELECT revenue_model, count(DISTINCT b.company) AS company_count FROM below b JOIN monetizes m ON b.company = m.company AND b.offering = m.offering {rank}", aggregate_spec=top("revenue_model_by_company_count"))
    p("q15d_topk_companies", "ranking_topk", f"SELECT company, count(DISTINCT segment) AS segment_count FROM has_segment WHERE {_BUILD} {rank}", aggregate_spec=top("company_by_matched_segment_count"), customer_types=["BUILDING"])


_register(["Supplier#000000001", "Supplier#000000002", "Supplier#000000005"], ["Brand#1", "Brand#2"], "PROMO", "NATION_3", "ASIA")


def _planned(plan: dict) -> Query:
    return lambda spark, sf_dir: execute(plan, projection.graph(spark, sf_dir))


QUERIES: dict[str, Query] = {name: _planned(plan) for name, (plan, _) in PLANS.items()}
SQL: dict[str, str] = {name: BASE + sql for name, (_, sql) in PLANS.items()}


def query(sql: str | None = None, base: bool = False):
    """Registers a function as the query of its name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (BASE if base else "") + sql
        return f

    return register


# ------------------------------------------------------------------ places and graph


@query("""SELECT company, CASE min(rank) WHEN 0 THEN 'exact' WHEN 1 THEN 'narrower_place' ELSE 'broader_region' END AS geography_match,
  string_agg(DISTINCT place, ',' ORDER BY place) AS matched_places FROM (
  SELECT company, o.place, CASE WHEN o.place = 'ASIA' THEN 0 WHEN o.place IN (SELECT place FROM above WHERE ancestor = 'ASIA') THEN 1
    WHEN o.place IN (SELECT ancestor FROM above WHERE place = 'ASIA') THEN 2 END AS rank FROM operates o) WHERE rank IS NOT NULL GROUP BY company""", base=True)
def q17_place_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return company_matches(g.operates, g.dimension, ["ASIA"]).withColumn("matched_places", F.array_join("matched_places", ","))


@query("SELECT company, segment, string_agg(DISTINCT offering, ',' ORDER BY offering) AS offerings FROM roots GROUP BY company, segment", base=True)
def q18_segment_offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    rows = g.has_segment.join(g.roots, ["company", "segment"], "left").groupBy("company", "segment")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("offering")), ",").alias("offerings"))


@query("SELECT place, ancestor FROM above", base=True)
def place_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.places(spark, sf_dir).dimension(spark).select("place", F.explode("within_places").alias("ancestor"))


@query("SELECT ancestor AS place, place AS descendant FROM above", base=True)
def place_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.places(spark, sf_dir).dimension(spark).select("place", F.explode("includes_places").alias("descendant"))


@query("SELECT company, root, descendant, depth FROM closure", base=True)
def offering_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).with_closure().closure


_EDGES = """, edge AS (
  SELECT 'HAS_SEGMENT' AS rel, 'Company' AS sl, company AS sn, '' AS sc, 'BusinessSegment' AS dl, segment AS dn, company AS dc FROM has_segment
  UNION SELECT 'OFFERS', 'BusinessSegment', segment, company, 'Offering', offering, company FROM roots
  UNION SELECT 'OFFERS', 'Offering', parent, company, 'Offering', child, company FROM child
  UNION SELECT 'SERVES', 'BusinessSegment', segment, company, 'CustomerType', customer_type, '' FROM serves
  UNION SELECT 'SELLS_THROUGH', 'BusinessSegment', segment, company, 'Channel', channel, '' FROM sells
  UNION SELECT 'MONETIZES_VIA', 'Offering', offering, company, 'RevenueModel', revenue_model, '' FROM monetizes
  UNION SELECT 'OPERATES_IN', 'Company', company, '', 'Place', place, '' FROM operates
  UNION SELECT 'PARTNERS_WITH', 'Company', company, '', 'Company', partner, '' FROM partners),
node AS (SELECT sl AS label, sn AS name, sc AS scope FROM edge UNION SELECT dl, dn, dc FROM edge UNION SELECT 'Company', company, '' FROM companies)
"""


@query(_EDGES + "SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM edge) AS relationships", base=True)
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).counts()


@query(_EDGES + """, touch AS (
  SELECT DISTINCT rel, sl, sn, sc, dl, dn, dc, unnest([CASE WHEN sc <> '' THEN sc WHEN sl = 'Company' THEN sn END, CASE WHEN dc <> '' THEN dc WHEN dl = 'Company' THEN dn END]) AS company FROM edge)
SELECT n.company, n.nodes, coalesce(r.relationships, 0) AS relationships FROM (
  SELECT CASE WHEN scope <> '' THEN scope ELSE name END AS company, count(*) AS nodes FROM node WHERE label = 'Company' OR scope <> '' GROUP BY 1) n
LEFT JOIN (SELECT company, count(*) AS relationships FROM touch WHERE company IS NOT NULL GROUP BY 1) r ON n.company = r.company""", base=True)
def company_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).company_counts()


@query("SELECT company FROM companies", base=True)
def list_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).loaded_companies()


@query(_EDGES + """, rest AS (
  SELECT * FROM edge WHERE sc <> 'Supplier#000000001' AND dc <> 'Supplier#000000001'
    AND NOT (sl = 'Company' AND sn = 'Supplier#000000001' AND rel IN ('HAS_SEGMENT', 'OFFERS', 'OPERATES_IN', 'PARTNERS_WITH'))),
left_over AS (SELECT sl AS label, sn AS name, sc AS scope FROM rest UNION SELECT dl, dn, dc FROM rest UNION SELECT 'Company', company, '' FROM companies WHERE company <> 'Supplier#000000001')
SELECT label, count(*) AS nodes FROM left_over GROUP BY label""", base=True)
def unload_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _ = projection.graph(spark, sf_dir).unload("Supplier#000000001")
    return after.nodes.groupBy("label").agg(F.count("*").alias("nodes"))


@query(_EDGES + """SELECT label, near_label, count(*) AS pairs FROM (
  SELECT sl AS label, sn, sc, dl AS near_label, dn, dc FROM edge UNION SELECT dl, dn, dc, sl, sn, sc FROM edge) GROUP BY 1, 2""", base=True)
def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    return graphs.neighbours(g.edges).groupBy("label", "near_label").agg(F.count("*").alias("pairs"))


# ------------------------------------------------------------------ validation

_RAW = """WITH raw AS (
  SELECT s_name AS company, l_orderkey * 10 + l_linenumber AS idx,
    CASE l_orderkey % 8 WHEN 0 THEN s_name WHEN 1 THEN p_type WHEN 2 THEN p_brand WHEN 3 THEN p_name WHEN 4 THEN p_brand WHEN 5 THEN p_type WHEN 6 THEN '' ELSE s_name END AS subject,
    CASE l_orderkey % 8 WHEN 0 THEN 'Company' WHEN 1 THEN 'BusinessSegment' WHEN 5 THEN 'BusinessSegment' WHEN 6 THEN 'Company' WHEN 7 THEN 'Company' ELSE 'Offering' END AS subject_type,
    CASE l_orderkey % 8 WHEN 0 THEN 'HAS_SEGMENT' WHEN 1 THEN 'OFFERS' WHEN 2 THEN 'OFFERS' WHEN 3 THEN 'MONETIZES_VIA' WHEN 4 THEN 'SELLS_THROUGH' WHEN 6 THEN 'OPERATES_IN' ELSE 'SERVES' END AS relation,
    CASE l_orderkey % 8 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 2 THEN p_name WHEN 3 THEN 'subscription' WHEN 4 THEN 'online' WHEN 5 THEN l_returnflag WHEN 6 THEN 'Mars' ELSE 'consumers' END AS object,
    CASE l_orderkey % 8 WHEN 0 THEN 'BusinessSegment' WHEN 1 THEN 'Offering' WHEN 2 THEN 'Offering' WHEN 3 THEN 'RevenueModel' WHEN 4 THEN 'Channel' WHEN 6 THEN 'Planet' ELSE 'CustomerType' END AS object_type
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""
_CHECKED = _RAW + """, each AS (
  SELECT *, CASE relation WHEN 'OPERATES_IN' THEN ['empty_subject', 'invalid_object_type'] ELSE
    CASE WHEN relation = 'SERVES' AND subject_type = 'Company' THEN ['invalid_relation_schema']
         WHEN relation = 'SERVES' THEN ['non_canonical_label'] ELSE [] END END AS codes FROM raw),
first AS (SELECT company, object, arg_min(subject, idx) AS parent FROM each WHERE relation = 'OFFERS' AND subject_type = 'Offering' GROUP BY 1, 2),
nested AS (
  SELECT e.* REPLACE (CASE WHEN e.relation = 'OFFERS' AND e.subject_type = 'Offering' AND f.parent <> e.subject THEN ['multiple_offering_parents'] ELSE codes END AS codes)
  FROM each e LEFT JOIN first f ON e.company = f.company AND e.object = f.object),
counted AS (
  SELECT *, len(codes) = 0 AND row_number() OVER (PARTITION BY company, len(codes) = 0, lower(subject), subject_type, relation, lower(object), object_type ORDER BY idx) > 1 AS again FROM nested),
kept AS (SELECT * FROM counted WHERE len(codes) = 0 AND NOT again),
checked AS (
  SELECT *, CASE
    WHEN len(codes) = 0 AND NOT again AND relation = 'MONETIZES_VIA' AND (company, lower(subject)) IN (SELECT (company, lower(object)) FROM kept WHERE relation = 'OFFERS' AND subject_type = 'Offering') THEN ['child_offering_monetizes_via']
    WHEN len(codes) = 0 AND NOT again AND relation = 'SELLS_THROUGH' AND (company, lower(subject)) IN (SELECT (company, lower(object)) FROM kept WHERE relation = 'OFFERS' AND subject_type = 'BusinessSegment') THEN ['segment_anchored_offering_sells_through']
    ELSE codes END AS issues FROM counted)
"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("lineitem", "supplier", "part"):
        projection.table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_RAW + " SELECT * FROM raw")


@query(_CHECKED + """SELECT company, count(*) AS input_triple_count, count(*) FILTER (NOT again AND len(issues) = 0) AS valid_triple_count,
  count(*) FILTER (NOT again AND len(issues) > 0) AS invalid_triple_count, count(*) FILTER (again) AS duplicate_triple_count,
  count(*) FILTER (NOT again AND len(issues) = 0) AS output_triple_count FROM checked GROUP BY company""")
def validate_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(validate.validate_batch(_raw(spark, sf_dir), ["company"]), ["company"])


@query(_CHECKED + "SELECT code, count(*) AS triples FROM (SELECT unnest(issues) AS code FROM checked) GROUP BY code")
def validate_issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_histogram(validate.validate_batch(_raw(spark, sf_dir), ["company"]), [])


@query(_CHECKED + "SELECT company, object AS offering, parent FROM first")
def validate_first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = validate.validate_batch(validate.nested_offers(_raw(spark, sf_dir)), ["company"])
    return nested.where("status <> 'invalid'").groupBy("company", F.col("object").alias("offering")).agg(F.min_by("subject", "idx").alias("parent"))


@query(_RAW + """, each AS (SELECT *, CASE relation WHEN 'OPERATES_IN' THEN 1 ELSE 0 END AS bad,
  CASE WHEN relation = 'SERVES' THEN 1 ELSE 0 END AS off FROM raw)
SELECT company, count(*) AS raw_triple_count, 0 AS non_dict_triple_count, 0 AS missing_key_triple_count, sum(bad)::BIGINT AS malformed_triple_count,
  sum(off)::BIGINT AS ontology_rejected_triple_count, count(*) - sum(bad)::BIGINT - sum(off)::BIGINT AS kept_triple_count FROM each GROUP BY company""")
def payload_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.audit(_raw(spark, sf_dir).withColumn("is_object", F.lit(True)), ["company"]).drop("invalid_issue_counts")


_SHOUT = """CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) WHEN o_orderkey % 3 = 1 THEN lower(c_name) ELSE c_name END"""


@query(f"""WITH seen AS (SELECT c_nationkey AS batch, lower(name) AS k, name, row_number() OVER () AS n, o_orderkey FROM (
  SELECT c_nationkey, {_SHOUT} AS name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey))
SELECT batch, k AS name_key, arg_max(name, (CASE WHEN regexp_replace(name, '[^A-Za-z]', '', 'g') = upper(regexp_replace(name, '[^A-Za-z]', '', 'g')) THEN 0 ELSE 1 END,
  CASE WHEN name <> upper(name) AND name <> lower(name) THEN 1 ELSE 0 END, length(name), -o_orderkey)) AS surface FROM seen GROUP BY 1, 2""")
def resolve_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.table(spark, sf_dir, "orders").join(projection.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    triples = rows.select(F.col("c_nationkey").alias("batch"), F.col("o_orderkey").alias("idx"), F.expr(_SHOUT).alias("subject"), F.lit("Company").alias("subject_type"), F.lit("OPERATES_IN").alias("relation"), F.lit("Worldwide").alias("object"), F.lit("Place").alias("object_type"))
    out = validate.resolve(triples, ["batch"])
    return out.select("batch", text.canonical_key(F.col("subject")).alias("name_key"), F.col("subject").alias("surface"))


# ------------------------------------------------------------------ text

_NAME = "concat('  \"', c_name, CASE c_custkey % 4 WHEN 0 THEN ' Inc.\" ' WHEN 1 THEN '  Holdings,  Ltd\"' WHEN 2 THEN '`' ELSE '' END)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NAME).alias("name"))


_CLEAN = f"regexp_replace(trim(trim({_NAME}), '\"''` '), '\\s+', ' ', 'g')"


@query(f"SELECT c_custkey, {_CLEAN} AS cleaned, lower({_CLEAN}) AS key, regexp_replace(lower({_CLEAN}), '[^a-z0-9]', '', 'g') AS compact FROM customer")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return _names(spark, sf_dir).select("c_custkey", text.clean_name(n).alias("cleaned"), text.canonical_key(n).alias("key"), text.compact_key(n).alias("compact"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS alias FROM customer")
def alias_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("c_custkey", text.company_alias_key(F.col("name")).alias("alias"))


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g') AS slug FROM supplier")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.table(spark, sf_dir, "supplier").select("s_suppkey", text.slug(F.col("s_name")).alias("slug"))


@query("SELECT event_type, count(*) AS payloads, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = projection.table(spark, sf_dir, "events").select("event_type", sources.parse_payload(F.col("props")).alias("p"))
    return parsed.groupBy("event_type").agg(F.count("p.payload").alias("payloads"), F.sum(F.try_variant_get("p.payload", "$.k", "bigint")).alias("total"))


# ------------------------------------------------------------------ evaluation

_SIDES = BASE + """, gold AS (
  SELECT company, 'HAS_SEGMENT' AS relation, company AS s, segment AS o FROM has_segment UNION SELECT company, 'SERVES', segment, customer_type FROM serves
  UNION SELECT company, 'OFFERS', segment, offering FROM roots),
pred AS (SELECT company, relation, s, CASE WHEN substr(company, -2)::INT % 4 = 0 AND relation = 'OFFERS' THEN o || ' x' ELSE o END AS o FROM gold
  WHERE NOT (substr(company, -1) = '3' AND relation = 'SERVES')),
hits AS (SELECT g.company AS gc, p.company AS pc FROM gold g FULL OUTER JOIN pred p ON g.company = p.company AND g.relation = p.relation AND g.s = p.s AND g.o = p.o),
per AS (SELECT coalesce(gc, pc) AS company, count(*) FILTER (gc IS NOT NULL AND pc IS NOT NULL) AS true_positives,
  count(*) FILTER (gc IS NULL) AS false_positives, count(*) FILTER (pc IS NULL) AS false_negatives FROM hits GROUP BY 1),
rates AS (SELECT *, coalesce(true_positives / nullif(true_positives + false_positives, 0), 0) AS precision, coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) AS recall FROM per),
scored AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rates)
"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = projection.triples(spark, sf_dir).where("relation in ('HAS_SEGMENT', 'SERVES') or (relation = 'OFFERS' and subject_type = 'BusinessSegment')")
    gold = rows.withColumnRenamed("company_name", "company").distinct()
    off = (F.substring("company", -2, 2).cast("int") % 4 == 0) & (F.col("relation") == "OFFERS")
    pred = gold.withColumn("object", F.when(off, F.concat("object", F.lit(" x"))).otherwise(F.col("object")))
    return gold, pred.where(~((F.substring("company", -1, 1) == "3") & (F.col("relation") == "SERVES")))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(_SIDES + "SELECT company, true_positives, false_positives, false_negatives, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM scored")
def eval_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.exact(*_sides(spark, sf_dir), ["company"]), "precision", "recall", "f1")


@query(_SIDES + """, offered AS (SELECT company, s, o FROM gold WHERE relation = 'OFFERS' UNION SELECT company, s, o FROM pred WHERE relation = 'OFFERS'),
alike AS (SELECT DISTINCT a.company, a.s AS x, b.s AS y FROM offered a JOIN offered b ON a.company = b.company AND a.o = b.o),
pairs AS (SELECT g.company, g.relation, CASE WHEN g.s = p.s AND g.o = p.o THEN 'exact' WHEN g.relation <> 'HAS_SEGMENT' AND g.o = p.o THEN 'subject_segment_rollup'
    WHEN g.relation = 'HAS_SEGMENT' AND (g.company, g.o, p.o) IN (SELECT (company, x, y) FROM alike) THEN 'segment_rollup' END AS reason
  FROM gold g JOIN pred p ON g.company = p.company AND g.relation = p.relation)
SELECT company, relation, reason, count(*) AS pairs, sum(CASE reason WHEN 'exact' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS weight FROM pairs WHERE reason IS NOT NULL GROUP BY ALL""")
def eval_relaxed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluate.candidates(*_sides(spark, sf_dir), ["company"])
    return pairs.groupBy("company", "relation", "reason").agg(F.count("*").alias("pairs"), F.sum("weight").alias("weight"))


@query()
def eval_relaxed_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.relaxed(*_sides(spark, sf_dir), ["company"])


@query(_SIDES + """SELECT sum(true_positives)::BIGINT AS true_positives, sum(false_positives)::BIGINT AS false_positives, sum(false_negatives)::BIGINT AS false_negatives,
  round(avg(f1), 9) AS macro_f1, count(*) AS evaluated_companies, 0 AS missing_predictions, round(sum(true_positives) / (sum(true_positives) + sum(false_positives)), 9) AS precision,
  round(sum(true_positives) / (sum(true_positives) + sum(false_negatives)), 9) AS recall, round(2 * sum(true_positives) / (2 * sum(true_positives) + sum(false_positives) + sum(false_negatives)), 9) AS f1 FROM scored""")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.aggregate(evaluate.exact(*_sides(spark, sf_dir), ["company"]), []), "macro_f1", "precision", "recall", "f1")


@query(_SIDES + """, placed AS (SELECT *, row_number() OVER (ORDER BY company) - 1 AS position, count(*) OVER () AS n FROM scored),
draws AS (SELECT a.range AS sample, ('0x' || substr(md5('20260430:' || a.range || ':' || b.range), 1, 8))::BIGINT % (SELECT max(n) FROM placed) AS position FROM range(200) a, range((SELECT max(n) FROM placed)) b),
samples AS (SELECT sample, sum(true_positives) AS tp, sum(false_positives) AS fp, sum(false_negatives) AS fn FROM draws JOIN placed USING (position) GROUP BY sample),
f AS (SELECT tp / (tp + fp) AS precision, 2 * tp / (2 * tp + fp + fn) AS f1 FROM samples)
SELECT round(avg(precision), 9) AS precision_mean, round(quantile_cont(precision, 0.025::DOUBLE), 9) AS precision_low, round(quantile_cont(precision, 0.975::DOUBLE), 9) AS precision_high,
  round(avg(f1), 9) AS f1_mean, round(quantile_cont(f1, 0.025::DOUBLE), 9) AS f1_low, round(quantile_cont(f1, 0.975::DOUBLE), 9) AS f1_high FROM f""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.storage.materialize(evaluate.exact(*_sides(spark, sf_dir), ["company"]), "exact")
    out = evaluate.intervals(evaluate.resampled(rows, [], evaluate.hashed_draws(spark, rows.count(), 200, "20260430:")), [], ["precision", "f1"])
    return _rounded(out, *out.columns)


# the draws of bootstrap_ci without a seed
@query(_SIDES + """, placed AS (SELECT *, row_number() OVER (ORDER BY company) - 1 AS position, count(*) OVER () AS n FROM scored),
draws AS (SELECT a.range AS sample, ('0x' || substr(md5(a.range || ':' || b.range), 1, 8))::BIGINT % (SELECT max(n) FROM placed) AS position FROM range(200) a, range((SELECT max(n) FROM placed)) b),
samples AS (SELECT sample, sum(true_positives) AS tp, sum(false_positives) AS fp, sum(false_negatives) AS fn FROM draws JOIN placed USING (position) GROUP BY sample),
f AS (SELECT tp / (tp + fp) AS precision, 2 * tp / (2 * tp + fp + fn) AS f1 FROM samples)
SELECT round(avg(precision), 9) AS precision_mean, round(quantile_cont(precision, 0.025::DOUBLE), 9) AS precision_low, round(quantile_cont(precision, 0.975::DOUBLE), 9) AS precision_high,
  round(avg(f1), 9) AS f1_mean, round(quantile_cont(f1, 0.025::DOUBLE), 9) AS f1_low, round(quantile_cont(f1, 0.975::DOUBLE), 9) AS f1_high FROM f""")
def bootstrap_ci_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.storage.materialize(evaluate.exact(*_sides(spark, sf_dir), ["company"]), "exact")
    out = evaluate.intervals(evaluate.resampled(rows, [], evaluate.hashed_draws(spark, rows.count(), 200)), [], ["precision", "f1"])
    return _rounded(out, *out.columns)


_MARKS = """WITH marks AS (
  SELECT doc_id % 5 AS relation, unnest([CASE WHEN quality = 1 THEN 'a' END, CASE WHEN toxic = 0 THEN 'b' END, CASE WHEN quality + toxic >= 1 THEN 'c' END]) AS annotator, doc_id AS edge FROM labels),
e AS (SELECT DISTINCT relation, annotator, edge FROM marks WHERE annotator IS NOT NULL)"""


@query(_SIDES + """, scoped AS (SELECT 'all' AS scope, * FROM scored UNION ALL SELECT 'without' AS scope, * FROM scored WHERE company <> 'Supplier#000000001'),
placed AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY company) - 1 AS position FROM scoped), sizes AS (SELECT scope, count(*) AS n FROM scoped GROUP BY scope),
draws AS (SELECT scope, a.range AS sample, ('0x' || substr(md5(a.range || ':' || b.range), 1, 8))::BIGINT % n AS position FROM sizes, range(100) a, range((SELECT max(n) FROM sizes)) b WHERE b.range < n),
samples AS (SELECT scope, sample, sum(true_positives) AS tp, sum(false_positives) AS fp, sum(false_negatives) AS fn FROM draws JOIN placed USING (scope, position) GROUP BY scope, sample),
f AS (SELECT scope, tp / (tp + fp) AS precision FROM samples)
SELECT scope, round(avg(precision), 9) AS precision_mean, round(quantile_cont(precision, 0.025::DOUBLE), 9) AS precision_low, round(quantile_cont(precision, 0.975::DOUBLE), 9) AS precision_high FROM f GROUP BY scope""")
def bootstrap_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storage.materialize(evaluate.scopes(evaluate.exact(*_sides(spark, sf_dir), ["company"]), "Supplier#000000001"), "scopes")
    parts = []
    for scope in ("all", "without"):
        own = rows.where(F.col("scope") == scope)
        draws = evaluate.hashed_draws(spark, own.count(), 100)
        parts.append(evaluate.intervals(evaluate.resampled(own, ["scope"], draws), ["scope"], ["precision"]))
    out = parts[0].unionByName(parts[1])
    return _rounded(out, *[c for c in out.columns if c != "scope"])


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    who = F.array(F.when(q == 1, "a"), F.when(t == 0, "b"), F.when(q + t >= 1, "c"))
    rows = projection.table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("relation"), F.explode(who).alias("annotator"), F.col("doc_id").alias("edge"))
    return rows.where("annotator is not null")


@query(_MARKS + """, n AS (SELECT relation, annotator, count(*) AS n FROM e GROUP BY 1, 2),
pair AS (SELECT a.relation, a.n AS na, b.n AS nb, (SELECT count(*) FROM e x JOIN e y ON x.relation = y.relation AND x.edge = y.edge WHERE x.relation = a.relation AND x.annotator = a.annotator AND y.annotator = b.annotator) AS k
  FROM n a JOIN n b ON a.relation = b.relation AND a.annotator < b.annotator)
SELECT relation, round(avg(k / (na + nb - k)), 9) AS average_pairwise_jaccard, round(avg(2 * k / (na + nb)), 9) AS average_pairwise_f1 FROM pair GROUP BY relation""")
def agreement_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.agreement(_marks(spark, sf_dir), ["relation"])
    return _rounded(out.select("relation", "average_pairwise_jaccard", "average_pairwise_f1"), "average_pairwise_jaccard", "average_pairwise_f1")


@query(_MARKS + """, every AS (SELECT relation::VARCHAR AS relation, annotator, relation || ':' || edge AS edge FROM e UNION ALL SELECT 'all', annotator, relation || ':' || edge FROM e),
n AS (SELECT relation, annotator, count(*) AS n FROM every GROUP BY 1, 2),
shared AS (SELECT x.relation, x.annotator AS a, y.annotator AS b, count(*) AS k FROM every x JOIN every y ON x.relation = y.relation AND x.edge = y.edge AND x.annotator < y.annotator GROUP BY 1, 2, 3),
pair AS (SELECT x.relation, x.n AS na, y.n AS nb, coalesce(k, 0) AS k FROM n x JOIN n y ON x.relation = y.relation AND x.annotator < y.annotator
  LEFT JOIN shared s ON s.relation = x.relation AND s.a = x.annotator AND s.b = y.annotator)
SELECT relation, round(avg(k / (na + nb - k)), 9) AS average_pairwise_jaccard, round(avg(2 * k / (na + nb)), 9) AS average_pairwise_f1 FROM pair GROUP BY relation""")
def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.reliability(_marks(spark, sf_dir))
    return _rounded(out.select("relation", "average_pairwise_jaccard", "average_pairwise_f1"), "average_pairwise_jaccard", "average_pairwise_f1")


@query(_MARKS + """, per AS (SELECT relation, edge, count(*) AS k FROM e GROUP BY 1, 2)
SELECT relation, count(*) AS candidate_edges, count(*) FILTER (k = 3) AS unanimous, count(*) FILTER (k = 2) AS majority_only, count(*) FILTER (k = 1) AS single_annotator,
  round(count(*) FILTER (k = 3) / count(*), 9) AS all_way_jaccard FROM per GROUP BY relation""")
def agreement_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _marks(spark, sf_dir)
    return _rounded(evaluate.support(marks, ["relation"], len(evaluate.annotators(marks))), "all_way_jaccard")


# ------------------------------------------------------------------ routing

_ROUTED = """WITH l AS (SELECT vec_id, [embedding[1]::DOUBLE * 20, embedding[2]::DOUBLE * 20, embedding[3]::DOUBLE * 20] AS x, ['api_fallback', 'local', 'refuse'][label % 3 + 1] AS label FROM embeddings),
p AS (SELECT vec_id, label, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM l),
q AS (SELECT vec_id, label, list_transform(e, lambda v: v / (e[1] + e[2] + e[3])) AS p FROM p),
r AS (SELECT vec_id, label, p, CASE WHEN p[2] >= 0.97 THEN 'local' WHEN p[3] >= p[1] THEN 'refuse' ELSE 'api_fallback' END AS predicted FROM q)
"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = projection.table(spark, sf_dir, "embeddings")
    logits = F.array(*[F.element_at("embedding", i).cast("double") * 20 for i in (1, 2, 3)])
    label = F.element_at(F.array(*map(F.lit, router.ROUTES)), (F.col("label") % 3 + 1).cast("int"))
    return e.select("vec_id", label.alias("label"), router.probabilities(logits).alias("p")).withColumn("predicted", router.decide(F.col("p")))


@query(_ROUTED + "SELECT vec_id, round(p[1], 6) AS api_fallback, round(p[2], 6) AS local, round(p[3], 6) AS refuse FROM r")
def router_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("vec_id", *[F.round(F.element_at("p", i + 1), 6).alias(r) for i, r in enumerate(router.ROUTES)])


@query(_ROUTED + "SELECT vec_id, predicted FROM r")
def router_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("vec_id", "predicted")


@query(_ROUTED + "SELECT label, count(*) FILTER (predicted = 'api_fallback') AS api_fallback, count(*) FILTER (predicted = 'local') AS local, count(*) FILTER (predicted = 'refuse') AS refuse FROM r GROUP BY label")
def router_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.confusion(_routed(spark, sf_dir))


@query(_ROUTED + """, c AS (SELECT route AS label, (SELECT count(*) FROM r WHERE label = route) AS support, (SELECT count(*) FROM r WHERE predicted = route) AS predicted_count,
  (SELECT count(*) FROM r WHERE predicted = route AND label = route) AS hits FROM (SELECT unnest(['api_fallback', 'local', 'refuse']) AS route)),
d AS (SELECT *, coalesce(hits / nullif(predicted_count, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM c)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1, support, predicted_count FROM d""")
def router_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(router.metrics(_routed(spark, sf_dir)), "precision", "recall", "f1")


@query(_ROUTED + "SELECT label, round((SELECT count(*) FROM r) / (3 * count(*)), 9) AS weight FROM r GROUP BY label")
def router_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(router.class_weights(_routed(spark, sf_dir)), "weight")


@query(_ROUTED + "SELECT coalesce(avg((label = 'local')::INT) FILTER (predicted = 'local'), -1) >= 0.97 AS planner_gate_open FROM r")
def router_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router.gate_open(_routed(spark, sf_dir))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\b(add|create|delete|drop|insert|load|merge|remove|set|update|upsert|write)\\b', 'i') THEN 'write_request'
  WHEN regexp_matches(text, '\\b(\\d{4}|quarter|q[1-4]|month|week|year|yoy|over time|trend|historic)\\b', 'i') THEN 'unsupported_time' ELSE 'beyond_local_coverage' END AS reason FROM conversations""")
def refusal_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.table(spark, sf_dir, "conversations").select("conv_id", "turn", router.refusal_reason(F.col("text")).alias("reason"))


# ------------------------------------------------------------------ preparation


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS t, count(*) OVER (PARTITION BY role) AS n FROM conversations),
m AS (SELECT max(n) AS most FROM n), r AS (SELECT role, conv_id, turn, unnest(range(t, least(most, 3 * n), n)) AS repeat_index FROM n, m)
SELECT role, conv_id, turn, repeat_index FROM r""")
def rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", F.struct("conv_id", "turn").alias("idx"))
    return prepare.rebalance(rows, "role").select("role", "conv_id", "turn", "repeat_index")


@query("SELECT role, count(*) AS rows FROM conversations GROUP BY role")
def family_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.histogram(projection.table(spark, sf_dir, "conversations"), "role")


_TWO = _RAW + """, a AS (SELECT DISTINCT lower(subject) AS s, subject_type, relation, lower(object) AS o, object_type FROM raw WHERE idx % 7 <> 0),
b AS (SELECT DISTINCT lower(subject) AS s, subject_type, relation, lower(object) AS o, object_type FROM raw WHERE idx % 5 <> 0)"""


@query(_TWO + " SELECT (SELECT count(*) FROM b) AS triples_out, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS added, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS removed")
def triple_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return validate.delta(raw.where("idx % 7 <> 0"), raw.where("idx % 5 <> 0"))


@query(_RAW + " SELECT DISTINCT subject, subject_type, relation, object, object_type FROM raw WHERE (relation <> 'OFFERS' AND idx % 7 <> 0) OR (relation = 'OFFERS' AND idx % 5 <> 0)")
def relation_subset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return validate.merge_relations(raw.where("idx % 7 <> 0"), raw.where("idx % 5 <> 0"), ["OFFERS"]).select(*validate.FIELDS)


# ------------------------------------------------------------------ helpers with data


@query("SELECT doc_id, length(text) AS content_length, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '(\\r\\n|[\\n\\r])$', ''), chr(10))) END AS line_count FROM documents")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.table(spark, sf_dir, "documents").select("doc_id", *runs.text_stats(F.col("text")))


@query("SELECT event_id, json(props)::VARCHAR AS compact FROM events")
def compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.table(spark, sf_dir, "events").select("event_id", runs.compact_json(F.col("props")).alias("compact"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_type), lower(p_type)) THEN 0 ELSE 1 END
  + CASE WHEN contains(lower(p_name || ' ' || p_type), lower(p_brand)) THEN 0 ELSE 1 END AS ungrounded FROM part""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = projection.table(spark, sf_dir, "part")
    triples = part.select("p_partkey", "p_name", "p_type", F.col("p_type").alias("subject"), F.lit("BusinessSegment").alias("subject_type"), F.lit("OFFERS").alias("relation"), F.col("p_brand").alias("object"), F.lit("Offering").alias("object_type"))
    out = validate.validate_each(triples, source=F.concat_ws(" ", "p_name", "p_type"))
    return out.select("p_partkey", F.size(F.filter("issues", lambda i: i["code"] == "not_grounded_in_text")).alias("ungrounded"))


@query("SELECT c_custkey, n_name AS place, true AS place_known FROM customer JOIN nation ON c_nationkey = n_nationkey")
def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.table(spark, sf_dir, "customer").join(projection.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = rows.select("c_custkey", F.concat(F.lit(" '"), F.lower("n_name"), F.lit("' ")).alias("asked"))
    return normalize_place(named, "asked", projection.places(spark, sf_dir).names(spark), "place").select("c_custkey", "place", "place_known")


@query("SELECT s_name AS company, s_suppkey % 3 > 0 AS has_outputs, s_suppkey % 2 = 0 AS is_loaded FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 2 = 0")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = projection.table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "company")
    return runs.status_report(s.where("s_suppkey % 3 > 0"), s.where("s_suppkey % 2 = 0"))


@query("SELECT conv_id, turn, regexp_matches(text, '\\b(CREATE|MERGE|DELETE|DETACH|DROP|SET|REMOVE|CALL|LOAD\\s+CSV)\\b', 'i') AS writes FROM conversations")
def read_only_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.size(router.forbidden_clauses(F.col("text"))) > 0).alias("writes"))


@query(_TWO + " SELECT relation, s, count(*) AS n FROM (SELECT relation, lower(subject) AS s FROM raw WHERE idx % 7 <> 0 EXCEPT ALL SELECT relation, lower(subject) FROM raw WHERE idx % 5 <> 0) GROUP BY 1, 2")
def row_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select("relation", F.lower("subject").alias("s"), "idx")
    rest = raw.where("idx % 7 <> 0").drop("idx").exceptAll(raw.where("idx % 5 <> 0").drop("idx"))
    return rest.groupBy("relation", "s").agg(F.count("*").alias("n"))


@query("SELECT doc_id % 3 AS family, count(*) AS rows, round(avg((quality = 1)::INT), 9) AS contract_rate, round(avg((toxic = 0)::INT), 9) AS correct_output_rate FROM labels GROUP BY 1")
def planner_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = projection.table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("family"), (F.col("quality") == 1).alias("contract"), (F.col("toxic") == 0).alias("correct_output"))
    return _rounded(prepare.planner_metrics(flags), "contract_rate", "correct_output_rate")


@query("""WITH l AS (SELECT n_chars % 700 AS prompt, n_chars % 90 AS completion FROM documents)
SELECT count(*) AS rows, max(prompt + completion) AS max_full, max(prompt) AS max_prompt, max(completion) AS max_completion, count(*) FILTER (least(prompt + completion, 512) <= prompt) AS prompt_fills_window FROM l""")
def token_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = projection.table(spark, sf_dir, "documents").select((F.col("n_chars") % 700).alias("prompt"), (F.col("n_chars") % 90).alias("completion"))
    return prepare.token_preflight(d, 512)


@query("SELECT conv_id, turn, '[{\"role\":\"system\",\"content\":\"Plan.\"},{\"role\":\"user\",\"content\":\"' || role || '\"},{\"role\":\"assistant\",\"content\":\"' || turn || '\"}]' AS messages FROM conversations")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.to_json(prepare.chat_messages(F.lit("Plan."), F.col("role"), F.col("turn").cast("string"))).alias("messages"))
