"""Queries over single parts of the engine: sources, names, places, routing, preparation, loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import projection, storage
from orrery.functions import text
from orrery.operators import evaluate, prepare, router, validate
from orrery.operators import graph as graphs
from orrery.operators.places import normalize_place
from orrery.plans import execute
from orrery.queries import _CHECKED, _RAW, _ROUTED, _SIDES, _raw, _routed, _rounded, _sides, query
from orrery.sources import runs
from orrery.sources import triples as sources

_FIELDS = "subject, subject_type, relation, object, object_type"


# ------------------------------------------------------------------ sources


@query(_RAW + f" SELECT {_FIELDS}, count(*) AS n FROM raw GROUP BY ALL")
def gold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch_path(spark, "gold")
    sources.write_lines(_raw(spark, sf_dir).select(*validate.FIELDS), path)
    return sources.read_gold(spark, path).groupBy(*validate.FIELDS).agg(F.count("*").alias("n"))


@query("SELECT chr((97 + l_linenumber % 3)::INT) AS annotator, count(DISTINCT (l_partkey, l_suppkey)) AS edges FROM lineitem GROUP BY 1")
def annotator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.table(spark, sf_dir, "lineitem")
    named = rows.select(
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("annotator"),
        F.concat(F.lit(" Part  "), F.col("l_partkey")).alias("subject"),
        F.lit(" OFFERS ").alias("relation"),
        F.concat(F.lit("'SUPPLIER "), F.col("l_suppkey"), F.lit("'")).alias("object"),
    )
    path = storage.scratch_path(spark, "annotators")
    sources.write_lines(named, path)
    return sources.read_annotators(spark, path).groupBy("annotator").agg(F.count("*").alias("edges"))


_ONE = """'{"subject":"' || s_name || '","subject_type":"Company","relation":"OPERATES_IN","object":"' || s_nationkey || '","object_type":"Place"}'"""
_FORMS = f"""CASE s_suppkey % 8 WHEN 0 THEN '{{"triples":[' || {_ONE} || ']}}' WHEN 1 THEN '{{"resolved_triples":[' || {_ONE} || ']}}'
  WHEN 2 THEN '{{"valid_triples":[' || {_ONE} || ']}}' WHEN 3 THEN '[' || {_ONE} || ',' || {_ONE} || ']' WHEN 4 THEN {_ONE}
  WHEN 5 THEN '```json' || chr(10) || '{{"triples":[' || {_ONE} || ']}}' || chr(10) || '```' WHEN 6 THEN 'Here: {{"triples":[' || {_ONE} || ' as asked' ELSE 'none' END"""


@query("""SELECT s_suppkey, CASE s_suppkey % 8 WHEN 3 THEN 2 WHEN 7 THEN 0 ELSE 1 END AS triples, CASE WHEN s_suppkey % 8 < 7 THEN s_name END AS subject,
  s_suppkey % 8 IN (5, 6) AS recovered, s_suppkey % 8 = 7 AS used_fallback FROM supplier""")
def payload_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = projection.table(spark, sf_dir, "supplier").select("s_suppkey", sources.parse_payload(F.expr(_FORMS)).alias("p"))
    found = sources.payload_triples(F.col("p.payload"))
    return parsed.select("s_suppkey", F.size(found).alias("triples"), F.get(found, F.lit(0))["subject"].alias("subject"), "p.recovered", "p.used_fallback")


@query("SELECT event_id, replace(props, ' ', '') AS found FROM events")
def first_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("Sure {not this} then: "), "props", F.lit(' and {"z": 1}'))
    rows = projection.table(spark, sf_dir, "events").select("event_id", noisy.alias("t"))
    return sources.first_object(rows, "t", "found").drop("t")


@query(r"SELECT doc_id, length(text) AS character_count, len(regexp_extract_all(text, '[^\s\p{Z}\x{0B}\x{85}]+')) AS word_count FROM documents")
def filing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.with_counts(projection.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "character_count", "word_count")


_PATHS = """'/out/supplier_' || o_custkey % 50 || '/' || o_orderpriority || '/' || CASE o_orderkey % 4 WHEN 0 THEN 'latest' WHEN 1 THEN 'other' WHEN 2 THEN 'runs/r' || o_orderkey % 90 ELSE 'failed/f' || o_orderkey % 70 END || '/resolved_triples.json'"""


def _run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.run_parts(projection.table(spark, sf_dir, "orders").select(F.expr(_PATHS).alias("path")))


@query("""SELECT 'supplier_' || o_custkey % 50 AS slug, o_orderpriority AS pipeline, bool_or(o_orderkey % 4 = 0) AS latest_available,
  coalesce(string_agg(DISTINCT 'r' || o_orderkey % 90, ',' ORDER BY 'r' || o_orderkey % 90) FILTER (o_orderkey % 4 = 2), '') AS runs,
  coalesce(string_agg(DISTINCT 'f' || o_orderkey % 70, ',' ORDER BY 'f' || o_orderkey % 70) FILTER (o_orderkey % 4 = 3), '') AS failed
  FROM orders WHERE o_orderkey % 4 <> 1 GROUP BY 1, 2""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sources.company_states(_run_files(spark, sf_dir))
    return out.select("slug", "pipeline", "latest_available", F.array_join("available_run_tokens", ",").alias("runs"), F.array_join("failed_run_tokens", ",").alias("failed"))


@query("SELECT 'supplier_' || o_custkey % 50 AS slug, count(*) AS files FROM orders WHERE o_orderkey % 4 = 0 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def load_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.load_targets(_run_files(spark, sf_dir), "1-URGENT").groupBy("slug").agg(F.count("*").alias("files"))


@query("""SELECT s_name AS slug, 'analyst' AS pipeline, CASE WHEN s_suppkey % 3 = 0 THEN 'missing_prediction' ELSE 'evaluated' END AS status,
  CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey || '.json' END AS prediction_path FROM supplier""")
def evaluation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = projection.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("slug"), F.lit("analyst").alias("pipeline"))
    predictions = s.where("s_suppkey % 3 > 0").select("slug", "pipeline", F.concat(F.col("s_suppkey"), F.lit(".json")).alias("prediction_path"))
    return sources.pair_evaluations(s.drop("s_suppkey"), predictions)


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'Acme.Ltd ' || s_suppkey ELSE 'My Firm' END AS company FROM supplier")
def run_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    s = projection.table(spark, sf_dir, "supplier")
    stem = F.when(k == 1, F.concat(F.lit("acme.ltd_"), "s_suppkey", F.lit("_10k"))).otherwise(F.lit(""))
    return s.select("s_suppkey", runs.company_name(F.when(k == 0, F.concat(F.lit(" "), "s_name", F.lit(" "))), stem, F.lit("my_firm")).alias("company"))


@query("""SELECT count(*) FILTER (s_acctbal >= 1000) AS ok, count(*) FILTER (s_acctbal >= 0 AND s_acctbal < 1000) AS warn, count(*) FILTER (s_acctbal < 0) AS fail FROM supplier""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("s_acctbal") >= 1000, "ok").when(F.col("s_acctbal") >= 0, "warn").otherwise("fail")
    return runs.health_summary(projection.table(spark, sf_dir, "supplier").select(status.alias("status")))


# ------------------------------------------------------------------ names


@query("SELECT c_custkey, lower(c_name) || '’s' AS planner, lower(c_name) || '''s' AS canonical FROM customer")
def planner_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat(F.lit("“"), "c_name", F.lit("’s” "))
    return projection.table(spark, sf_dir, "customer").select("c_custkey", text.planner_key(n).alias("planner"), text.canonical_key(n).alias("canonical"))


@query("""SELECT c_custkey, c_custkey % 4 < 3 AS compatible, c_custkey % 4 < 3 AS company_match, c_custkey % 4 = 0 AS offering_match, false AS typed_match FROM customer""")
def names_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(F.lit("Firm "), "c_name")
    k = F.col("c_custkey") % 4
    b = F.when(k == 0, F.upper(a)).when(k == 1, F.concat(a, F.lit(", Inc."))).when(k == 2, F.concat(a, F.lit(" Europe"))).otherwise(F.concat(F.lit("The "), a))
    kind = lambda x, y: text.values_match(a, F.lit(x), b, F.lit(y))
    return projection.table(spark, sf_dir, "customer").select("c_custkey", text.companies_compatible(a, b).alias("compatible"), kind("Company", "Company").alias("company_match"), kind("Offering", "Offering").alias("offering_match"), kind("Company", "Offering").alias("typed_match"))


@query("SELECT c_custkey, 'Firm-' || c_custkey || '.Co Ltd' AS plain, 'Firm ' || c_custkey || '.Co Ltd' AS gold FROM customer")
def companies_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/firm-"), "c_custkey", F.lit(".co_ltd_10k.jsonl"))
    return projection.table(spark, sf_dir, "customer").select("c_custkey", sources.company_of_path(path).alias("plain"), sources.company_of_path(path, True).alias("gold"))


# ------------------------------------------------------------------ places and rules


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Atlantis ' || c_custkey ELSE n_name END AS object, (c_custkey % 3 = 0)::INT AS invalid_places FROM customer JOIN nation ON c_nationkey = n_nationkey")
def place_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.table(spark, sf_dir, "customer").join(projection.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Atlantis "), "c_custkey")).otherwise(F.lower("n_name"))
    triples = rows.select("c_custkey", F.col("c_name").alias("subject"), F.lit("Company").alias("subject_type"), F.lit("OPERATES_IN").alias("relation"), place.alias("object"), F.lit("Place").alias("object_type"))
    out = validate.validate_each(triples, projection.places(spark, sf_dir).names(spark))
    return out.select("c_custkey", "object", F.size(F.filter("issues", lambda i: i["code"] == "invalid_place")).alias("invalid_places"))


_PARENT = """WITH RECURSIVE parent AS (SELECT n_name AS place, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region),
above AS (SELECT place, parent AS ancestor FROM parent UNION SELECT a.place, p.parent FROM above a JOIN parent p ON a.ancestor = p.place)"""


@query(_PARENT + """, every AS (SELECT place FROM parent UNION SELECT parent FROM parent)
SELECT x.place AS requested, y.place AS company_place, CASE WHEN x.place = y.place THEN 'exact' WHEN (y.place, x.place) IN (SELECT (place, ancestor) FROM above) THEN 'narrower_place'
  ELSE 'broader_region' END AS geography_match FROM every x JOIN every y ON x.place = y.place OR (y.place, x.place) IN (SELECT (place, ancestor) FROM above) OR (x.place, y.place) IN (SELECT (place, ancestor) FROM above)""")
def place_match_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = projection.places(spark, sf_dir)  # 31 names
    pairs = [(x, y, places.classify(x.lower(), f" {y} ")) for x in places.parents for y in places.parents]
    return spark.createDataFrame([p for p in pairs if p[2]], "requested string, company_place string, geography_match string")


@query(_PARENT + " SELECT place, parent, (SELECT count(*) FROM parent c WHERE c.parent = p.place) AS children FROM parent p")
def place_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = projection.places(spark, sf_dir)
    rows = [(p, q, len(places.children.get(p, ()))) for p, own in places.parents.items() for q in own]
    return spark.createDataFrame(rows, "place string, parent string, children long")


@query(_RAW + """, each AS (SELECT company, idx % 2 AS stage, (relation = 'OPERATES_IN')::INT AS bad, (relation = 'SERVES')::INT AS off FROM raw)
SELECT company, count(*) AS raw_triple_count, sum(bad)::BIGINT AS malformed_triple_count, sum(off)::BIGINT AS ontology_rejected_triple_count, (count(*) - sum(bad) - sum(off))::BIGINT AS kept_triple_count,
  sum(bad)::BIGINT AS empty_subjects FROM each GROUP BY company""")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _raw(spark, sf_dir).withColumn("is_object", F.lit(True)).withColumn("stage", F.col("idx") % 2)
    out = validate.roll_up(validate.audit(staged, ["company", "stage"]), ["company"])
    empty = F.coalesce(F.try_element_at("invalid_issue_counts", F.lit("empty_subject")), F.lit(0))
    return out.select("company", "raw_triple_count", "malformed_triple_count", "ontology_rejected_triple_count", "kept_triple_count", empty.alias("empty_subjects"))


@query("SELECT o_orderkey, o_orderkey % 4 < 2 AS matches FROM orders")
def parameter_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    sql = F.when(k == 0, "select $a, $b, $a").when(k == 1, "select 1").when(k == 2, "select $a").otherwise("select $c")
    names = F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("b"), F.lit("a")))
    return projection.table(spark, sf_dir, "orders").select("o_orderkey", router.parameters_match(sql, names).alias("matches"))


@query(_SIDES + """, walk AS (SELECT company, 'Company' AS kind, company AS above, segment AS below FROM has_segment UNION SELECT company, 'Company', company, offering FROM roots
  UNION SELECT company, 'BusinessSegment', segment, offering FROM roots)
SELECT company, kind, count(*) AS paths FROM (SELECT DISTINCT company, kind, above, below FROM walk) GROUP BY 1, 2""")
def hierarchy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _ = _sides(spark, sf_dir)
    out = evaluate.hierarchy_closure(evaluate.keyed(gold), ["company"])
    return out.groupBy("company", F.col("type").alias("kind")).agg(F.count("*").alias("paths"))


@query(_CHECKED + f"""SELECT {_FIELDS}, count(*) AS n FROM (SELECT company, {_FIELDS} FROM raw WHERE company IN (SELECT company FROM raw GROUP BY company HAVING max(idx) % 2 = 0)
  UNION ALL SELECT company, {_FIELDS} FROM raw WHERE idx % 7 <> 0 AND company NOT IN (SELECT company FROM raw GROUP BY company HAVING max(idx) % 2 = 0)) GROUP BY ALL""")
def last_good_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    even = raw.groupBy("company").agg((F.max("idx") % 2 == 0).alias("failed"))
    after = raw.where("idx % 7 <> 0").join(even.where("not failed"), "company", "left_semi")
    return validate.last_good(raw, after, ["company"]).groupBy(*validate.FIELDS).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ routing and preparation


@query(_ROUTED + "SELECT vec_id, CASE WHEN x[1] >= x[2] AND x[1] >= x[3] THEN 'api_fallback' WHEN x[2] >= x[3] THEN 'local' ELSE 'refuse' END AS best FROM l")
def router_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = projection.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", router.argmax(F.array(*[F.element_at("embedding", i).cast("double") * 20 for i in (1, 2, 3)])).alias("best"))


@query(_ROUTED + """, seen AS (SELECT label, CASE predicted WHEN 'refuse' THEN 'local' ELSE predicted END AS predicted FROM r),
c AS (SELECT route AS label, (SELECT count(*) FROM seen WHERE label = route) AS support, (SELECT count(*) FROM seen WHERE predicted = route) AS predicted_count,
  (SELECT count(*) FROM seen WHERE predicted = route AND label = route) AS hits FROM (SELECT unnest(['api_fallback', 'local', 'refuse']) AS route)),
d AS (SELECT *, coalesce(hits / nullif(predicted_count, 0), 1) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall FROM c)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM d""")
def router_training_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _routed(spark, sf_dir).withColumn("predicted", F.when(F.col("predicted") == "refuse", "local").otherwise(F.col("predicted")))
    return _rounded(router.metrics(rows, zero_precision=1.0).drop("support", "predicted_count"), "precision", "recall", "f1")


@query(_ROUTED + """SELECT round(avg((label = predicted)::INT), 9) AS accuracy FROM r""")
def router_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(router.overall(_routed(spark, sf_dir)).select("accuracy"), "accuracy")


@query("SELECT DISTINCT company, offering FROM roots ORDER BY company, offering LIMIT 7", base=True)
def q03_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = projection.graph(spark, sf_dir)
    every = [r["s_name"] for r in projection.table(spark, sf_dir, "supplier").select("s_name").orderBy("s_name").limit(40).collect()]
    return execute({"family": "offerings_by_company", "payload": {"companies": every, "limit": 7}}, g)


_SPLIT = "CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END"
_ROUTE = "CASE turn % 2 WHEN 0 THEN 'local_safe' ELSE 'refuse' END"


def _planner_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.expr(_SPLIT).alias("split"), F.expr(_ROUTE).alias("route_label"), F.col("role").alias("family"))


@query(f"""SELECT split, family, count(*) AS rows FROM (SELECT {_SPLIT} AS split, role AS family FROM conversations WHERE turn % 2 = 0
  UNION ALL SELECT 'train', role FROM conversations WHERE turn % 2 = 0 AND conv_id % 3 = 2) GROUP BY 1, 2""")
def augmented_planner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planner_table(spark, sf_dir)
    return prepare.planner_rows(rows, rows.where("split = 'test'")).groupBy("split", "family").agg(F.count("*").alias("rows"))


@query(f"SELECT label, split, source_route_label, family, count(*) AS rows FROM (SELECT replace({_ROUTE}, 'local_safe', 'local') AS label, {_SPLIT} AS split, {_ROUTE} AS source_route_label, role AS family FROM conversations) GROUP BY ALL")
def router_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prepare.router_rows(_planner_table(spark, sf_dir))
    return out.groupBy("label", "split", "source_route_label", "family").agg(F.count("*").alias("rows"))


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS row FROM nation""")
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.row_text(projection.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"))


_IDS = """CASE c_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN [c_custkey] WHEN 2 THEN [c_custkey, 1] ELSE [-c_custkey, c_custkey, -1] END"""


def _graph_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = projection.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ids = F.when(k % 4 == 0, F.array().cast("array<bigint>")).when(k % 4 == 1, F.array(k)).when(k % 4 == 2, F.array(k, F.lit(1))).otherwise(F.array(-k, k, F.lit(-1)))
    return c.select(k.alias("row_id"), ids.cast("array<string>").alias("source_graph_ids")), c.select(k.cast("string").alias("graph_id"), "c_mktsegment")


@query(f"""WITH i AS (SELECT c_custkey AS row_id, {_IDS} AS ids FROM customer), e AS (SELECT row_id, unnest(range(len(ids))) AS place, unnest(ids) AS id FROM i)
SELECT row_id, place::INT AS place, id::VARCHAR AS graph_id, c_mktsegment FROM e JOIN customer ON id = c_custkey""")
def planner_row_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.row_graphs(*_graph_rows(spark, sf_dir)).where("found").select("row_id", "place", "graph_id", "c_mktsegment")


@query("""SELECT c_custkey AS row_id, CASE c_custkey % 4 WHEN 0 THEN 'no source graphs' ELSE 'unknown graphs: ' || -c_custkey || ', -1' END AS error FROM customer WHERE c_custkey % 4 IN (0, 3)""")
def planner_graph_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.graph_errors(*_graph_rows(spark, sf_dir))


# ------------------------------------------------------------------ the graph


@query("""SELECT company, sum(n)::BIGINT AS loaded_rows FROM (SELECT s_name AS company, 7 AS n FROM fact JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT company, 1 FROM operates UNION ALL SELECT company, 1 FROM partners) GROUP BY company""", base=True)
def load_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.loaded_rows(projection.triples(spark, sf_dir))


@query("""SELECT name, count(DISTINCT company) AS companies FROM (SELECT company, offering AS name FROM roots UNION SELECT company, child FROM child) GROUP BY name HAVING count(DISTINCT company) > 1""", base=True)
def offering_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.graph(spark, sf_dir).collisions()


@query("SELECT rel, count(*) AS edges FROM (SELECT 'HAS_SEGMENT' AS rel FROM has_segment UNION ALL SELECT 'SERVES' FROM serves UNION ALL SELECT 'SELLS_THROUGH' FROM sells UNION ALL SELECT 'PARTNERS_WITH' FROM partners) GROUP BY rel", base=True)
def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.scratch_path(spark, "graph")
    projection.graph(spark, sf_dir).write(path)
    graphs.read(spark, path).write(path)
    kept = graphs.read(spark, path).edges.where("rel in ('HAS_SEGMENT', 'SERVES', 'SELLS_THROUGH', 'PARTNERS_WITH')")
    return kept.groupBy("rel").agg(F.count("*").alias("edges"))
