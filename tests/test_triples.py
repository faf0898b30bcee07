import json

import pytest
from pyspark.sql import functions as F

from orrery.operators import evaluate, prepare, router, validate
from orrery.operators.graph import TRIPLE
from orrery.operators.places import default_places
from orrery.sources import triples as S
from orrery.streaming.ingest import ingest

SCHEMA = f"batch string, idx long, {TRIPLE}"


def frame(spark, *rows, batch="b"):
    return spark.createDataFrame([(batch, n, *r) for n, r in enumerate(rows)], SCHEMA)


def checked(spark, *rows, **more):
    out = validate.validate_batch(frame(spark, *rows), ["batch"], **more).orderBy("idx").collect()
    return [(r.status, [i.code for i in r.issues]) for r in out]


OFFER = ("Cloud", "BusinessSegment", "OFFERS", "Platform", "Offering")
CHILD = ("Platform", "Offering", "OFFERS", "Database", "Offering")


def test_single_rules(spark):
    names = default_places(spark).names(spark)
    rows = [
        ("Acme", "Company", "OPERATES_IN", "U.S.", "Place"),
        ("Acme", "Company", "OPERATES_IN", "Atlantis", "Place"),
        ("", "Company", "PARTNERS_WITH", "Globex", "Company"),
        ("Acme", "Robot", "KNOWS", "Globex", "Thing"),
        ("Acme", "Company", "SERVES", "consumers", "CustomerType"),
        ("Cloud", "BusinessSegment", "SERVES", "Consumers", "CustomerType"),
    ]
    assert checked(spark, *rows, place_names=names) == [
        ("valid", []),
        ("invalid", ["invalid_place"]),
        ("invalid", ["empty_subject"]),
        ("invalid", ["invalid_subject_type", "invalid_object_type", "invalid_relation"]),
        ("invalid", ["invalid_relation_schema"]),
        ("invalid", ["non_canonical_label"]),
    ]
    assert validate.validate_each(frame(spark, rows[0]), names).first().object == "United States"


def test_batch_rules(spark):
    assert checked(spark, OFFER, ("cloud", *OFFER[1:])) == [("valid", []), ("duplicate", [])]
    other = ("Suite", "Offering", "OFFERS", "Database", "Offering")
    assert checked(spark, CHILD, other, CHILD) == [("valid", []), ("invalid", ["multiple_offering_parents"]), ("duplicate", [])]
    money = ("Database", "Offering", "MONETIZES_VIA", "subscription", "RevenueModel")
    assert checked(spark, CHILD, money) == [("valid", []), ("invalid", ["child_offering_monetizes_via"])]
    sells = ("Platform", "Offering", "SELLS_THROUGH", "online", "Channel")
    assert checked(spark, OFFER, sells) == [("valid", []), ("invalid", ["segment_anchored_offering_sells_through"])]


def test_grounding(spark):
    rows = frame(spark, OFFER).withColumn("source", F.lit("Our cloud has a PLATFORM."))
    assert validate.validate_each(rows, source=F.col("source")).first().issues == []
    rows = rows.withColumn("source", F.lit("Nothing here"))
    assert [i.code for i in validate.validate_each(rows, source=F.col("source")).first().issues] == ["not_grounded_in_text"] * 2


def test_resolve(spark):
    p = lambda a, b: (a, "Company", "PARTNERS_WITH", b, "Company")
    rows = validate.resolve(frame(spark, p("OPENAI", "“Acme”"), p("OpenAI", "Acme"), p("openai", "acme"), p("", "x")), ["batch"]).collect()
    assert [(r.subject, r.object) for r in rows] == [("OpenAI", "Acme")]


def test_audit(spark):
    rows = spark.createDataFrame([("b", 0, *OFFER, True), ("b", 1, None, *OFFER[1:], True), ("b", 2, "", *OFFER[1:], True), ("b", 3, "A", "X", "Y", "B", "Z", True), ("b", 4, None, None, None, None, None, False)], SCHEMA + ", is_object boolean")
    r = validate.audit(rows, ["batch"]).first()
    assert (r.raw_triple_count, r.missing_key_triple_count, r.malformed_triple_count, r.ontology_rejected_triple_count, r.kept_triple_count, r.non_dict_triple_count) == (5, 1, 1, 1, 1, 1)
    assert r.invalid_issue_counts["invalid_relation"] == 1
    both = validate.roll_up(validate.audit(rows, ["batch"]).union(validate.audit(rows, ["batch"])), ["batch"]).first()
    assert both.kept_triple_count == 2 and both.invalid_issue_counts["empty_subject"] == 2


# ------------------------------------------------------------------ evaluation


def ev(spark, *rows):
    return spark.createDataFrame([("acme", *r) for r in rows], f"company string, {TRIPLE}")


def test_case_and_type_differences(spark):
    gold = ev(spark, ("Acme", "Company", "HAS_SEGMENT", "Cloud", "BusinessSegment"), OFFER)
    pred = ev(spark, (" acme", "Company", "HAS_SEGMENT", "CLOUD ", "BusinessSegment"), ("Cloud", "Company", "OFFERS", "Platform", "Offering"))
    r = evaluate.exact(gold, pred, ["company"]).first()
    assert (r.precision, r.recall, r.f1) == (1, 1, 1)
    assert evaluate.relaxed(gold, pred, ["company"]).first().relaxed_f1 == pytest.approx(0.5)


def test_hierarchy_and_rollup(spark):
    gold = ev(spark, OFFER, CHILD, ("Database", "Offering", "MONETIZES_VIA", "subscription", "RevenueModel"))
    pred = ev(spark, OFFER, CHILD, ("Platform", "Offering", "MONETIZES_VIA", "subscription", "RevenueModel"))
    assert evaluate.relaxed(gold, pred, ["company"]).first().relaxed_true_positives == pytest.approx(2.75)
    seg = lambda s, o: (s, "BusinessSegment", "OFFERS", o, "Offering")
    serve = lambda s: (s, "BusinessSegment", "SERVES", "consumers", "CustomerType")
    gold, pred = ev(spark, seg("A", "x"), serve("A")), ev(spark, seg("B", "x"), serve("B"))
    got = evaluate.greedy(evaluate.candidates(gold, pred, ["company"]), ["company"]).collect()
    assert sorted((r.weight, r.reason) for r in got) == [(0.5, "subject_segment_rollup")] * 2
    alias = evaluate.candidates(ev(spark, ("Alphabet Inc.", "Company", "OPERATES_IN", "Europe", "Place")), ev(spark, ("Alphabet", "Company", "OPERATES_IN", "Europe", "Place")), ["company"]).first()
    assert alias.weight == 0.9


def test_extra_prediction_and_bootstrap(spark):
    gold, pred = ev(spark, OFFER), ev(spark, OFFER, CHILD)
    row = evaluate.exact(gold, pred, ["company"])
    assert row.first().f1 == pytest.approx(2 / 3)
    rows = row.select("company", *[c for c in row.columns if c != "company"]).union(spark.createDataFrame([("b", 0, 0, 1, 0.0, 0.0, 0.0)], row.schema))
    out = evaluate.aggregate(rows, []).first()
    assert (out.precision, out.recall, out.macro_f1) == (0.5, 0.5, pytest.approx(1 / 3))
    ci = evaluate.intervals(evaluate.resampled(rows, [], evaluate.seeded_draws(spark, 2, 50)), [], ["recall"]).first()
    assert 0 <= ci.recall_low <= ci.recall_mean <= ci.recall_high <= 1


def test_annotators(spark):
    marks = [("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 2), ("c", 3)]
    edges = spark.createDataFrame([("r", *m) for m in marks], "relation string, annotator string, edge int")
    r = evaluate.agreement(edges, ["relation"]).first()
    assert (r.unanimous, r.majority_only, r.single_annotator) == (1, 1, 1)
    assert r.average_pairwise_jaccard == pytest.approx((1 + 1 / 3 + 1 / 3) / 3)


# ------------------------------------------------------------------ routing, preparation, sources


def test_routing(spark):
    probs = [[0.01, 0.98, 0.01], [0.02, 0.96, 0.02], [0.6, 0.2, 0.2], [0.1, 0.5, 0.4], [0.3, 0.4, 0.3]]
    rows = spark.createDataFrame([(p,) for p in probs], "p array<double>")
    assert [r[0] for r in rows.select(router.decide(F.col("p"))).collect()] == ["local", "refuse", "api_fallback", "refuse", "refuse"]
    none = spark.createDataFrame([("local", "refuse")], "label string, predicted string")
    assert router.gate_open(none).first()[0] is False
    assert router.gate_open(spark.createDataFrame([("local", "local")] * 3, none.schema)).first()[0] is True
    assert {r.label: r.precision for r in router.metrics(none, 1.0).collect()} == {"api_fallback": 1.0, "local": 1.0, "refuse": 0.0}
    q = spark.createDataFrame([("MATCH (n) SET n.x = $a",), ("RETURN $a",)], "q string")
    assert [r[0] for r in q.select(router.forbidden_clauses(F.col("q"))).collect()] == [["SET"], []]
    assert q.select(router.parameters_match(F.col("q"), F.array(F.lit("a")))).first()[0]


def test_rebalance(spark):
    rows = spark.createDataFrame([("a", n) for n in range(10)] + [("b", 0), ("b", 1)], "family string, idx int")
    out = prepare.rebalance(rows)
    assert {r.family: r["count"] for r in out.groupBy("family").count().collect()} == {"a": 10, "b": 6}
    assert sorted((r.idx, r.repeat_index) for r in out.where("family = 'b'").collect()) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]


def test_payload_texts(spark):
    t = dict(zip(validate.FIELDS, OFFER, strict=True))
    body = json.dumps({"triples": [t]})
    texts = [body, f"```json\n{body}\n```", f"Here it is: {body} as asked", body[:-2], "nothing", json.dumps([t]), json.dumps(t)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", S.parse_payload(F.col("x")).alias("p"))
    rows = df.select("n", "p.recovered", "p.used_fallback", F.size(S.payload_triples(F.col("p.payload"))).alias("k")).orderBy("n").collect()
    assert [r.k for r in rows] == [1, 1, 1, 1, 0, 1, 1]
    assert [r.recovered for r in rows][:4] == [False, True, True, True] and rows[4].used_fallback
    found = S.first_object(spark.createDataFrame([('a {b {"x": {"y": 1}} c',), (None,)], "x string"), "x", "o").collect()
    assert [r.o for r in found] == ['{"x":{"y":1}}', None]


def test_files(spark, tmp_path):
    t = dict(zip(validate.FIELDS, OFFER, strict=True))
    gold = tmp_path / "big-acme.jsonl"
    gold.write_text(json.dumps(t) + "\n\n" + json.dumps({**t, "object": " “Suite” "}) + "\n")
    rows = S.read_gold(spark, str(gold)).collect()
    assert {r.object for r in rows} == {"Platform", "Suite"} and rows[0].company == "Big Acme"
    bad = tmp_path / "bad.jsonl"
    bad.write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        S.read_gold(spark, str(bad)).collect()
    run = tmp_path / "out" / "acme" / "analyst" / "latest"
    run.mkdir(parents=True)
    (run / "resolved_triples.json").write_text(json.dumps({"triples": [t]}))
    (tmp_path / "out" / "acme" / "analyst" / "runs" / "20260101T000000Z").mkdir(parents=True)
    (tmp_path / "out" / "acme" / "analyst" / "runs" / "20260101T000000Z" / "run_summary.json").write_text("{}")
    files = S.run_files(spark, str(tmp_path / "out"))
    state = S.company_states(files).first()
    assert state.latest_available and state.available_run_tokens == ["20260101T000000Z"]
    assert S.load_runs(spark, files).count() == 1
    assert S.read_predictions(spark, str(run / "resolved_triples.json")).count() == 1
    assert list(S.render(spark.createDataFrame([("a", 1)], "x string, n long"))) == ["x\tn", "a\t1"]
    with pytest.raises(ValueError):
        S.resolve_run("/data/out", "../x")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = dict(zip(validate.FIELDS, OFFER, strict=True))
    (tmp_path / "in" / "a.json").write_text(json.dumps({"company_name": "Acme", "idx": 1, **t}) + "\n")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.subject == "Cloud" and row.issues == []
