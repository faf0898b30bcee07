from orrery.operators import evaluate, validate

NAMES = "company string, subject string, subject_type string, relation string, object string, object_type string"


def test_last_good_keeps_what_a_second_pass_lost(spark):
    row = lambda c, s: (c, s, "Company", "OPERATES_IN", "Peru", "Place")
    before = spark.createDataFrame([row("a", "old"), row("b", "kept"), row("b", "alive")], NAMES)
    after = spark.createDataFrame([row("a", "new")], NAMES)
    got = validate.sort_triples(validate.last_good(before, after, ["company"]))
    assert [r.subject for r in got.collect()] == ["alive", "kept", "new"]
    assert validate.last_good(before, after.limit(0), ["company"]).count() == 3


def test_scopes_leave_one_company_out(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "company string, true_positives long")
    assert sorted((r.scope, r.company) for r in evaluate.scopes(rows, "b").collect()) == [("all", "a"), ("all", "b"), ("without", "a")]


def test_reliability_has_every_relation_and_all(spark):
    edges = spark.createDataFrame([("r", "x", 1), ("r", "y", 1), ("q", "x", 1), ("q", "y", 2)], "relation string, annotator string, edge long")
    got = {r.relation: r.average_pairwise_jaccard for r in evaluate.reliability(edges).collect()}
    assert got == {"r": 1.0, "q": 0.0, "all": 1 / 3}
