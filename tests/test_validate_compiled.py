"""The rules of triples run in compiled code, and say the same of odd triples."""

import pytest

from orrery import queries
from orrery.operators import validate

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name",
    [
        "validate_issue_histogram",  # F7
        "validate_first_parent",  # F8
    ],
)
def test_rules_have_no_lambdas(spark, name):
    """Spark interprets lambdas and whatever they are applied to, row by row."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def test_issues_of_odd_triples(spark):
    """In the order of the rules, each by itself, with null and spaced fields."""
    triples = [
        (None, "Company", "OFFERS", " x ", "Offering", ["empty_subject"], "invalid"),
        ("", " Firm ", None, None, "", ["empty_subject", "empty_object", "invalid_subject_type", "invalid_object_type", "invalid_relation"], "invalid"),
        ("a", "\tCompany\n", " OFFERS ", "b", "Offering ", [], "valid"),
        ("A", "Company", "OFFERS", "B", "Offering", [], "duplicate"),
        ("a", "Company", "SERVES", "consumers", "CustomerType", ["invalid_relation_schema"], "invalid"),
        ("me", "CustomerType", "SERVES", "you", "Channel", ["invalid_relation_schema", "non_canonical_label", "non_canonical_label"], "invalid"),
        ("p", "Offering", "OFFERS", "c", "Offering", [], "valid"),
        ("q", "Offering", "OFFERS", "C", "Offering", ["multiple_offering_parents"], "invalid"),
        ("c", "Offering", "MONETIZES_VIA", "subscription", "RevenueModel", ["child_offering_monetizes_via"], "invalid"),
    ]
    rows = spark.createDataFrame([(n, *t[:5]) for n, t in enumerate(triples)], f"idx int, {', '.join(f + ' string' for f in validate.FIELDS)}")
    checked = validate.validate_batch(rows, []).orderBy("idx").collect()
    assert [([i.code for i in r.issues], r.status) for r in checked] == [t[5:] for t in triples]
    assert [i.message for i in checked[5].issues][1:] == ["not an approved label: me", "not an approved label: you"]
    counts = {r.code: r.triples for r in validate.issue_histogram(validate.validate_batch(rows, []), []).collect()}
    assert counts["non_canonical_label"] == 1 and counts["empty_subject"] == 2
