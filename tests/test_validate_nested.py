"""Parents of offerings are found among the triples that name parents, with the outcome of all triples."""

from orrery import queries
from orrery.operators import validate

SF = "/root/testdata/sf0.001"


def test_triples_without_parents_are_left_before_the_joins(spark):
    """F8: they were joined, cleaned, shuffled and sorted before they were left out."""
    plan = queries.QUERIES["validate_first_parent"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :].splitlines()
    assert any("Filter" in line and "l_orderkey" in line and "% 8" in line for line in below)


def test_other_triples_do_not_bear_on_parents(spark):
    """F8: issues and status of each are those among all triples, with odd fields and in every batch."""
    triples = [
        ("seg", "BusinessSegment", "OFFERS", "c", "Offering"),
        ("c", "Offering", "MONETIZES_VIA", "subscription", "RevenueModel"),
        ("\"P\" ", " Offering", "\tOFFERS ", " c", "Offering "),
        ("p", "Offering", "OFFERS", "C", "Offering"),
        ("q", "Offering", "OFFERS", "c", "Offering"),
        ("q", "Offering", "OFFERS", "c", "Offering"),
        ("q", "Company", "OFFERS", "d", "Offering"),
        ("q", "Offering", "OFFERS", "d", "Offering"),
        ("r", "Offering", "OFFERS", "d", "Channel"),
        ("r", "Offering", "OFFERS", None, None),
        (None, "Offering", "OFFERS", "e", "Offering"),
        ("ﬁrst", "Offering", "OFFERS", "Straße", "Offering"),
        ("FIRST", "Offering", "OFFERS", "STRASSE", "Offering"),
        ("other", "Offering", "OFFERS", "strasse", "Offering"),
        ("x y", "Offering", "SELLS_THROUGH", "online", "Channel"),
        ("x", "Company", "PARTNERS_WITH", "c", "Company"),
        ("x", None, "OFFERS", "y", "Offering"),
        ("x", "Offering", None, "y", "Offering"),
    ]
    data = [(batch, step * n, *t) for batch, step in (("one", 1), ("two", -1)) for n, t in enumerate(triples)]
    rows = spark.createDataFrame(data, f"batch string, idx int, {', '.join(f + ' string' for f in validate.FIELDS)}")
    of_all = validate.validate_batch(rows, ["batch"]).where("relation = 'OFFERS' and subject_type = 'Offering'")
    alone = validate.validate_batch(validate.nested_offers(rows), ["batch"])
    found = sorted(alone.collect(), key=lambda r: (r.batch, r.idx))
    assert found == sorted(of_all.collect(), key=lambda r: (r.batch, r.idx))
    assert [r.status for r in found if r.batch == "one"] == ["valid", "duplicate", "invalid", "invalid", "valid", "invalid", "invalid", "invalid", "valid", "duplicate", "invalid"]
