import pytest

from orrery.operators import graph as G
from orrery.operators.places import Places
from orrery.plans import Refusal, compile_plan, execute
from orrery.operators.prepare import evaluate_plan, same_rows

T = [
    ("Acme", "Company", "HAS_SEGMENT", "Cloud", "BusinessSegment"),
    ("Acme", "Company", "HAS_SEGMENT", "Devices", "BusinessSegment"),
    ("Cloud", "BusinessSegment", "OFFERS", "Platform", "Offering"),
    ("Platform", "Offering", "OFFERS", "Database", "Offering"),
    ("Database", "Offering", "OFFERS", "Backup", "Offering"),
    ("Backup", "Offering", "OFFERS", "Platform", "Offering"),
    ("Backup", "Offering", "MONETIZES_VIA", "subscription", "RevenueModel"),
    ("Devices", "BusinessSegment", "OFFERS", "Phone", "Offering"),
    ("Phone", "Offering", "MONETIZES_VIA", "hardware sales", "RevenueModel"),
    ("Cloud", "BusinessSegment", "SERVES", "developers", "CustomerType"),
    ("Devices", "BusinessSegment", "SERVES", "consumers", "CustomerType"),
    ("Devices", "BusinessSegment", "SELLS_THROUGH", "retail", "Channel"),
    ("Acme", "Company", "OPERATES_IN", "Europe", "Place"),
    ("Acme", "Company", "PARTNERS_WITH", "Globex", "Company"),
    ("Acme", "Company", "KNOWS", "Globex", "Company"),
]


@pytest.fixture(scope="module")
def graph(spark):
    places = Places([("Worldwide", None), ("Europe", "Worldwide"), ("Italy", "Europe")])
    g = G.empty(spark, places).load(spark.createDataFrame(T, G.TRIPLE), "Acme")
    other = [("Globex", "Company", "HAS_SEGMENT", "Cloud", "BusinessSegment"), ("Cloud", "BusinessSegment", "SERVES", "developers", "CustomerType"), ("Globex", "Company", "OPERATES_IN", "Italy", "Place"), ("Globex", "Company", "PARTNERS_WITH", "Acme", "Company")]
    return g.load(spark.createDataFrame(other, G.TRIPLE), "Globex").with_closure()


def rows(graph, family, **payload):
    out = execute({"answerable": True, "family": family, "payload": payload}, graph)
    return out.reason if isinstance(out, Refusal) else [tuple(r) for r in out.collect()]


def test_lookups(graph):
    assert rows(graph, "companies_list") == [("Acme",), ("Globex",)]
    assert rows(graph, "segments_by_company", companies=["Acme "]) == [("Acme", "Cloud"), ("Acme", "Devices")]
    assert rows(graph, "offerings_by_company", companies=["Acme"]) == [("Acme", "Phone"), ("Acme", "Platform")]
    assert rows(graph, "companies_by_segment_filters", customer_types=["developers"], limit=1) == [("Acme",)]
    assert rows(graph, "segments_by_segment_filters", revenue_models=["subscriptions"]) == [("Acme", "Cloud")]
    assert rows(graph, "segments_by_segment_filters", revenue_models=["subscription"], hierarchy_mode="direct") == []
    assert rows(graph, "companies_by_segment_filters", customer_types=["developers"], channels=["retail"]) == []
    assert rows(graph, "companies_by_cross_segment_filters", customer_types=["developers"], channels=["retail"]) == [("Acme",)]
    assert rows(graph, "descendant_offerings_by_root", offerings=["Platform"]) == [("Acme", "Backup"), ("Acme", "Database"), ("Acme", "Platform")]
    assert rows(graph, "companies_by_descendant_revenue", offerings=["Platform"], revenue_models=["subscription"]) == [("Acme",)]
    assert rows(graph, "companies_by_place", places=["Italy"]) == [("Acme",), ("Globex",)]
    assert rows(graph, "companies_by_place", places=["Europe"]) == [("Acme",), ("Globex",)]
    assert rows(graph, "segments_by_place_and_segment_filters", places=["Italy"], customer_types=["developers"]) == [("Acme", "Cloud"), ("Globex", "Cloud")]
    assert rows(graph, "companies_by_partner", partners=["Globex"]) == [("Acme",)]


def test_wrappers(graph):
    assert rows(graph, "boolean_exists", base_family="companies_by_place", places=["Italy"]) == [(True,)]
    assert rows(graph, "boolean_exists", base_family="segments_by_company", companies=["Nobody"]) == [(False,)]
    count = {"kind": "count", "base_family": "segments_by_segment_filters", "count_target": "segment"}
    assert rows(graph, "count_aggregate", aggregate_spec=count, customer_types=["developers"]) == [(2,)]
    top = {"kind": "ranking", "ranking_metric": "customer_type_by_company_count"}
    assert rows(graph, "ranking_topk", aggregate_spec=top) == [("developers", 2), ("consumers", 1)]
    assert rows(graph, "ranking_topk", aggregate_spec=top, limit=1) == [("developers", 2)]


@pytest.mark.parametrize(
    ("family", "payload", "reason"),
    [
        ("companies_by_segment_filters", {"customer_types": ["wizards"]}, "ambiguous_closed_label"),
        ("segments_by_company", {}, "ambiguous_request"),
        ("segments_by_company", {"companies": ["x"], "places": ["y"]}, "beyond_local_coverage"),
        ("companies_list", {"limit": 0}, "ambiguous_request"),
        ("companies_by_cross_segment_filters", {"channels": ["retail"]}, "ambiguous_request"),
        ("companies_by_segment_filters", {"channels": ["retail"], "binding_scope": "across_segments"}, "ambiguous_request"),
        ("count_aggregate", {"aggregate_spec": {"kind": "count", "base_family": "companies_list", "count_target": "segment"}}, "beyond_local_coverage"),
        ("boolean_exists", {"base_family": "companies_by_descendant_revenue", "offerings": ["a"], "revenue_models": ["subscription"]}, "beyond_local_coverage"),
        ("boolean_exists", {"base_family": "descendant_offerings_by_root", "offerings": ["a"], "hierarchy_mode": "direct"}, "beyond_local_coverage"),
        ("boolean_exists", {}, "beyond_local_coverage"),
        ("ranking_topk", {"aggregate_spec": {"kind": "ranking", "ranking_metric": "x"}}, "beyond_local_coverage"),
        ("ranking_topk", {"aggregate_spec": {"kind": "ranking", "limit": 0, "ranking_metric": "channel_by_segment_count"}}, "ambiguous_request"),
    ],
)
def test_refusals(family, payload, reason):
    with pytest.raises(Refusal) as no:
        compile_plan({"answerable": True, "family": family, "payload": payload})
    assert no.value.reason == reason


def test_plans_that_are_none():
    for envelope in ({"answerable": False}, {"answerable": True, "family": "x"}, {"answerable": True, "family": "companies_list", "payload": {"limit": "3"}}):
        with pytest.raises(ValueError):
            compile_plan(envelope)


def test_other_plan_same_rows(graph):
    plan = lambda **p: {"answerable": True, "family": "companies_by_partner", "payload": p}
    flags = evaluate_plan(plan(partners=["Globex"], companies=["Acme"]), plan(partners=["Globex"]), graph)
    assert flags == {"parsed": True, "contract": True, "family": True, "exact_plan": False, "correct_output": True}
    assert not same_rows(graph.companies, graph.companies.limit(1))


def test_graph_changes(graph, spark, tmp_path):
    assert [r.company for r in graph.loaded_companies().collect()] == ["Acme", "Globex"]
    after, counts = graph.unload("Acme")
    left = {tuple(r) for r in after.nodes.collect()}
    # the partnership of the other company keeps the node; its labels stay, the rest is pruned
    assert ("Company", "Acme", "") in left and ("CustomerType", "developers", "") in left
    assert ("Channel", "retail", "") not in left and ("Place", "Europe", "") not in left
    assert counts["scoped_nodes"] == 6 and counts["orphan_nodes"] == 5 and counts["company_nodes"] == 0
    again, _ = graph.replace_company(spark.createDataFrame(T[:3], G.TRIPLE), "Acme")
    assert again.has_segment.where("company = 'Acme'").count() == 2
    graph.write(str(tmp_path / "g"))
    back = G.read(spark, str(tmp_path / "g"), graph.places)
    assert same_rows(back.edges, graph.edges)
    assert back.counts().first().relationships == graph.edges.count()
