import json

import pytest
from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import graph as graphs
from orrery.operators import prepare
from orrery.plans import Refusal, local
from orrery.sources import triples as sources

SCHEMA = f"company_name string, {graphs.TRIPLE}"
ACME = [("Acme", "Acme", "Company", "HAS_SEGMENT", "Cloud", "BusinessSegment"), ("Acme", "Cloud", "BusinessSegment", "OFFERS", "Platform", "Offering"), ("Acme", "Cloud", "BusinessSegment", "OFFERS", "Platform", "Offering"), ("Acme", "Cloud", "Planet", "OFFERS", "Mars", "Offering")]
GLOBEX = [("Globex", "Globex", "Company", "HAS_SEGMENT", "Home", "BusinessSegment"), ("Globex", "Home", "BusinessSegment", "OFFERS", "Platform", "Offering")]


def _graph(spark):
    return graphs.empty(spark).load(spark.createDataFrame(ACME, SCHEMA), "Acme")


def test_each_company_fails_alone(spark):
    bad = spark.createDataFrame(GLOBEX, SCHEMA).withColumn("object", F.raise_error(F.lit("torn file")).cast("string"))
    targets = {"Initech": lambda: bad, "Globex": lambda: spark.createDataFrame(GLOBEX, SCHEMA), "Hooli": lambda: spark.read.json("/no/such/file")}
    g, report = _graph(spark).load_each(targets)
    got = {r["company"]: r for r in report.collect()}
    assert got["Globex"]["loaded_rows"] == 2 and got["Globex"]["error"] is None
    assert "torn file" in got["Initech"]["error"] and "no/such" in got["Hooli"]["error"]
    assert sorted(r["company"] for r in g.loaded.collect()) == ["Acme", "Globex"]
    assert [(r["name"], r["companies"]) for r in g.collisions().collect()] == [("Platform", 2)]
    assert [r["company"] for r in g.owners(names=["Platform"]).collect()] == ["Acme", "Globex"]


def test_loaded_rows_counts_repeats(spark):
    assert [tuple(r) for r in graphs.loaded_rows(spark.createDataFrame(ACME, SCHEMA)).collect()] == [("Acme", 3)]
    assert graphs.unload_total({"scoped_nodes": 2, "orphan_nodes": 1}) == 3


def test_a_graph_written_over_itself(spark, tmp_path):
    path = f"{tmp_path}/graph"
    _graph(spark).write(path)
    graphs.read(spark, path).load(spark.createDataFrame(GLOBEX, SCHEMA), "Globex").write(path)
    assert graphs.read(spark, path).edges.count() == 4
    torn = graphs.read(spark, path)
    torn = graphs.Graph(torn.edges, torn.loaded.withColumn("company", F.raise_error(F.lit("torn")).cast("string")))
    with pytest.raises(Exception, match="torn"):
        torn.write(path)
    assert graphs.read(spark, path).edges.count() == 4 and graphs.read(spark, path).loaded.count() == 2
    graphs.clear(spark, path)
    assert not (tmp_path / "graph").exists()


@pytest.mark.parametrize("content", [None, "{", "[1]"])
def test_thresholds_that_are_no_good(content):
    with pytest.raises(local.StackError):
        local.read_thresholds(content)


def test_local_answers(spark):
    g, open_ = _graph(spark), local.read_thresholds('{"planner_gate_open": true}')
    sure = {"local": 0.98, "refuse": 0.01, "api_fallback": 0.01}
    plan = {"family": "segments_by_company", "payload": {"companies": ["Acme"]}}
    out = local.answer("Which?", sure, open_, lambda q: f"Sure {{so}} {json.dumps(plan)}", g)
    assert out["decision"] == "local" and [r["segment"] for r in local.result(out, "").collect()] == ["Cloud"]
    for thresholds, generated in (({}, json.dumps(plan)), (open_, "no plan"), (open_, "{}"), (open_, '{"family": "segments_by_company", "payload": {}}')):
        out = local.answer("Which?", sure, thresholds, lambda q, t=generated: t, g)
        assert out["decision"] == "api_fallback" and out["error"] and local.result(out, "") is None
    even = {"local": 0.2, "refuse": 0.4, "api_fallback": 0.4}
    refused = local.result(local.answer("Drop it", even, open_, lambda q: "", g), "write_request")
    assert isinstance(refused, Refusal) and refused.reason == "write_request"


def test_run_choice_and_gold(spark):
    paths = [f"/o/{c}/analyst/{r}/resolved_triples.json" for c, r in (("acme", "latest"), ("acme", "runs/t1"), ("globex", "latest"), ("globex", "failed/t2"))]
    files = sources.run_parts(spark.createDataFrame([(p,) for p in [*paths, "/o/notes.json"]], "path string"))
    count = lambda *a: sources.load_targets(files, "analyst", *a).count()
    assert (files.count(), count(), count("acme"), count("acme", "t1"), count("globex", "failed/t2"), count("acme", "t2")) == (4, 2, 1, 1, 1, 0)
    with pytest.raises(ValueError):
        count(None, "t1")
    golds = spark.createDataFrame([("acme", "a", "dev"), ("globex", "b", "dev"), ("globex", "c", "test")], "slug string, path string, split string")
    assert sources.find_gold(golds, "acme") == ("a", "dev")
    with pytest.raises(ValueError):
        sources.find_gold(golds, "globex")
    with pytest.raises(FileNotFoundError):
        sources.find_gold(golds, "hooli")


def test_row_graphs(spark):
    rows = spark.createDataFrame([(1, ["g2", "g1"]), (2, []), (3, None), (4, ["g1", "x", "y"])], "row_id long, source_graph_ids array<string>")
    known = spark.createDataFrame([("g1", "a"), ("g2", "b")], "graph_id string, graph string")
    found = prepare.row_graphs(rows, known).where("row_id = 1").orderBy("place")
    assert [(r["graph_id"], r["graph"]) for r in found.collect()] == [("g2", "b"), ("g1", "a")]
    errors = {r["row_id"]: r["error"] for r in prepare.graph_errors(rows, known).collect()}
    assert errors == {2: "no source graphs", 3: "no source graphs", 4: "unknown graphs: x, y"}


def test_names_that_are_all_suffix(spark):
    pairs = [("Acme, Inc.", "ACME"), ("Inc", "Corp"), ("Incorporated Holdings", "Incorporated"), ("Acmeworks", "Acme"), ("Globex", "Globexia"), (None, "Acme"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select(text.companies_compatible(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in df.collect()][0] is True and [bool(r["x"]) for r in df.collect()][3:] == [False, True, False, False]
