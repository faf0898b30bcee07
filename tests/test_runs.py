import json

import pytest
from pyspark.sql import functions as F

from orrery.sources import runs

GRAPH = {
    "name": "Acme",
    "places": ["Italy"],
    "partners": ["Globex"],
    "segments": [{"name": "Cloud", "customer_types": ["developers"], "channels": ["online"], "offerings": [{"name": "Platform", "revenue_models": ["subscription"], "children": [{"name": "Database", "revenue_models": [], "children": [{"name": "Backup"}]}]}]}],
}


def test_flatten(spark):
    rows = [("g1", json.dumps(GRAPH)), ("g2", json.dumps({"companies": [GRAPH, {"name": "Globex", "segments": []}]}))]
    graphs = spark.createDataFrame(rows, "graph_id string, j string").select("graph_id", F.parse_json("j").alias("graph"))
    out = runs.flatten_graphs(graphs)
    got = {(r.subject, r.relation, r.object) for r in out.where("graph_id = 'g1'").collect()}
    assert got == {
        ("Acme", "OPERATES_IN", "Italy"),
        ("Acme", "PARTNERS_WITH", "Globex"),
        ("Acme", "HAS_SEGMENT", "Cloud"),
        ("Cloud", "SERVES", "developers"),
        ("Cloud", "SELLS_THROUGH", "online"),
        ("Cloud", "OFFERS", "Platform"),
        ("Platform", "MONETIZES_VIA", "subscription"),
        ("Platform", "OFFERS", "Database"),
        ("Database", "OFFERS", "Backup"),
    }
    assert out.where("graph_id = 'g2'").count() == 9


def test_swap_and_finish(spark, tmp_path):
    where = f"file://{tmp_path}/result"
    runs.swap_in(spark, where, lambda p: spark.range(3).write.parquet(p))
    runs.swap_in(spark, where, lambda p: spark.range(5).write.parquet(p))
    assert spark.read.parquet(where).count() == 5

    def fails(path):
        spark.range(9).write.parquet(path)
        raise RuntimeError("late")

    with pytest.raises(RuntimeError):
        runs.swap_in(spark, where, fails)
    assert spark.read.parquet(where).count() == 5 and len(list(tmp_path.iterdir())) == 1
    spark.range(1).write.parquet(f"file://{tmp_path}/staged")
    got = runs.finish_run(spark, f"file://{tmp_path}/staged", f"file://{tmp_path}/acme", "t1", succeeded=False)
    assert got.endswith("failed/t1") and runs.exists(spark, got)


def test_splits_and_small_helpers(spark, tmp_path):
    for n, name in enumerate(("train", "validation", "release_eval")):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"question": f"q{i}"}) for i in range(n + 1)))
    rows = runs.read_splits(spark, str(tmp_path), "question string")
    assert {r.split: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 1, "valid": 2, "test": 3}
    df = spark.createDataFrame([(" Acme ", "x_10k", "s"), ("", "big_acme_10k", "s"), (None, "", "acme_inc")], "a string, b string, c string")
    assert [r[0] for r in df.select(runs.company_name(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["Acme", "Big Acme", "Acme Inc"]
    texts = spark.createDataFrame([("",), ("a",), ("a\nb\n",), ("a\r\n\r\nb",)], "t string")
    assert [tuple(r) for r in texts.select(*runs.text_stats(F.col("t"))).collect()] == [(0, 0), (1, 1), (4, 2), (6, 3)]
    j = spark.createDataFrame([('{"b": 1, "a": [1, 2]}',), ("no",)], "j string")
    assert [r[0] for r in j.select(runs.compact_json(F.col("j"))).collect()] == ['{"a":[1,2],"b":1}', None]
