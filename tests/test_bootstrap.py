"""The bootstrap draws companies with replacement."""

import pytest

from orrery import queries
from orrery.operators import evaluate

SF = "/root/testdata/sf0.001"


def test_draws_repeat_some_companies_and_miss_others(spark):
    picked = {}
    for r in evaluate.hashed_draws(spark, 10, 50).collect():
        picked.setdefault(r.sample, []).append(r.position)
    assert len(picked) == 50 and all(len(p) == 10 and set(p) <= set(range(10)) for p in picked.values())
    assert sum(len(set(p)) < 10 for p in picked.values()) > 45 and len({tuple(sorted(p)) for p in picked.values()}) > 45
    assert evaluate.hashed_draws(spark, 0, 50).count() == 0


def test_interval_has_width_and_agrees_with_its_sql(spark):
    got = queries.QUERIES["bootstrap_ci_resampled"](spark, SF).first()
    assert got.precision_low < got.precision_mean < got.precision_high and got.f1_low < got.f1_mean < got.f1_high
    old = queries.QUERIES["bootstrap_ci"](spark, SF).first()
    print("before", old.asDict(), "after", got.asDict())
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "part", "orders", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(queries.SQL["bootstrap_ci_resampled"]).fetchone()
    assert want == pytest.approx(tuple(got), abs=2e-9)


def test_more_companies_than_an_int_product_holds(spark, tmp_path):
    """slots times 104,729 pass 2^31 from 20,505 companies on."""
    def put(name, df):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    n = 20_600
    put("supplier", spark.range(n).selectExpr("id AS s_suppkey", "concat('Supplier#', lpad(id, 9, '0')) AS s_name", "0 AS s_nationkey"))
    put("lineitem", spark.range(n).selectExpr("id AS l_orderkey", "id % 7 AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "50D AS l_quantity", "'A' AS l_returnflag", "'F' AS l_linestatus"))
    put("part", spark.range(7).selectExpr("id AS p_partkey", "concat('Type ', id % 3) AS p_type", "concat('Brand#', id % 5) AS p_brand", "'name' AS p_name"))
    put("orders", spark.range(n).selectExpr("id AS o_orderkey", "id % 3 AS o_custkey", "'5-LOW' AS o_orderpriority"))
    put("customer", spark.range(3).selectExpr("id AS c_custkey", "concat('SEGMENT', id) AS c_mktsegment"))
    put("nation", spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey"))
    put("region", spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name"))
    got = queries.QUERIES["bootstrap_ci"](spark, str(tmp_path)).first()
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "part", "orders", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert con.execute(queries.SQL["bootstrap_ci"]).fetchone() == pytest.approx(tuple(got), abs=2e-9)


def test_draws_are_not_sent_to_the_driver(spark):
    """six million draws looked like 200 rows, and were broadcast."""
    rows = spark.range(30_000).selectExpr("concat('c', id) AS company", "id AS true_positives", "1L AS false_positives", "2L AS false_negatives", "0.5D AS f1")
    out = evaluate.resampled(rows, [], evaluate.hashed_draws(spark, 30_000, 200))
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 200


def test_bootstrap_ci_draws_with_replacement(spark):
    """every sample held every company once, so the interval had no width."""
    got = queries.QUERIES["bootstrap_ci"](spark, SF).first()
    assert got.precision_low < got.precision_mean < got.precision_high and got.f1_low < got.f1_mean < got.f1_high
