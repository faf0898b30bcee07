"""A graph of triples from the star-schema tables: suppliers as companies, part types as segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.graph import Graph, build_edges
from orrery.operators.places import Places

LABELS = {
    "CustomerType": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    "Channel": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    "RevenueModel": ("AF", "AO", "NF", "NO", "RF", "RO"),
}
#: Line items that make a company's graph.
QUANTITY = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company_name, subject, subject_type, relation, object, object_type``, repeated as found."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col
    # joined by sorting: their files look small enough to broadcast when their rows no longer are
    wide = lambda name: t(name).hint("merge")
    line, supplier = t("lineitem"), t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    made = (
        line.where(c("l_quantity") >= QUANTITY)
        .join(supplier, c("l_suppkey") == c("s_suppkey"))
        .join(wide("part").select("p_partkey", "p_type", "p_brand", "p_name"), c("l_partkey") == c("p_partkey"))
    )
    sold = made.join(wide("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), c("l_orderkey") == c("o_orderkey"))
    served = sold.join(wide("customer").select("c_custkey", "c_mktsegment"), c("o_custkey") == c("c_custkey"))
    child = F.concat_ws(" ", "p_brand", "p_name")
    leaf = F.concat(child, F.lit(" #"), c("p_partkey").cast("string"))

    def rows(facts: DataFrame, subject: Column, subject_type: str, relation: str, object_: Column, object_type: str) -> DataFrame:
        return facts.select(
            c("s_name").alias("company_name"),
            subject.alias("subject"),
            F.lit(subject_type).alias("subject_type"),
            F.lit(relation).alias("relation"),
            object_.alias("object"),
            F.lit(object_type).alias("object_type"),
        )

    # one branch a relation: a filter on the relation leaves that branch alone, and its joins
    nation = t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey"))
    place = F.when(c("s_suppkey") % 13 == 0, F.lit("WORLD")).when(c("s_suppkey") % 7 == 0, c("r_name")).otherwise(c("n_name"))
    first = line.where("l_linenumber = 1").select("l_orderkey", c("l_suppkey").alias("a"))
    second = line.where("l_linenumber = 2").select("l_orderkey", c("l_suppkey").alias("b"))
    names = supplier.select("s_suppkey", "s_name")
    together = first.join(second, "l_orderkey").where("a <> b").select("a", "b").distinct()
    branches = [
        rows(made, c("s_name"), "Company", "HAS_SEGMENT", c("p_type"), "BusinessSegment"),
        rows(made, c("p_type"), "BusinessSegment", "OFFERS", c("p_brand"), "Offering"),
        rows(made, c("p_brand"), "Offering", "OFFERS", child, "Offering"),
        rows(made, child, "Offering", "OFFERS", leaf, "Offering"),
        rows(served, c("p_type"), "BusinessSegment", "SERVES", c("c_mktsegment"), "CustomerType"),
        rows(sold, c("p_type"), "BusinessSegment", "SELLS_THROUGH", c("o_orderpriority"), "Channel"),
        rows(made, c("p_brand"), "Offering", "MONETIZES_VIA", F.concat("l_returnflag", "l_linestatus"), "RevenueModel"),
        rows(supplier.join(F.broadcast(nation), c("s_nationkey") == c("n_nationkey")), c("s_name"), "Company", "OPERATES_IN", place, "Place"),
        rows(together.join(names.toDF("a", "s_name"), "a").join(names.toDF("b", "partner"), "b"), c("s_name"), "Company", "PARTNERS_WITH", c("partner"), "Company"),
    ]
    return reduce(DataFrame.unionByName, branches)


def places(spark: SparkSession, sf_dir: str) -> Places:
    """Nations within regions within the world; 25 names and 6."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
    return Places([("WORLD", None), *sorted({(r["r_name"], "WORLD") for r in rows}), *sorted((r["n_name"], r["r_name"]) for r in rows)])


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = triples(spark, sf_dir)
    # every supplier operates somewhere, so these are the loaded companies
    loaded = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("company")).distinct()
    here = places(spark, sf_dir)
    return Graph(build_edges(t), loaded, here, here.dimension(spark), labels=LABELS)
