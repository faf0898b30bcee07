"""Property graphs as tables of nodes and edges: load, unload, replace, count.

Segments and offerings are nodes of one company (``scope``); all other nodes are global. Edges
are distinct. Every operation is set algebra on the two tables; a graph is written with its edges
partitioned by relation, so that a query reads the relations that it walks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import storage
from orrery.functions.vocabulary import NODE_TYPES, RELATIONS, SCOPED_TYPES
from orrery.operators.places import Places

TRIPLE = "subject string, subject_type string, relation string, object string, object_type string"
EDGE = ["rel", "src_label", "src_name", "src_scope", "dst_label", "dst_name", "dst_scope"]
NODE = ["label", "name", "scope"]
#: relations that a company owns as their subject
OWNED = ("HAS_SEGMENT", "OFFERS", "OPERATES_IN", "PARTNERS_WITH")
#: global nodes that are removed when nothing is left around them
PRUNED = ("CustomerType", "Channel", "Place", "RevenueModel", "Company")


def _scope(label: Column, company: Column) -> Column:
    return F.when(label.isin(*SCOPED_TYPES), company).otherwise(F.lit(""))


@dataclass(frozen=True)
class Graph:
    """``edges``: EDGE columns, distinct. ``loaded(company)``: companies that were loaded."""

    edges: DataFrame
    loaded: DataFrame
    places: Places | None = None
    dimension: DataFrame | None = None
    closure: DataFrame | None = None
    #: label type -> labels, where they are not the ontology's
    labels: dict | None = None

    # ------------------------------------------------ relations with their scope checks

    def _rel(self, rel: str, src: str) -> DataFrame:
        return self.edges.where((F.col("rel") == rel) & (F.col("src_label") == src))

    @property
    def nodes(self) -> DataFrame:
        ends = [self.edges.select(*[F.col(f"{side}_{c}").alias(c) for c in NODE]) for side in ("src", "dst")]
        own = self.loaded.select(F.lit("Company").alias("label"), F.col("company").alias("name"), F.lit("").alias("scope"))
        return reduce(DataFrame.unionByName, [*ends, own]).distinct()

    @property
    def companies(self) -> DataFrame:
        return self.nodes.where("label = 'Company'").select(F.col("name").alias("company"))

    @property
    def has_segment(self) -> DataFrame:
        """``company, segment``, the segment being of that company's own load."""
        return self._rel("HAS_SEGMENT", "Company").where("src_name = dst_scope").select(F.col("src_name").alias("company"), F.col("dst_name").alias("segment"))

    def _of_segment(self, rel: str, out: str) -> DataFrame:
        e = self._rel(rel, "BusinessSegment")
        e = e.where("src_scope = dst_scope") if rel == "OFFERS" else e
        return e.select(F.col("src_scope").alias("company"), F.col("src_name").alias("segment"), F.col("dst_name").alias(out))

    @property
    def serves(self) -> DataFrame:
        return self._of_segment("SERVES", "customer_type")

    @property
    def sells(self) -> DataFrame:
        return self._of_segment("SELLS_THROUGH", "channel")

    @property
    def roots(self) -> DataFrame:
        return self._of_segment("OFFERS", "offering")

    @property
    def monetizes(self) -> DataFrame:
        return self._rel("MONETIZES_VIA", "Offering").select(F.col("src_scope").alias("company"), F.col("src_name").alias("offering"), F.col("dst_name").alias("revenue_model"))

    @property
    def child_offerings(self) -> DataFrame:
        return self._rel("OFFERS", "Offering").where("src_scope = dst_scope").select(F.col("src_scope").alias("company"), F.col("src_name").alias("parent"), F.col("dst_name").alias("child"))

    @property
    def operates(self) -> DataFrame:
        return self._rel("OPERATES_IN", "Company").select(F.col("src_name").alias("company"), F.col("dst_name").alias("place"))

    @property
    def partners(self) -> DataFrame:
        return self._rel("PARTNERS_WITH", "Company").select(F.col("src_name").alias("company"), F.col("dst_name").alias("partner"))

    def with_closure(self) -> Graph:
        return self if self.closure is not None else replace(self, closure=offering_closure(self.child_offerings))

    def below(self, asked: DataFrame) -> DataFrame:
        """``company, root, offering``: the offerings ``asked(company, root)`` and all below them."""
        if self.closure is not None:
            return self.closure.join(asked, ["company", "root"], "left_semi").select("company", "root", F.col("descendant").alias("offering")).unionByName(asked.select("company", "root", F.col("root").alias("offering"))).distinct()
        return offering_closure(self.child_offerings, asked).select("company", "root", F.col("descendant").alias("offering"))

    def segments_over(self, wanted: DataFrame) -> DataFrame:
        """``company, segment`` that have an offering of ``wanted(company, offering)``, or one above it."""
        if self.closure is not None:
            over = self.closure.join(wanted.withColumnRenamed("offering", "descendant"), ["company", "descendant"], "left_semi").select("company", F.col("root").alias("offering")).unionByName(wanted.select("company", "offering"))
        else:
            up = self.child_offerings.select("company", F.col("child").alias("parent"), F.col("parent").alias("child"))
            over = offering_closure(up, wanted.withColumnRenamed("offering", "root")).select("company", F.col("descendant").alias("offering"))
        return self.roots.join(over, ["company", "offering"], "left_semi").select("company", "segment")

    def segment_closure(self) -> DataFrame:
        """``company, segment, root, offering``: offerings of a segment and all below them."""
        roots = self.roots.withColumnRenamed("offering", "root")
        closure = self.with_closure().closure
        below = roots.join(closure.select("company", "root", F.col("descendant").alias("offering")), ["company", "root"])
        # roots without any offering edge are in no closure row
        alone = roots.join(closure.where("depth = 0").select("company", "root"), ["company", "root"], "left_anti")
        return below.unionByName(alone.withColumn("offering", F.col("root")))

    def owners(self, label: str = "Offering", names: list[str] | None = None) -> DataFrame:
        """``name, company`` of scoped nodes, in order: a name of several companies is ambiguous."""
        rows = self.nodes.where((F.col("label") == label) & (F.col("scope") != ""))
        rows = rows if names is None else rows.where(F.col("name").isin(*names))
        return rows.select("name", F.col("scope").alias("company")).distinct().orderBy("name", "company")

    def collisions(self, label: str = "Offering") -> DataFrame:
        """``name, companies``: names that more than one company has."""
        return self.owners(label).groupBy("name").agg(F.count("*").alias("companies")).where("companies > 1")

    # ------------------------------------------------ counts

    def counts(self) -> DataFrame:
        """``nodes, relationships`` of the whole graph."""
        both = self.nodes.select(F.lit(1).alias("n"), F.lit(0).alias("r")).unionByName(self.edges.select(F.lit(0).alias("n"), F.lit(1).alias("r")))
        return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("r"), F.lit(0)).alias("relationships"))

    def loaded_companies(self) -> DataFrame:
        """Companies that were loaded, own a segment, or scope a node; trimmed, not empty, in order."""
        scoped = self.edges.select(F.explode(F.array("src_scope", "dst_scope")).alias("company"))
        every = self.loaded.select("company").unionByName(self._rel("HAS_SEGMENT", "Company").select(F.col("src_name").alias("company"))).unionByName(scoped)
        return every.select(F.trim("company").alias("company")).where("company <> ''").distinct().orderBy("company")

    def company_counts(self) -> DataFrame:
        """``company, nodes, relationships``: its own node and scoped nodes, and the edges at any of them."""
        e = self.edges
        key = lambda side: F.when(F.col(f"{side}_scope") != "", F.col(f"{side}_scope")).when(F.col(f"{side}_label") == "Company", F.col(f"{side}_name"))
        touching = e.select(F.explode(F.array_distinct(F.array(key("src"), key("dst")))).alias("company")).where("company is not null")
        rels = touching.groupBy("company").agg(F.count("*").alias("relationships"))
        own = self.nodes.where("label = 'Company' or scope <> ''").select(F.when(F.col("scope") != "", F.col("scope")).otherwise(F.col("name")).alias("company"))
        return own.groupBy("company").agg(F.count("*").alias("nodes")).join(rels, "company", "left").na.fill({"relationships": 0})

    # ------------------------------------------------ changes

    def load(self, triples: DataFrame, company: str | None = None) -> Graph:
        """The graph with ``triples`` merged in; ``company`` names the load, else ``company_name`` does."""
        new = build_edges(triples, company)
        names = new.select(F.explode(F.array("src_scope", "dst_scope")).alias("company")).where("company <> ''").distinct() if company is None else _one(triples.sparkSession, company)
        return replace(self, edges=self.edges.unionByName(new).distinct(), loaded=self.loaded.unionByName(names).distinct(), closure=None)

    def unload(self, company: str) -> tuple[Graph, dict[str, int]]:
        """The graph without a company's own nodes and edges, and what went.

        Partnerships that others have with it stay, and then so does its node. Of the global
        nodes next to what goes, those that nothing else touches go too.
        """
        e = self.edges
        mine = lambda side: (F.col(f"{side}_scope") == company) | ((F.col(f"{side}_label") == "Company") & (F.col(f"{side}_name") == company))
        scoped = (F.col("src_scope") == company) | (F.col("dst_scope") == company)
        owned = (F.col("src_label") == "Company") & (F.col("src_name") == company) & F.col("rel").isin(*OWNED)
        gone = scoped | owned
        rest = e.where(~gone)
        near = e.where(mine("src") | mine("dst")).select(F.explode(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in NODE]) for s in ("src", "dst")])).alias("n")).select("n.*")
        near = near.where(F.col("label").isin(*PRUNED) & (F.trim("name") != "") & ~((F.col("label") == "Company") & (F.col("name") == company))).distinct()
        after = replace(self, edges=rest, loaded=self.loaded.where(F.col("company") != company), closure=None)
        orphans = near.join(after.nodes, NODE, "left_anti").count()
        was, left = self.nodes.where((F.col("label") == "Company") & (F.col("name") == company)).count(), after.nodes.where((F.col("label") == "Company") & (F.col("name") == company)).count()
        counts = e.agg(F.count_if(scoped).alias("scoped"), F.count_if(owned & ~scoped).alias("owned")).first()
        return after, {
            "scoped_nodes": self.nodes.where(F.col("scope") == company).count(),
            "scoped_relationships": counts["scoped"],
            "company_relationships": counts["owned"],
            "company_nodes": was - left,
            "orphan_nodes": orphans,
        }

    def replace_company(self, triples: DataFrame, company: str) -> tuple[Graph, dict[str, int]]:
        """Unload and load as one step: nothing is written until both tables are computed."""
        before, counts = self.unload(company)
        return before.load(triples, company), counts

    def load_each(self, targets: Mapping[str, Callable[[], DataFrame]]) -> tuple[Graph, DataFrame]:
        """Every company's triples in place of what it had; a company that fails is left as it was.

        ``targets`` gives each company's triples when called. The report has ``company, loaded_rows,
        error``. Its triples are written in the shared folder first, so that their errors show here.
        """
        spark, graph, report = self.edges.sparkSession, self, []
        for company, read_triples in targets.items():
            try:
                triples = storage.materialize(read_triples(), "target")
                graph, _ = graph.replace_company(triples, company)
                edges = storage.materialize(graph.edges, "edges")
                loaded = storage.materialize(graph.loaded, "loaded")
                graph = replace(graph, edges=edges, loaded=loaded)
                report.append((company, triples.where(of_ontology()).count(), None))
            except Exception as failure:  # whatever a company's files hold, the others are loaded
                report.append((company, 0, str(failure)))
        return graph, spark.createDataFrame(report, "company string, loaded_rows long, error string")

    # ------------------------------------------------ storage

    def write(self, path: str) -> None:
        """Edges partitioned by relation, and the loaded companies, beside each other.

        Both are written aside and put in place together: a failure leaves what was there, and the
        graph may be one that was read from ``path``.
        """
        from orrery.sources.runs import swap_in

        def tables(staged: str) -> None:
            self.edges.repartition("rel", "src_scope").sortWithinPartitions("rel", "src_scope", "src_name").write.partitionBy("rel").parquet(f"{staged}/edges")
            self.loaded.write.parquet(f"{staged}/loaded")

        swap_in(self.edges.sparkSession, path, tables)


def _one(spark: SparkSession, company: str) -> DataFrame:
    return spark.createDataFrame([(company,)], "company string")


def empty(spark: SparkSession, places: Places | None = None) -> Graph:
    edges = spark.createDataFrame([], ", ".join(f"{c} string" for c in EDGE))
    return Graph(edges, spark.createDataFrame([], "company string"), places, places.dimension(spark) if places else None)


def read(spark: SparkSession, path: str, places: Places | None = None) -> Graph:
    return Graph(spark.read.parquet(f"{path}/edges").select(*EDGE), spark.read.parquet(f"{path}/loaded"), places, places.dimension(spark) if places else None)


def of_ontology() -> Column:
    return F.col("subject_type").isin(*NODE_TYPES) & F.col("object_type").isin(*NODE_TYPES) & F.col("relation").isin(*RELATIONS)


def loaded_rows(triples: DataFrame) -> DataFrame:
    """``company, loaded_rows``: triples that a load takes in, repeated ones counted."""
    return triples.groupBy(F.col("company_name").alias("company")).agg(F.count_if(of_ontology()).alias("loaded_rows"))


def unload_total(counts: Mapping[str, int]) -> int:
    """All that an unload took away."""
    return sum(counts.values())


def clear(spark: SparkSession, path: str) -> None:
    """Delete a written graph."""
    storage.delete_path(spark, path)


def build_edges(triples: DataFrame, company: str | None = None) -> DataFrame:
    """Distinct edges of triples whose types and relation the ontology has; others are skipped."""
    owner = F.lit(company) if company is not None else F.col("company_name")
    return (
        triples.where(of_ontology())
        .select(
            F.col("relation").alias("rel"),
            F.col("subject_type").alias("src_label"),
            F.col("subject").alias("src_name"),
            _scope(F.col("subject_type"), owner).alias("src_scope"),
            F.col("object_type").alias("dst_label"),
            F.col("object").alias("dst_name"),
            _scope(F.col("object_type"), owner).alias("dst_scope"),
        )
        .distinct()
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: ``label, name, scope, near_label, near_name, near_scope``."""
    one = lambda a, b: edges.select(*[F.col(f"{a}_{c}").alias(c) for c in NODE], *[F.col(f"{b}_{c}").alias(f"near_{c}") for c in NODE])
    return one("src", "dst").unionByName(one("dst", "src")).distinct()


def offering_closure(children: DataFrame, start: DataFrame | None = None, max_depth: int = 64) -> DataFrame:
    """``company, root, descendant, depth`` of ``children(company, parent, child)``, roots included.

    Closed from ``start(company, root)`` alone, where given, else from every offering of an edge.
    One join a level, of the level before alone; a pair that was reached before is not followed
    again, so cycles end. Edges and levels are written in the shared folder. Deeper nesting than
    ``max_depth`` is an error.
    """
    step = storage.materialize(children.distinct(), "children")
    if start is None:
        start = step.select("company", F.explode(F.array("parent", "child")).alias("root"))
    level = storage.materialize(start.distinct().select("company", "root", F.col("root").alias("descendant"), F.lit(0).alias("depth")), "closure")
    reached = level
    for depth in range(1, max_depth + 1):
        down = level.join(step.withColumnRenamed("parent", "descendant"), ["company", "descendant"]).select("company", "root", F.col("child").alias("descendant")).distinct()
        down = down.join(reached, ["company", "root", "descendant"], "left_anti").withColumn("depth", F.lit(depth))
        level = storage.materialize(down, "closure")
        if level.isEmpty():
            return reached
        reached = reached.unionByName(level)
    raise RuntimeError(f"offerings nest deeper than {max_depth}")
