"""Families of queries as DataFrame builders.

A family yields rows of ``company`` and, where it has them, ``segment`` or ``offering``. Filters
on names reach the edge scans; every other condition is a left semi join, so rows never multiply
and Catalyst orders and broadcasts by measured size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.graph import Graph
from orrery.operators.places import Places, match_rank
from orrery.plans.plan import LOOKUPS, Plan, Refusal, require

SEGMENT = ["company", "segment"]
FILTERS = ("companies", "segments", "offerings", "customer_types", "channels", "revenue_models", "binding_scope", "hierarchy_mode")
Build = Callable[[Graph], DataFrame]


def _within(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    return df.where(F.col(column).isin(*values)) if values else df


def _segments(g: Graph, plan: Plan) -> DataFrame:
    return _within(_within(g.has_segment, "company", plan.companies), "segment", plan.segments)


def _having(g: Graph, kind: str, value: str, mode: str) -> DataFrame:
    """Segments that satisfy one atom."""
    if kind == "customer_type":
        rows = g.serves.where(F.col("customer_type") == value)
    elif kind == "channel":
        rows = g.sells.where(F.col("channel") == value)
    elif kind == "offering" and mode == "direct":
        rows = g.roots.where(F.col("offering") == value)
    elif kind == "offering":
        named = [g.roots.select("company", "offering"), *[g.child_offerings.select("company", F.col(c).alias("offering")) for c in ("parent", "child")]]
        rows = g.segments_over(reduce(DataFrame.unionByName, named).where(F.col("offering") == value).distinct())
    else:
        paid = g.monetizes.where(F.col("revenue_model") == value).select("company", "offering")
        rows = g.roots.join(paid, ["company", "offering"], "left_semi") if mode == "direct" else g.segments_over(paid.distinct())
    return rows.select(*SEGMENT)


def _same_segment(g: Graph, plan: Plan, seed: DataFrame) -> DataFrame:
    return reduce(lambda rows, atom: rows.join(_having(g, *atom, plan.mode), SEGMENT, "left_semi"), plan.atoms, seed)


def _across_segments(g: Graph, plan: Plan) -> DataFrame:
    seed = _within(g.companies, "company", plan.companies)
    one = lambda atom: _segments(g, plan).join(_having(g, *atom, plan.mode), SEGMENT, "left_semi")
    return reduce(lambda rows, atom: rows.join(one(atom).select("company"), "company", "left_semi"), plan.atoms, seed)


def _in_places(g: Graph, places: tuple[str, ...]) -> DataFrame:
    """Companies that operate in a requested place, in a place within it, or in a region around it."""
    dim = g.dimension
    rank = match_rank(list(places), F.col("place"), F.col("within_places"), F.col("includes_places"))
    hits = F.broadcast(dim.withColumn("rank", rank).where("rank is not null").select("place")) if dim is not None else None
    named = g.operates.where(F.col("place").isin(*places))
    found = named if hits is None else named.unionByName(g.operates.join(hits, "place", "left_semi").select("company", "place"))
    return found.select("company").distinct()


def _placed(g: Graph, plan: Plan, rows: DataFrame) -> DataFrame:
    return rows.join(_in_places(g, plan.places), "company", "left_semi") if plan.places else rows


def _descendants(g: Graph, plan: Plan) -> DataFrame:
    roots = _within(g.roots, "company", plan.companies).where(F.col("offering").isin(*plan.offerings))
    asked = roots.select("company", F.col("offering").alias("root")).distinct()
    return g.below(asked).select("company", "offering")


def _descendant_revenue(g: Graph, plan: Plan) -> DataFrame:
    rows = _descendants(g, plan)
    for model in plan.revenue_models:
        rows = rows.join(g.monetizes.where(F.col("revenue_model") == model), ["company", "offering"], "left_semi")
    return _placed(g, plan, rows)


def _offerings(g: Graph, plan: Plan) -> DataFrame:
    return _segments(g, plan).join(g.roots, SEGMENT)


def _by_partner(g: Graph, plan: Plan) -> DataFrame:
    return _within(g.partners, "company", plan.companies).where(F.col("partner").isin(*plan.partners))


#: family -> (its rows, output columns)
ROWS: dict[str, tuple[Callable[[Graph, Plan], DataFrame], list[str]]] = {
    "companies_list": (lambda g, p: g.companies, ["company"]),
    "segments_by_company": (_segments, SEGMENT),
    "offerings_by_company": (_offerings, ["company", "offering"]),
    "offerings_by_segment": (_offerings, ["company", "segment", "offering"]),
    "companies_by_segment_filters": (lambda g, p: _same_segment(g, p, _segments(g, p)), ["company"]),
    "segments_by_segment_filters": (lambda g, p: _same_segment(g, p, _segments(g, p)), SEGMENT),
    "companies_by_cross_segment_filters": (_across_segments, ["company"]),
    "descendant_offerings_by_root": (_descendants, ["company", "offering"]),
    "companies_by_descendant_revenue": (_descendant_revenue, ["company"]),
    "companies_by_place": (lambda g, p: _in_places(g, p.places), ["company"]),
    "segments_by_place_and_segment_filters": (lambda g, p: _same_segment(g, p, _placed(g, p, _segments(g, p))), SEGMENT),
    "companies_by_partner": (_by_partner, ["company"]),
}
#: family -> (slots it has, slots it needs)
SLOTS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "companies_list": ((), ()),
    "segments_by_company": (("companies",), ("companies",)),
    "offerings_by_company": (("companies",), ("companies",)),
    "offerings_by_segment": (("companies", "segments"), ("segments",)),
    "companies_by_segment_filters": (FILTERS, ()),
    "segments_by_segment_filters": (FILTERS, ()),
    "companies_by_cross_segment_filters": (FILTERS, ()),
    "descendant_offerings_by_root": (("companies", "offerings", "hierarchy_mode"), ("offerings",)),
    "companies_by_descendant_revenue": (("companies", "offerings", "revenue_models", "places", "hierarchy_mode"), ("offerings", "revenue_models")),
    "companies_by_place": (("places",), ("places",)),
    "segments_by_place_and_segment_filters": ((*FILTERS, "places"), ("places",)),
    "companies_by_partner": (("companies", "partners"), ("partners",)),
}
#: least number of atoms, and the binding that a lookup accepts
ATOMS = {
    "companies_by_segment_filters": (1, "same_segment"),
    "segments_by_segment_filters": (1, "same_segment"),
    "segments_by_place_and_segment_filters": (1, "same_segment"),
    "companies_by_cross_segment_filters": (2, "across_segments"),
}


def _check_lookup(plan: Plan) -> None:
    allowed, needed = SLOTS[plan.family]
    plan.only(*allowed)
    if plan.family in ATOMS:
        require(plan.binding_scope in (None, ATOMS[plan.family][1]), "ambiguous_request", f"{plan.family} binds {ATOMS[plan.family][1]}")
    require(all(getattr(plan, n) for n in needed), "ambiguous_request", f"{plan.family} needs {needed}")
    require(len(plan.atoms) >= ATOMS.get(plan.family, (0,))[0], "ambiguous_request", "too few filters")
    require(plan.limit is None or plan.limit > 0, "ambiguous_request", "a limit is positive")


def _check_base(family: str, plan: Plan) -> None:
    """What a wrapper asks of its base: families with filters, and the list, ignore other slots."""
    allowed, needed = SLOTS[family]
    # a base of this family never passes: the wrapper's own slots are no slots of it
    require(family != "companies_by_descendant_revenue", "beyond_local_coverage", "no wrapper over revenue of descendants")
    if family not in ATOMS and family != "companies_list":
        plan.only(*(s for s in allowed if s != "hierarchy_mode"), "base_family", "aggregate_spec")
    require(all(getattr(plan, n) for n in needed), "ambiguous_request", f"{family} needs {needed}")
    require(len(plan.atoms) >= ATOMS.get(family, (0,))[0], "ambiguous_request", "too few filters")


def _lookup(plan: Plan) -> Build:
    _check_lookup(plan)
    rows, columns = ROWS[plan.family]

    def build(g: Graph) -> DataFrame:
        out = rows(g, plan).select(*columns).distinct().orderBy(*columns)
        return out if plan.limit is None else out.limit(plan.limit)

    return build


def _exists(plan: Plan) -> Build:
    require(plan.base_family in LOOKUPS, "beyond_local_coverage", "no such base")
    _check_base(plan.base_family, plan)
    rows, columns = ROWS[plan.base_family]
    return lambda g: rows(g, plan).agg((F.count_distinct(F.struct(*columns[-1:])) > 0).alias("is_match"))


def _count(plan: Plan) -> Build:
    spec = plan.aggregate_spec or {}
    base, target = spec.get("base_family"), spec.get("count_target")
    require(spec.get("kind") == "count" and base in LOOKUPS, "beyond_local_coverage", "no such count")
    require(target in LOOKUPS[base], "beyond_local_coverage", f"{base} does not count {target}")
    _check_base(base, plan)
    key = ["company"] if target == "company" else ["company", target]
    return lambda g: ROWS[base][0](g, plan).agg(F.count_distinct(F.struct(*key)).alias(f"{target}_count"))


def _ranked(rows: DataFrame, label: str, counted: list[str], name: str, k: int) -> DataFrame:
    return rows.groupBy(label).agg(F.count_distinct(F.struct(*counted)).alias(name)).orderBy(F.desc(name), label).limit(k)


def _ranking(plan: Plan) -> Build:
    spec = plan.aggregate_spec or {}
    require(spec.get("kind") == "ranking", "beyond_local_coverage", "no ranking")
    k = plan.limit if plan.limit is not None else spec.get("limit", 5)
    require(isinstance(k, int) and k > 0, "ambiguous_request", "a ranking's limit is positive")
    metric = spec.get("ranking_metric")
    if metric == "company_by_matched_segment_count":
        plan.only(*FILTERS, "places", "aggregate_spec")
        require(plan.atoms, "ambiguous_request", "too few filters")
        return lambda g: _ranked(_same_segment(g, plan, _placed(g, plan, _segments(g, plan))), "company", ["segment"], "segment_count", k)
    metrics: dict[str, tuple[Callable[[Graph], DataFrame], str, list[str], str]] = {
        "customer_type_by_company_count": (lambda g: g.serves, "customer_type", ["company"], "company_count"),
        "channel_by_segment_count": (lambda g: g.sells, "channel", SEGMENT, "segment_count"),
        "revenue_model_by_company_count": (lambda g: g.segment_closure().join(g.monetizes, ["company", "offering"]), "revenue_model", ["company"], "company_count"),
    }
    require(metric in metrics, "beyond_local_coverage", f"no such metric: {metric!r}")
    plan.only("companies", "places", "aggregate_spec")
    rows, label, counted, name = metrics[metric]

    def build(g: Graph) -> DataFrame:
        own = _placed(g, plan, _within(g.has_segment, "company", plan.companies))
        return _ranked(rows(g).join(own, SEGMENT, "left_semi"), label, counted, name, k)

    return build


def compile_plan(plan: Plan | Mapping[str, Any], places: Places | None = None, labels: Mapping[str, Any] | None = None) -> Build:
    """The builder of a plan's DataFrame; raises ``Refusal``, or ``ValueError`` if it is no plan."""
    plan = (plan if isinstance(plan, Plan) else Plan.parse(plan)).normalize(places, labels)
    return {"boolean_exists": _exists, "count_aggregate": _count, "ranking_topk": _ranking}.get(plan.family, _lookup)(plan)


def execute(plan: Plan | Mapping[str, Any], graph: Graph) -> DataFrame | Refusal:
    """A plan's rows on a graph, or the refusal."""
    try:
        return compile_plan(plan, graph.places, graph.labels)(graph)
    except Refusal as no:
        return no
