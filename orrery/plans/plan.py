"""Query plans: their shape, their normalisation and the reasons for refusing them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from orrery.functions.vocabulary import CANONICAL_LABELS, LABEL_ALIASES, REFUSALS
from orrery.operators.places import Places, clean

#: Count targets that a family supports.
LOOKUPS: dict[str, tuple[str, ...]] = {
    "companies_list": ("company",),
    "segments_by_company": ("company", "segment"),
    "offerings_by_company": ("company", "offering"),
    "offerings_by_segment": ("company", "offering"),
    "companies_by_segment_filters": ("company",),
    "segments_by_segment_filters": ("company", "segment"),
    "companies_by_cross_segment_filters": ("company",),
    "descendant_offerings_by_root": ("company", "offering"),
    "companies_by_descendant_revenue": ("company",),
    "companies_by_place": ("company",),
    "segments_by_place_and_segment_filters": ("company", "segment"),
    "companies_by_partner": ("company",),
}
FAMILIES = (*LOOKUPS, "boolean_exists", "count_aggregate", "ranking_topk")
LISTS = ("companies", "segments", "offerings", "customer_types", "channels", "revenue_models", "places", "partners")
CHOICES = {"binding_scope": ("same_segment", "across_segments"), "hierarchy_mode": ("direct", "descendant"), "base_family": tuple(LOOKUPS)}


class Refusal(Exception):
    """A plan that is not answered, and why."""

    def __init__(self, reason: str, message: str = ""):
        if reason not in REFUSALS:
            raise ValueError(reason)
        super().__init__(message or reason)
        self.reason = reason


def require(condition: object, reason: str, message: str) -> None:
    if not condition:
        raise Refusal(reason, message)


@dataclass(frozen=True)
class Plan:
    """A family and its slots; unknown payload keys are ignored."""

    family: str
    companies: tuple[str, ...] = ()
    segments: tuple[str, ...] = ()
    offerings: tuple[str, ...] = ()
    customer_types: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    revenue_models: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    partners: tuple[str, ...] = ()
    binding_scope: str | None = None
    hierarchy_mode: str | None = None
    aggregate_spec: Mapping[str, Any] | None = None
    base_family: str | None = None
    limit: int | None = None

    @classmethod
    def parse(cls, envelope: Mapping[str, Any]) -> Plan:
        """From ``{answerable, family, payload}``; ``ValueError`` if it has another shape."""
        if envelope.get("answerable", True) is not True:
            raise ValueError("a plan is answerable")
        family, payload = envelope.get("family"), envelope.get("payload") or {}
        if family not in FAMILIES or not isinstance(payload, Mapping):
            raise ValueError(f"no such family: {family!r}")
        known: dict[str, Any] = {}
        for name in (f.name for f in fields(cls) if f.name != "family"):
            value = payload.get(name)
            if value is None:
                continue
            if name in LISTS:
                if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
                    raise ValueError(f"{name} is a list of names")
                value = tuple(value)
            elif name in CHOICES and value not in CHOICES[name]:
                raise ValueError(f"{name}: {value!r}")
            elif name == "limit" and (not isinstance(value, int) or isinstance(value, bool)):
                raise ValueError("limit is a whole number")
            elif name == "aggregate_spec" and not isinstance(value, Mapping):
                raise ValueError("aggregate_spec is an object")
            known[name] = value
        return cls(family, **known)

    def normalize(self, places: Places | None, labels: Mapping[str, Iterable[str]] | None = None) -> Plan:
        """Cleaned, deduplicated names; labels and places by their canonical names."""
        known = {n: _distinct(getattr(self, n)) for n in ("companies", "segments", "offerings", "partners")}
        for name, kind in (("customer_types", "CustomerType"), ("channels", "Channel"), ("revenue_models", "RevenueModel")):
            known[name] = _labels(getattr(self, name), kind, labels)
        known["places"] = _distinct((places.normalize(p) if places else clean(p)) for p in self.places if clean(p))
        return replace(self, **known)

    @property
    def atoms(self) -> list[tuple[str, str]]:
        kinds = (("customer_type", self.customer_types), ("channel", self.channels), ("offering", self.offerings), ("revenue_model", self.revenue_models))
        return [(kind, value) for kind, values in kinds for value in values]

    @property
    def mode(self) -> str:
        return self.hierarchy_mode or ("descendant" if self.revenue_models else "direct")

    def only(self, *allowed: str) -> None:
        """Refuse if any other slot is filled; the limit is no slot."""
        slots = (*LISTS, "binding_scope", "hierarchy_mode", "aggregate_spec", "base_family")
        filled = [s for s in slots if (bool(getattr(self, s)) if s in LISTS else getattr(self, s) is not None)]
        extra = sorted(set(filled) - set(allowed))
        require(not extra, "beyond_local_coverage", f"slots that {self.family} has not: {extra}")


def _distinct(values: Iterable[str]) -> tuple[str, ...]:
    found: dict[str, str] = {}
    for value in map(clean, values):
        if value:
            found.setdefault(value.casefold(), value)
    return tuple(found.values())


def label_keys(kind: str, labels: Mapping[str, Iterable[str]] | None = None) -> dict[str, str]:
    """Key -> label: of the ontology with its aliases, or of another graph's own ``labels``."""
    if labels is not None:
        return {label.casefold(): label for label in labels[kind]}
    keys = {label.casefold(): label for label in CANONICAL_LABELS[kind]}
    return keys | {other.casefold(): label for other, label in LABEL_ALIASES[kind].items()}


def _labels(values: Iterable[str], kind: str, labels: Mapping[str, Iterable[str]] | None) -> tuple[str, ...]:
    keys = label_keys(kind, labels)
    found: dict[str, None] = {}
    for value in values:
        name = clean(value)
        if name:
            require(name.casefold() in keys, "ambiguous_closed_label", f"{value!r} is no {kind}")
            found.setdefault(keys[name.casefold()])
    return tuple(found)
