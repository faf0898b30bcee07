"""Answering a question locally: routed, gated, planned by a given model, checked; else handed on."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame

from orrery.functions.vocabulary import ROUTES
from orrery.operators.graph import Graph
from orrery.operators.router import LOCAL_THRESHOLD
from orrery.plans.families import compile_plan
from orrery.plans.plan import Refusal


class StackError(ValueError):
    """A file of the local stack is no good."""


def read_thresholds(content: str | None) -> dict[str, Any]:
    """The router's thresholds, a JSON object; null content is a missing file."""
    if content is None:
        raise StackError("no thresholds")
    try:
        found = json.loads(content)
    except json.JSONDecodeError as bad:
        raise StackError(f"thresholds are no JSON: {bad}") from bad
    if not isinstance(found, dict):
        raise StackError("thresholds are no object")
    return found


def first_plan(text: str) -> dict[str, Any]:
    """The first JSON object inside a generated text."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return decoder.raw_decode(text, at)[0]
        except ValueError:
            at = text.find("{", at + 1)
    raise StackError("no plan in the generated text")


def route(probabilities: Mapping[str, float]) -> str:
    """The decision of one question, as ``router.decide`` takes it for columns."""
    if probabilities["local"] >= LOCAL_THRESHOLD:
        return "local"
    return max(("refuse", "api_fallback"), key=lambda r: probabilities[r])


def answer(question: str, probabilities: Mapping[str, float], thresholds: Mapping[str, Any], generate: Callable[[str], str], graph: Graph) -> dict[str, Any]:
    """``decision, plan, error``, and of a local decision ``rows``, a DataFrame that was analysed.

    ``generate`` makes a plan's text of a question. Whatever fails after routing, a closed gate
    included, hands the question on: the decision is ``api_fallback`` with the ``error``.
    """
    missing = [r for r in ROUTES if r not in probabilities]
    if missing:
        raise StackError(f"no probability of {missing}")
    out: dict[str, Any] = {"decision": route(probabilities), "plan": None, "rows": None, "error": None}
    if out["decision"] != "local":
        return out
    try:
        if thresholds.get("planner_gate_open") is not True:
            raise StackError("the planner's gate is closed")
        plan = first_plan(generate(question))
        out |= {"plan": plan, "rows": preflight(plan, graph)}
    except Exception as failure:  # a model's text may be wrong in any way
        out |= {"decision": "api_fallback", "plan": None, "error": str(failure) or type(failure).__name__}
    return out


def preflight(plan: Mapping[str, Any], graph: Graph) -> DataFrame:
    """A plan's rows, analysed but not computed; refusals and plans of another shape are raised."""
    rows = compile_plan(plan, graph.places, graph.labels)(graph)
    rows.schema  # noqa: B018  analysis happens here at the latest
    return rows


def result(output: Mapping[str, Any], reason: str) -> DataFrame | Refusal | None:
    """What ``answer`` comes to: rows, a refusal for ``reason``, or nothing where another must answer."""
    if output["decision"] == "refuse":
        return Refusal(reason)
    return output["rows"] if output["decision"] == "local" else None
