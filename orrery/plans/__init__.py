"""The closed query algebra: plans in, DataFrames or refusals out."""

from orrery.plans.families import compile_plan, execute
from orrery.plans.plan import FAMILIES, LOOKUPS, Plan, Refusal

__all__ = ["FAMILIES", "LOOKUPS", "Plan", "Refusal", "compile_plan", "execute"]
