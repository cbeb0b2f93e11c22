"""Score blends, severity weights and service-level columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewarden.config import DEFAULT_SLA_DAYS, SLA_DAYS


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def lookup(c: Column, table: Mapping[str, object], default: object) -> Column:
    """Constant lookup table as an expression; unknown or NULL gives the default."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.coalesce(c, F.lit(""))), F.lit(default))


#: Shares of the model's and the rules' score in the blend.
MODEL_WEIGHT, RULES_WEIGHT = 0.70, 0.30


def blend_ai_risk(
    model: Column, rules: Column, model_weight: float = MODEL_WEIGHT, rules_weight: float = RULES_WEIGHT
) -> Column:
    """0-100 risk: weighted blend that never falls below the rules score."""
    m, r = clamp(model), clamp(rules)
    return F.round(clamp(F.greatest(model_weight * m + rules_weight * r, r)) * 100, 1)


def severity_rank(c: Column) -> Column:
    """critical, high, medium, everything else."""
    return lookup(c, {"critical": 0, "high": 1, "medium": 2}, 3)


def sla_target(priority: Column) -> Column:
    return lookup(F.lower(priority), SLA_DAYS, DEFAULT_SLA_DAYS)


def sla_columns(priority: Column, days_open: Column) -> dict[str, Column]:
    """Target, elapsed and remaining days plus status; an unreadable age counts as 0."""
    target = sla_target(priority)
    age = F.coalesce(days_open.try_cast("int"), F.lit(0))
    status = (
        F.when(age > target, "breached").when(age >= 0.8 * target, "at_risk").otherwise("on_track")
    )
    return {
        "sla_target_days": target,
        "sla_days_open": age,
        "sla_days_remaining": target - age,
        "sla_breached": age > target,
        "sla_status": status,
    }


def overall_pass(guardrail: Column, groundedness: Column, completeness: Column) -> Column:
    return guardrail & (groundedness >= 0.6) & (completeness >= 0.6)
