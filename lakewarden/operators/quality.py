"""Data-quality expectations.

A check that evaluates to NULL counts as a violation.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    check: str  # SQL predicate
    drop: bool = False

    @property
    def holds(self) -> Column:
        return F.coalesce(F.expr(self.check), F.lit(False))


# Rule names, predicates and which of them drop rows.
RULES: Mapping[str, tuple[Rule, ...]] = {
    "customers": (Rule("valid_customer_id", "customer_id IS NOT NULL"),),
    "accounts": (Rule("valid_account_id", "account_id IS NOT NULL"),),
    "third_parties": (Rule("valid_third_party_id", "third_party_id IS NOT NULL"),),
    "transactions": (
        Rule("valid_txn_id", "transaction_id IS NOT NULL", drop=True),
        Rule("valid_amount", "amount IS NOT NULL AND amount >= 0"),
    ),
    "card_transactions": (
        Rule("valid_card_txn_id", "card_txn_id IS NOT NULL", drop=True),
        Rule("valid_amount", "amount IS NOT NULL AND amount >= 0"),
    ),
    "risk_ratings": (
        Rule("valid_entity_id", "entity_id IS NOT NULL"),
        Rule("valid_rating", "risk_rating BETWEEN 1 AND 5"),
    ),
    "beneficial_ownership": (
        Rule("valid_entity_id", "entity_id IS NOT NULL"),
        Rule("valid_ownership", "ownership_pct IS NULL OR (ownership_pct >= 0 AND ownership_pct <= 100)"),
    ),
    "auth_events": (Rule("valid_account_id", "account_id IS NOT NULL"),),
    "adverse_media": (Rule("valid_article_id", "article_id IS NOT NULL", drop=True),),
    "entities": (
        Rule("valid_entity_id", "entity_id IS NOT NULL"),
        Rule("valid_source_id", "source_id IS NOT NULL"),
    ),
    "entity_map": (
        Rule("valid_entity_id", "entity_id IS NOT NULL"),
        Rule("valid_source_id", "source_id IS NOT NULL"),
    ),
    "alerts": (
        Rule("valid_alert_id", "alert_id IS NOT NULL", drop=True),
        Rule("valid_severity", "severity IN ('critical','high','medium','low')", drop=True),
        Rule("valid_score", "score IS NULL OR (score >= 0 AND score <= 1)", drop=True),
        Rule("valid_alert_type", "alert_type IS NOT NULL", drop=True),
    ),
}


def enforce(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Drop the rows that violate a dropping rule; warning rules keep theirs."""
    for rule in rules:
        if rule.drop:
            df = df.filter(rule.holds)
    return df


def observe(df: DataFrame, rules: tuple[Rule, ...], name: str) -> tuple[DataFrame, Observation]:
    """Count violations while the rows flow by, without an extra pass."""
    observation = Observation(name)
    counters = [F.count_if(~r.holds).alias(r.name) for r in rules]
    return df.observe(observation, F.count("*").alias("rows"), *counters), observation


def dq_report(df: DataFrame, dataset: str, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Rows, violations and pass rate per rule, in one pass over the table."""
    rules = RULES[dataset] if rules is None else rules
    wide = df.agg(
        F.count("*").alias("total_rows"), *[F.count_if(~r.holds).alias(r.name) for r in rules]
    )
    total, bad = F.col("total_rows"), F.col("violations")
    return wide.unpivot(
        ["total_rows"], [r.name for r in rules], "rule", "violations"
    ).select(
        F.lit(dataset).alias("dataset"),
        "rule",
        "total_rows",
        "violations",
        F.when(total > 0, F.round(1 - bad / total, 4)).alias("pass_rate"),
    )
