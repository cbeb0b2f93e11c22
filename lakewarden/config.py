"""Thresholds and fixed code lists.

Everything tunable sits in frozen dataclasses whose values reach the plan as
literals, so Catalyst can fold them and push the resulting ranges to Parquet.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class AlertConfig:
    """Detector thresholds (the defaults are fixed values of the rule set)."""

    passthrough_ratio: float = 0.90
    rapid_min_amount: float = 250000.0
    freq_z: float = 3.0
    max_ring_hops: int = 5
    dormant_days: int = 180
    dormant_high_value: float = 500000.0
    risk_jump: int = 2
    ato_amount: float = 3500000.0
    max_feasible_kmh: float = 900.0
    ctr_threshold: float = 25000.0
    struct_min_ratio: float = 0.75
    struct_min_count: int = 3
    struct_window_days: int = 7

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The thresholds as a one-row relation, for users who tune in SQL."""
        values = asdict(self)
        row = ", ".join(
            f"{v}D AS {k}" if isinstance(v, float) else f"{v} AS {k}" for k, v in values.items()
        )
        return spark.sql(f"SELECT {row}")


@dataclass(frozen=True)
class RingConfig:
    """Bounds of the circular-flow search."""

    window_days: int = 3
    min_amount: float = 250000.0
    max_hops: int = 5
    min_hops: int = 3


@dataclass(frozen=True)
class SkewPolicy:
    """When one key is too big for one task, and how finely it is cut.

    A key is *hot* from ``hot_rows`` rows on, so there are at most
    ``rows / hot_rows`` hot keys; only the ``max_hot_keys`` largest are cut,
    which bounds the broadcast list whatever the table size.
    """

    hot_rows: int = 5_000_000
    slice_rows: int = 1_000_000
    max_hot_keys: int = 10_000


@dataclass(frozen=True)
class ReportingEntity:
    """Filing institution printed on every suspicious-transaction report."""

    entity_id: str = "REPORTING-ENTITY"
    branch: str = "compliance@example.org"
    name: str = "Reporting Entity"
    country: str = "ZA"
    currency: str = "ZAR"


# --- fixed values: result-relevant code lists --------------------------------

TEAMS = [
    ("TEAM_TM", "AML Transaction Monitoring"),
    ("TEAM_SW", "Sanctions & Watchlist Screening"),
    ("TEAM_FR", "Fraud Investigations"),
    ("TEAM_EDD", "Enhanced Due Diligence (EDD)"),
]

ANALYSTS = [
    ("AN_SARAH", "Thandeka Nkosi"),
    ("AN_MICHAEL", "Rushil Naidoo"),
    ("AN_LISA", "Lerato Mokoena"),
    ("AN_MARIA", "Anele Mbatha"),
    ("AN_NICOLE", "Carel van Wyk"),
    ("AN_ROBERT", "Fatima Patel"),
]

SCENARIOS = [
    "Rapid Fund Movement",
    "Related Account Movement",
    "PEP/Sanctions Alert",
    "Round Dollar Pattern",
    "High-Risk Geography Transfer",
    "Cash Structuring Detection",
    "Beneficiary Mismatch",
    "Third-Party Deposit Pattern",
    "Dormant Account Reactivation",
]

CASE_STATUSES = ["new", "assigned", "in_progress", "escalated", "closed"]

SEVERITIES = ["critical", "high", "medium", "low"]

SLA_DAYS = {"critical": 7, "high": 14, "medium": 30, "low": 60}
DEFAULT_SLA_DAYS = 30

CASE_MOVES = {
    "new": ["assigned"],
    "assigned": ["in_progress", "escalated"],
    "in_progress": ["escalated", "closed"],
    "escalated": ["closed", "in_progress"],
    "closed": [],
}

CASH_CHANNELS = ["cash_send", "atm", "branch"]

HIGH_RISK_COUNTRIES = ["UAE", "Mauritius", "United Kingdom"]

LABEL_SEVERITY = {
    "Sanctions/Watchlist Hit": 1.0,
    "PEP/Sanctions Alert": 0.9,
    "Cash Structuring Detection": 0.8,
    "Rapid Fund Movement": 0.7,
    "High-Risk Geography Transfer": 0.6,
    "Behavioural Anomaly": 0.6,
    "Beneficiary Mismatch": 0.4,
    "Third-Party Deposit Pattern": 0.4,
    "Round Dollar Pattern": 0.3,
    "Related Account Movement": 0.3,
    "Dormant Account Reactivation": 0.3,
}

SURROGATE_SEVERITY = {
    "PEP/Sanctions Alert": 0.9,
    "Cash Structuring Detection": 0.8,
    "Rapid Fund Movement": 0.7,
    "High-Risk Geography Transfer": 0.6,
    "Beneficiary Mismatch": 0.4,
    "Third-Party Deposit Pattern": 0.4,
}
OTHER_SEVERITY = 0.3

PLANTED_PREFIXES = ["CUSTFRAUD", "TPFRAUD", "CUSTMULE", "CUSTGAME"]

DRIFT_FEATURES = [
    "risk_score",
    "amount_log",
    "num_accounts",
    "current_risk_rating",
    "recent_alerts",
]

MODEL_NUMERIC = [
    "risk_score",
    "amount_log",
    "days_open",
    "investigation_hours",
    "num_accounts",
    "total_balance",
    "current_risk_rating",
    "recent_alerts",
]
MODEL_CATEGORICAL = ["scenario", "priority"]

PII_REVIEWERS = "aml_pii_reviewers"
OVERSIGHT_GROUP = "aml_compliance_oversight"
TEAM_GROUP_PREFIX = "aml_team_"

WATCHLIST = [
    ("WL0001", "Sipho Dlamini", "sanctions", "OFAC SDN", "Mauritius", "Money-mule syndicate designation", "critical"),
    ("WL0002", "Naledi Khumalo", "pep", "EU PEP List", "South Africa", "Politically exposed associate", "high"),
    ("WL0003", "Onyx Capital", "sanctions", "UK OFSI", "Mauritius", "Shell-company sanctions network", "critical"),
    ("WL0004", "Vanguard Nominees", "sanctions", "OFAC SDN", "UAE", "Sanctions evasion network", "critical"),
    ("WL0005", "Summit Trust", "adverse", "Internal Watchlist", "United Kingdom", "Layering via trust structures", "high"),
    ("WL0006", "Dmitri Volkov", "sanctions", "OFAC SDN", "Russia", "Sanctioned oligarch", "critical"),
    ("WL0007", "Global Trade FZE", "sanctions", "UN Consolidated", "UAE", "Front company", "critical"),
    ("WL0008", "Ahmed Hassan", "pep", "World-Check", "Egypt", "Senior public official", "high"),
    ("WL0009", "Meridian Holdings", "adverse", "Adverse Media", "Mauritius", "Offshore tax-evasion ruling", "medium"),
    ("WL0010", "Chen Wei", "pep", "EU PEP List", "Hong Kong", "State-enterprise executive", "medium"),
]
# --- end of fixed values ------------------------------------------------------

# Our mapping from detector family to case scenario.
SCENARIO_OF_ALERT = {
    "rapid_movement": "Rapid Fund Movement",
    "circular_flow": "Related Account Movement",
    "adverse_media": "PEP/Sanctions Alert",
    "frequency_change": "Round Dollar Pattern",
    "risk_rating_change": "High-Risk Geography Transfer",
    "impossible_travel": "High-Risk Geography Transfer",
    "structuring": "Cash Structuring Detection",
    "ubo_change": "Beneficiary Mismatch",
    "account_takeover": "Third-Party Deposit Pattern",
    "dormant_reactivation": "Dormant Account Reactivation",
}
