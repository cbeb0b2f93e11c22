"""Declared schemas of the raw, alert, case and edge relations."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Schema from ``name type, name type``; needs no running session."""
    pairs = (c.split() for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CUSTOMERS = _schema(
    "customer_id string, full_name string, dob date, national_id string, tax_number string,"
    " email string, phone string, address string, city string, country string, segment string,"
    " kyc_tier string, declared_occupation string, declared_monthly_turnover double,"
    " pep_flag boolean, employer_name string, device_id string, onboarded_at timestamp,"
    " onboarding_channel string, source_system string, _ingested_at timestamp"
)
ACCOUNTS = _schema(
    "account_id string, customer_id string, account_type string, currency string,"
    " opened_at timestamp, status string, last_activity_before_ts timestamp, balance double,"
    " source_system string, _ingested_at timestamp"
)
TRANSACTIONS = _schema(
    "transaction_id string, account_id string, from_acct string, to_acct string,"
    " direction string, amount double, currency string, counterparty_id string, channel string,"
    " merchant_category string, txn_ts timestamp, description string, device_id string,"
    " ip_address string, is_cross_border boolean, source_system string, _ingested_at timestamp"
)
CARD_TRANSACTIONS = _schema(
    "card_txn_id string, card_id string, account_id string, amount double, currency string,"
    " merchant string, merchant_category string, channel string, lat double, lon double,"
    " city string, country string, txn_ts timestamp, _ingested_at timestamp"
)
THIRD_PARTIES = _schema(
    "third_party_id string, full_name string, entity_kind string, national_id string,"
    " tax_number string, address string, city string, country string, registered_at timestamp,"
    " source_system string, _ingested_at timestamp"
)
RISK_RATINGS = _schema(
    "rating_id string, entity_id string, entity_type string, risk_rating int,"
    " rated_at timestamp, rated_by string, reason string, _ingested_at timestamp"
)
BENEFICIAL_OWNERSHIP = _schema(
    "ubo_id string, entity_id string, ubo_entity_id string, ownership_pct double,"
    " effective_from timestamp, source string, _ingested_at timestamp"
)
AUTH_EVENTS = _schema(
    "event_id string, account_id string, event_ts timestamp, new_device boolean,"
    " new_geo boolean, credential_change boolean, device_id string, ip_address string,"
    " geo_city string, _ingested_at timestamp"
)
ADVERSE_MEDIA = _schema(
    "article_id string, headline string, body string, published_at date, source string,"
    " named_entities array<string>, _ingested_at timestamp"
)
AML_KNOWLEDGE = _schema(
    "doc_id string, doc_type string, title string, jurisdiction string, body string,"
    " source string, _ingested_at timestamp"
)
SAR_NARRATIVES = _schema(
    "sar_id string, filed_at date, typology string, subject_name string, disposition string,"
    " narrative string, _ingested_at timestamp"
)
ALERT_FEEDBACK = _schema(
    "feedback_id string, alert_id string, status string, analyst_feedback string,"
    " analyst string, created_at timestamp"
)
CASE_NOTES = _schema(
    "note_id string, case_id string, author string, note string, note_type string,"
    " created_at timestamp"
)
CASE_ACTIONS = _schema(
    "action_id string, case_id string, action string, reason string, actor string,"
    " created_at timestamp"
)
FILINGS = _schema(
    "sar_id string, case_id string, customer_name string, scenario string, narrative string,"
    " decision string, filed_by string, filed_at timestamp, approved_by string"
)
AUDIT_LOG = _schema(
    "event_id string, event_ts timestamp, actor string, actor_role string, action string,"
    " case_id string, detail string, source string"
)
EVAL_RESULTS = _schema(
    "eval_id string, eval_ts timestamp, surface string, case_id string, groundedness double,"
    " completeness double, guardrail_pass boolean, guardrail_note string, overall_pass boolean,"
    " model string"
)
WATCHLIST = _schema(
    "watchlist_id string, watch_name string, list_type string, list_source string,"
    " country string, reason string, severity string"
)
ALERT = _schema(
    "alert_id string, alert_type string, severity string, primary_entity_id string,"
    " related_entity_ids array<string>, account_ids array<string>,"
    " transaction_ids array<string>, triggered_at timestamp, score double, explanation string,"
    " evidence map<string,string>, status string, analyst_feedback string"
)
CASE = _schema(
    "case_id string, alert_num bigint, customer_id string, customer_name string,"
    " scenario string, priority string, status string, team_id string, team_name string,"
    " analyst_id string, analyst_name string, risk_score int, amount double, days_open int,"
    " due_date date, investigation_hours double, opened_at timestamp"
)
EDGE = _schema(
    "source_entity_id string, target_entity_id string, edge_type string, weight double,"
    " evidence map<string,string>"
)

TABLES = {
    "customers": CUSTOMERS,
    "accounts": ACCOUNTS,
    "transactions": TRANSACTIONS,
    "card_transactions": CARD_TRANSACTIONS,
    "third_parties": THIRD_PARTIES,
    "risk_ratings": RISK_RATINGS,
    "beneficial_ownership": BENEFICIAL_OWNERSHIP,
    "auth_events": AUTH_EVENTS,
    "adverse_media": ADVERSE_MEDIA,
    "aml_knowledge": AML_KNOWLEDGE,
    "sar_narratives": SAR_NARRATIVES,
    "alert_feedback": ALERT_FEEDBACK,
    "case_notes": CASE_NOTES,
    "case_actions": CASE_ACTIONS,
    "filings": FILINGS,
    "audit_log": AUDIT_LOG,
    "eval_results": EVAL_RESULTS,
    "watchlist": WATCHLIST,
    "alerts": ALERT,
    "cases": CASE,
    "edges": EDGE,
}


def with_batch_id(schema: T.StructType) -> T.StructType:
    """The schema plus the micro-batch number a path is partitioned by."""
    return T.StructType([*schema, T.StructField("batch_id", T.LongType())])
