"""Suspicious-transaction reports: briefs, XML documents and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.config import ReportingEntity

# Document codes, the action line and the validation rules' names.
SUBMISSION_CODE = "E"
REPORT_CODE = "STR"
ACTION_LINE = "Escalated to FIC; funds monitored"
MAX_TRANSACTIONS = 10
MAX_WATCH_NAMES = 3

RULES = [
    "well-formed XML",
    "root element is <report>",
    "rentity_id present",
    "report_code == 'STR'",
    "entity_reference present",
    "activity block present",
    "suspicious_party.party_name present",
    "goods_services.currency_code present",
    "total_amount is numeric",
    "at least one transaction",
    "every transaction has number + numeric amount",
    "reason present",
]


def evidence_brief(pack: DataFrame, currency: str = "ZAR") -> DataFrame:
    """One factual line per case, built from the evidence pack."""
    txns = F.col("transactions")
    largest = F.array_max(F.transform(txns, lambda t: t["amount"]))
    directions = F.array_join(
        F.array_sort(F.array_distinct(F.transform(txns, lambda t: t["direction"]))), ", "
    )
    places = F.array_join(
        F.array_sort(
            F.array_distinct(F.array_compact(F.transform("network", lambda n: n["country"])))
        ),
        ", ",
    )
    named = F.array_join(
        F.transform(
            F.slice("screening", 1, 4),
            lambda h: F.concat(h["watch_name"], F.lit(" ("), h["list_type"], F.lit("/"), h["confidence"], F.lit(")")),
        ),
        "; ",
    )
    text = F.concat_ws(
        " ",
        F.format_string(
            "Case %s, customer %s (%s): %s, priority %s, rules risk %d/100, " + currency
            + " %.2f, %d days open, team %s.",
            "case_id", F.coalesce("customer_name", F.lit("n/a")), F.coalesce("customer_id", F.lit("n/a")),
            "scenario", "priority", "risk_score", "amount", "days_open", "team_name",
        ),
        F.when(
            F.size(txns) > 0,
            F.format_string(
                "%d flagged transactions, largest " + currency + " %.2f, directions %s.",
                F.size(txns), largest, directions,
            ),
        ),
        F.when(
            F.size("network") > 0,
            F.format_string(
                "%d counterparties in %s.", F.size("network"),
                F.coalesce(F.nullif(places, F.lit("")), F.lit("n/a")),
            ),
        ),
        F.when(
            F.size("screening") > 0,
            F.format_string("%d watchlist hits: %s.", F.size("screening"), named),
        ),
        F.when(
            F.col("pkyc").isNotNull(),
            F.format_string(
                "Dynamic risk %d, band %s, drivers: %s.", F.col("pkyc.dynamic_risk"),
                F.col("pkyc.risk_band"), F.col("pkyc.risk_drivers"),
            ),
        ),
    )
    return pack.select("case_id", text.alias("brief"))


def _text(c: Column) -> Column:
    """Text fit for XML: control characters go, and an empty string is left out."""
    plain = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.nullif(plain, F.lit(""))


def _money(c: Column) -> Column:
    return F.round(F.coalesce(c, F.lit(0.0)), 2)


def str_reports(
    pack: DataFrame, entity: ReportingEntity = ReportingEntity(), narrative: str | None = None
) -> DataFrame:
    """One XML document per case of the evidence pack."""
    item = F.transform(
        F.slice(F.coalesce("transactions", F.array().cast(pack.schema["transactions"].dataType)), 1, MAX_TRANSACTIONS),
        lambda t: F.struct(
            _text(t["transaction_id"]).alias("transactionnumber"),
            _text(t["direction"]).alias("transaction_type"),
            _money(t["amount"]).alias("amount_local"),
            _text(t["channel"]).alias("transaction_channel"),
            F.date_format(t["txn_ts"], "yyyy-MM-dd HH:mm:ss").alias("date_transaction"),
            _text(t["counterparty_id"]).alias("counterparty"),
        ),
    )
    watch = F.array_join(
        F.transform(F.slice("screening", 1, MAX_WATCH_NAMES), lambda h: h["watch_name"]), ", "
    )
    reason = F.concat(
        F.col("scenario"),
        F.when(F.size("screening") > 0, F.concat(F.lit("; watchlist: "), watch)).otherwise(""),
    )
    indicators = F.array_compact(
        F.array(
            F.col("scenario"),
            F.concat(F.lit("rules_risk_"), F.col("risk_score").cast("string")),
            F.concat(F.lit("pkyc_"), F.col("pkyc.risk_band")),
        )
    )
    story = F.lit(None).cast("string") if narrative is None else _text(F.col(narrative))
    activity = F.struct(
        F.struct(indicators.alias("indicator")).alias("report_indicators"),
        F.struct(
            _text(F.col("customer_name")).alias("party_name"),
            _text(F.col("customer_id")).alias("party_reference"),
        ).alias("suspicious_party"),
        F.struct(
            F.lit("FUNDS").alias("item_type"),
            _money(F.col("amount")).alias("total_amount"),
            F.lit(entity.currency).alias("currency_code"),
        ).alias("goods_services"),
        F.struct(item.alias("transaction")).alias("transactions"),
        reason.alias("reason"),
        F.lit(ACTION_LINE).alias("action"),
        story.alias("narrative"),
    )
    report = F.struct(
        F.lit(entity.entity_id).alias("rentity_id"),
        F.lit(entity.branch).alias("rentity_branch"),
        F.lit(SUBMISSION_CODE).alias("submission_code"),
        F.lit(REPORT_CODE).alias("report_code"),
        F.col("case_id").alias("entity_reference"),
        F.struct(
            _text(F.col("analyst_name")).alias("first_name"),
            F.lit(entity.name).alias("entity"),
            F.lit(entity.country).alias("country"),
        ).alias("reporting_person"),
        activity.alias("activity"),
    )
    body = F.to_xml(report, {"rowTag": "report"})
    header = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n')
    return pack.select("case_id", F.concat(header, body).alias("xml"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Filing export: one text row per document, written in parallel."""
    reports.write.mode("overwrite").parquet(path)


_SHAPE = (
    "rentity_id string, report_code string, entity_reference string,"
    " activity struct<"
    "suspicious_party: struct<party_name: string>,"
    " goods_services: struct<currency_code: string, total_amount: string>,"
    " transactions: struct<transaction: array<struct<transactionnumber: string, amount_local: string>>>,"
    " reason: string>,"
    " _corrupt string"
)
_ROOT = r"^\s*(<\?xml[^>]*\?>)?\s*<report[\s/>]"
_ACTIVITY = r"<activity[\s/>]"


def _filled(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def _numeric(c: Column) -> Column:
    return F.trim(c).try_cast("double").isNotNull()


def validate_reports(reports: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Twelve structural rules per document: valid, passed count and failed rules.

    Each document is parsed once into the fields the rules read; one that does
    not parse passes no rule.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    doc = F.col("_doc")
    base = reports.withColumn("_doc", F.from_xml(F.col(xml_col), _SHAPE, options)).withColumn(
        "_ok", F.col(xml_col).isNotNull() & doc["_corrupt"].isNull()
    )
    activity = doc["activity"]
    txns = F.coalesce(activity["transactions"]["transaction"], F.array())
    sound = F.forall(
        txns, lambda t: _filled(t["transactionnumber"]) & F.coalesce(_numeric(t["amount_local"]), F.lit(False))
    )
    checks = [
        F.col("_ok"),
        F.col(xml_col).rlike(_ROOT),
        _filled(doc["rentity_id"]),
        doc["report_code"] == REPORT_CODE,
        _filled(doc["entity_reference"]),
        F.col(xml_col).rlike(_ACTIVITY),
        _filled(activity["suspicious_party"]["party_name"]),
        _filled(activity["goods_services"]["currency_code"]),
        _numeric(activity["goods_services"]["total_amount"]),
        F.size(txns) >= 1,
        sound,
        _filled(activity["reason"]),
    ]
    failed = F.array_compact(
        F.array(*[
            F.when(~F.coalesce(c, F.lit(False)), F.lit(label))
            for label, c in zip(RULES, checks, strict=True)
        ])
    )
    return (
        base.withColumn("issues", F.when(F.col("_ok"), failed).otherwise(F.array(F.lit("not well-formed"))))
        .withColumn("checks_total", F.lit(len(RULES)))
        .withColumn(
            "checks_passed",
            F.when(F.col("_ok"), F.lit(len(RULES)) - F.size("issues")).otherwise(0),
        )
        .withColumn("valid", F.size("issues") == 0)
        .drop("_ok", "_doc")
    )
