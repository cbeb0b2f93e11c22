"""The domain tables as views over the bundled star-schema test tables.

Every view is a projection of one table (plus the 25-row nation table for
country names), so no adapter adds a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.config import ANALYSTS, CASE_STATUSES, SCENARIOS, TEAMS

AS_OF_LEDGER = "2001-07-01 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"

# Declared scan schemas: timestamps are read as instants, so ranges push down.
SCANS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
                " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
                " l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCANS[name]).parquet(f"{sf_dir}/{name}.parquet")


def tag(prefix: str, c: str | Column) -> Column:
    """String id, zero-padded to eight digits; longer keys keep all of theirs."""
    digits = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), F.lit("0")))


def _pick(c: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))


class Roles:
    """Domain tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, self.sf_dir, name)

    # raw feeds

    def transactions(self) -> DataFrame:
        """Ledger feed with repeated keys: one row per line item."""
        part = F.col("l_linenumber") % 4
        account = tag("ACC", "l_suppkey")
        return self.table("lineitem").select(
            F.concat_ws("-", F.lit("TX"), "l_orderkey", "l_linenumber").alias("transaction_id"),
            account.alias("account_id"),
            account.alias("from_acct"),
            tag("ACC", F.floor(F.col("l_partkey") / 20)).alias("to_acct"),
            F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit").alias("direction"),
            F.col("l_extendedprice").alias("amount"),
            tag("TP", "l_partkey").alias("counterparty_id"),
            F.when(F.col("l_linestatus") == "F", "branch").otherwise("wire").alias("channel"),
            _pick(part, ["transfer", "cash", "gaming", "retail"]).alias("merchant_category"),
            F.col("l_shipdate").alias("txn_ts"),
            F.col("l_shipdate").alias("_ingested_at"),
        )

    def event_ledger(self) -> DataFrame:
        """Second ledger on the events clock: purchases and errors are debits, all others credits."""
        return self.table("events").select(
            tag("EV", "event_id").alias("transaction_id"),
            tag("ACC", "user_id").alias("account_id"),
            F.when(F.col("event_type").isin("purchase", "error"), "debit").otherwise("credit").alias("direction"),
            F.col("value").alias("amount"),
            F.col("ts").alias("txn_ts"),
        )

    def customers(self) -> DataFrame:
        key = F.col("c_custkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        return (
            self.table("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                tag("CUST", key).alias("customer_id"),
                F.col("c_name").alias("full_name"),
                F.date_add(F.lit("1950-01-01").cast("date"), (key % 20000).cast("int")).alias("dob"),
                F.when(key % 3 == 0, "").otherwise(key.cast("string")).alias("national_id"),
                F.when(key % 6 == 0, F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))).alias("tax_number"),
                F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
                tag("+27", key).alias("phone"),
                F.concat_ws(" ", (key % 97).cast("string"), F.lit("Main St")).alias("address"),
                F.concat(F.lit("City "), F.col("c_nationkey").cast("string")).alias("city"),
                F.col("n_name").alias("country"),
                F.col("c_mktsegment").alias("segment"),
                F.when(key % 4 == 0, "enhanced").otherwise("standard").alias("kyc_tier"),
                F.lit("trader").alias("declared_occupation"),
                F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 10).alias("declared_monthly_turnover"),
                (key % 10 == 0).alias("pep_flag"),
                F.lit("2000-01-01 00:00:00").cast("timestamp").alias("onboarded_at"),
                F.lit("2000-01-01 00:00:00").cast("timestamp").alias("_ingested_at"),
            )
        )

    def accounts(self) -> DataFrame:
        """Two accounts per owning customer."""
        key = F.col("s_suppkey")
        as_of = F.lit(AS_OF_LEDGER).cast("timestamp")
        return self.table("supplier").select(
            tag("ACC", key).alias("account_id"),
            tag("CUST", F.floor(key / 2) * 15).alias("customer_id"),
            F.when(key % 3 == 0, "savings").otherwise("current").alias("account_type"),
            F.when(key % 5 == 0, "dormant").otherwise("active").alias("status"),
            (as_of - F.make_dt_interval((key * 7 % 400).cast("int"))).alias("last_activity_before_ts"),
            (F.col("s_acctbal") * 1000).alias("balance"),
        )

    def third_parties(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            tag("TP", key).alias("third_party_id"),
            F.col("p_name").alias("full_name"),
            F.lit("company").alias("entity_kind"),
            F.when(key % 4 == 0, key.cast("string")).alias("national_id"),
            F.lit(None).cast("string").alias("tax_number"),
            F.lower("p_brand").alias("address"),
            F.col("p_brand").alias("city"),
            F.col("p_type").alias("country"),
        )

    def risk_ratings(self) -> DataFrame:
        return self.table("orders").select(
            tag("RT", "o_orderkey").alias("rating_id"),
            tag("CUST", "o_custkey").alias("entity_id"),
            F.lit("customer").alias("entity_type"),
            (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("risk_rating"),
            F.col("o_orderdate").alias("rated_at"),
        )

    def ownership(self) -> DataFrame:
        ident = [tag("", "l_orderkey"), tag("", "l_linenumber"), tag("", "l_suppkey")]
        return self.table("lineitem").select(
            F.concat_ws("-", *ident).alias("ubo_id"),
            tag("TP", "l_partkey").alias("entity_id"),
            tag("TP", "l_suppkey").alias("ubo_entity_id"),
            F.round(F.col("l_discount") * 1000, 2).alias("ownership_pct"),
            F.col("l_shipdate").alias("effective_from"),
        )

    def auth_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            tag("EV", "event_id").alias("event_id"),
            tag("ACC", "user_id").alias("account_id"),
            F.col("ts").alias("event_ts"),
            (kind == "error").alias("new_device"),
            (kind == "signup").alias("new_geo"),
            F.lit(False).alias("credential_change"),
            F.concat(F.lit("City "), F.regexp_extract("props", r"(\d+)", 1)).alias("geo_city"),
        )

    def cards(self) -> DataFrame:
        k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
        return self.table("events").select(
            tag("EV", "event_id").alias("card_txn_id"),
            tag("CARD", "user_id").alias("card_id"),
            tag("ACC", "user_id").alias("account_id"),
            F.col("value").alias("amount"),
            F.col("event_type").alias("merchant"),
            (k - 50).cast("double").alias("lat"),
            ((k * 37) % 360 - 180).cast("double").alias("lon"),
            F.concat(F.lit("City "), k.cast("string")).alias("city"),
            F.concat(F.lit("Country "), (k % 10).cast("string")).alias("country"),
            F.col("ts").alias("txn_ts"),
            F.col("ts").alias("_ingested_at"),
        )

    def media(self) -> DataFrame:
        """Articles; the named entities are the distinct words of the whole text."""
        words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
        return self.table("documents").select(
            tag("DOC", "doc_id").alias("article_id"),
            F.concat_ws(" ", F.lit("Article"), "lang", "source").alias("headline"),
            F.to_date(F.lit("2024-01-01")).alias("published_at"),
            "source",
            F.filter(words, lambda w: w != "").alias("named_entities"),
        )

    def media_parties(self, emap: DataFrame) -> DataFrame:
        """Parties named like the first word of each benchmark text; odd items are resolved customers."""
        customers = emap.filter(F.col("party_type") == "customer").select(
            F.col("source_id").alias("_customer"), F.col("entity_id").alias("_entity")
        )
        items = self.table("benchmark").withColumn("_is_customer", F.col("item_id") % 2 == 1)
        resolved = items.join(customers, F.col("_is_customer") & (tag("CUST", F.col("item_id") + 1) == F.col("_customer")), "left")
        return resolved.select(
            F.coalesce("_entity", tag("PUB", "item_id")).alias("entity_id"),
            F.coalesce("_customer", tag("TP", "item_id")).alias("source_id"),
            F.when(F.col("_customer").isNotNull(), "customer").otherwise("third_party").alias("party_type"),
            F.element_at(F.split(F.lower("text"), r"[^\p{L}]+"), 1).alias("full_name"),
        )

    # case side

    def cases(self) -> DataFrame:
        """Every order as a case: priority and amount from the order, rest by key arithmetic."""
        key = F.col("o_orderkey")
        level = F.substring("o_orderpriority", 1, 1).cast("int") - 1
        opened = F.to_date("o_orderdate")
        team, analyst = key % 4, key % 6
        return self.table("orders").select(
            tag("CASE-", key).alias("case_id"),
            key.alias("alert_num"),
            tag("CUST", "o_custkey").alias("customer_id"),
            F.format_string("Customer#%09d", "o_custkey").alias("customer_name"),
            _pick(key % 9, SCENARIOS).alias("scenario"),
            _pick(level, ["critical", "high", "medium", "low", "low"]).alias("priority"),
            _pick(key * 7 % 5, CASE_STATUSES).alias("status"),
            _pick(team, [t[0] for t in TEAMS]).alias("team_id"),
            _pick(team, [t[1] for t in TEAMS]).alias("team_name"),
            _pick(analyst, [a[0] for a in ANALYSTS]).alias("analyst_id"),
            _pick(analyst, [a[1] for a in ANALYSTS]).alias("analyst_name"),
            (F.lit(40) + key * 13 % 55).cast("int").alias("risk_score"),
            F.col("o_totalprice").alias("amount"),
            (key * 17 % 140).cast("int").alias("days_open"),
            F.date_add(opened, (key * 11 % 75).cast("int")).alias("due_date"),
            F.round(key * 7 % 90 / 10.0, 1).alias("investigation_hours"),
            F.col("o_orderdate").alias("opened_at"),
        )

    def case_moves(self) -> DataFrame:
        """Transition events; several users' events meet on one case."""
        kinds = {"view": "assigned", "signup": "in_progress", "purchase": "escalated",
                 "error": "closed", "click": "in_progress"}
        pairs = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
        return self.table("events").select(
            tag("CASE-", "user_id").alias("case_id"),
            F.col("ts").alias("event_ts"),
            tag("EV", "event_id").alias("event_id"),
            pairs[F.col("event_type")].alias("target"),
        )

    def assignments(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").select(
            tag("CASE-", "user_id").alias("case_id"),
            F.col("ts").alias("event_ts"),
            tag("EV", key).alias("event_id"),
            _pick(key % 6, [a[0] for a in ANALYSTS]).alias("analyst_id"),
            _pick(key % 6, [a[1] for a in ANALYSTS]).alias("analyst_name"),
            F.when(key % 3 == 0, _pick(key % 4, [t[0] for t in TEAMS])).otherwise("").alias("team_id"),
            F.when(key % 3 == 0, _pick(key % 4, [t[1] for t in TEAMS])).otherwise("").alias("team_name"),
        )

    def filings(self) -> DataFrame:
        """Orders as filings: filer by clerk arithmetic, approver sometimes equal or blank."""
        key = F.col("o_orderkey")
        filer = _pick(key % 6, [a[1] for a in ANALYSTS])
        approver = (
            F.when(key % 10 == 0, "  ").when(key % 10 == 1, F.concat(F.lit(" "), F.upper(filer)))
            .otherwise(_pick((key + 1) % 6, [a[1] for a in ANALYSTS]))
        )
        return self.table("orders").select(
            tag("SAR", key).alias("sar_id"), tag("CASE-", key).alias("case_id"),
            filer.alias("filed_by"), approver.alias("approved_by"),
        )

    def notes(self) -> DataFrame:
        return self.table("events").select(
            tag("NOTE", "event_id").alias("note_id"), tag("CASE-", "user_id").alias("case_id"),
            tag("U", "user_id").alias("author"), F.col("props").alias("note"),
            F.lit("analyst").alias("note_type"), F.col("ts").alias("created_at"),
        )

    def actions(self) -> DataFrame:
        return self.table("events").select(
            tag("ACT", "event_id").alias("action_id"), tag("CASE-", "user_id").alias("case_id"),
            F.col("event_type").alias("action"), F.col("props").alias("reason"),
            tag("U", "user_id").alias("actor"), F.col("ts").alias("created_at"),
        )

    def audit_log(self) -> DataFrame:
        return self.table("events").select(
            tag("EV", "event_id").alias("event_id"), F.col("ts").alias("event_ts"),
            tag("U", "user_id").alias("actor"), F.col("event_type").alias("action"),
            tag("CASE-", "user_id").alias("case_id"), F.col("props").alias("detail"),
            F.lit("app").alias("source"),
        )

    def feedback(self) -> DataFrame:
        """Analyst feedback on ownership alerts, derived from the line items."""
        kinds = ["confirmed", "dismissed", "reviewing"]
        return self.table("lineitem").select(
            F.concat_ws(
                "-", tag("FB", "l_orderkey"), tag("", "l_linenumber"), tag("", "l_partkey"), tag("", "l_suppkey")
            ).alias("feedback_id"),
            F.concat_ws(
                "-", F.lit("ALRT-UBO"), tag("TP", "l_partkey"), F.date_format("l_shipdate", "yyyyMMdd")
            ).alias("alert_id"),
            _pick(F.col("l_orderkey") % 3, kinds).alias("status"),
            F.lit("reviewed").alias("analyst_feedback"),
            _pick(F.col("l_orderkey") % 6, [a[0] for a in ANALYSTS]).alias("analyst"),
            F.col("l_shipdate").alias("created_at"),
        )

    def eval_inputs(self) -> DataFrame:
        """All documents as generated narratives with two judge scores; unlabelled ones score low."""
        return self.table("documents").join(self.table("labels"), "doc_id", "left").select(
            tag("EVAL", "doc_id").alias("eval_id"),
            "text",
            F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("groundedness"),
            F.when(F.col("quality") == 1, 0.9).otherwise(0.4).alias("completeness"),
        )

    def kyc_packs(self) -> DataFrame:
        """One KYC letter per customer, rendered from its attributes."""
        lines = F.concat_ws(
            "\n",
            F.lit("KYC source-of-funds letter"),
            F.concat(F.lit("Client Name: "), "full_name"),
            F.concat(F.lit("  National ID: "), F.nullif(F.col("national_id"), F.lit(""))),
            F.concat(F.lit("Tax_Number: "), "tax_number"),
            F.concat(F.lit("Source of Funds: "), "segment", F.lit(" trade")),
            F.concat(F.lit("PEP Status:  "), F.when(F.col("pep_flag"), "yes").otherwise("no")),
            F.concat(F.lit("Jurisdictions: "), "country", F.lit(", "), "city"),
        )
        return self.customers().select("customer_id", lines.alias("doc_text"))
