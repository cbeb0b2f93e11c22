"""Registered queries: sources, sinks, conforming, quality, entities, detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.config import AlertConfig, SkewPolicy
from lakewarden.functions import clock
from lakewarden.operators import entities as er
from lakewarden.operators.conform import conform_cards, conform_passthrough, conform_transactions
from lakewarden.operators.quality import RULES, Rule, dq_report, enforce
from lakewarden.operators.rings import best_rings
from lakewarden.operators.screening import screen_names, screening_list, screening_summary
from lakewarden.plans import detectors
from lakewarden.plans.medallion import AS_OF_LEDGER, EVENT_CFG, RAPID_HOURS, RING
from lakewarden.session import scratch_path
from lakewarden.sources import tables
from lakewarden.suite.parts import D0, T0, ts
from lakewarden.suite.registry import query


def tstr(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def flat(alerts: DataFrame, explanation: bool = True) -> DataFrame:
    """Alert rows with arrays as text, comparable across engines."""
    text = [F.col("explanation")] if explanation else []
    return alerts.select(
        "alert_id", "alert_type", "severity", "primary_entity_id",
        F.array_join("related_entity_ids", ",").alias("related_ids"),
        F.array_join("account_ids", ",").alias("account_ids"),
        F.coalesce(F.array_join("transaction_ids", ","), F.lit("")).alias("txn_ids"),
        tstr("triggered_at").alias("triggered_at"),
        F.round("score", 4).alias("score"),
        *text,
    )


def flat_sql(source: str, explanation: bool = True) -> str:
    text = ", explanation" if explanation else ""
    return f"""SELECT alert_id, alert_type, severity, primary_entity_id, related_ids, account_ids,
  txn_ids, {ts('triggered_at')} AS triggered_at, round(score, 4) AS score{text} FROM {source}"""


# -- sources and sinks ---------------------------------------------------------


@query("typed_table_scan", """
SELECT direction, channel, count(*) AS txns, round(sum(amount), 2) AS total FROM ledger GROUP BY 1, 2""")
def _(lake):
    root = scratch_path(lake.spark, "typed")
    tables.write_overwrite(lake.ledger, f"{root}/transactions", ["direction"])
    return tables.read_table(lake.spark, root, "transactions").groupBy("direction", "channel").agg(
        F.count("*").alias("txns"), F.round(F.sum("amount"), 2).alias("total")
    )


@query("landed_documents", """
SELECT doc_id, md5(coalesce(text, '') || chr(10)) AS content_md5 FROM documents""")
def _(lake):
    """Every document becomes a text file and is read back whole."""
    path = scratch_path(lake.spark, "landed")
    tables.land_documents(lake.roles.table("documents"), path, "doc_id", "text")
    found = tables.read_documents(lake.spark, f"{path}/*")
    return found.select(
        F.regexp_extract("file_path", "doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id"),
        F.md5("doc_text").alias("content_md5"),
    )


@query("alert_config_relation", """
SELECT account_id, count(*) AS near_limit, round(sum(amount), 2) AS total FROM ledger
WHERE direction = 'credit' AND amount >= 25000 * 0.75 AND amount < 25000 GROUP BY 1""")
def _(lake):
    """Thresholds tuned in SQL: the one-row relation meets the ledger on its limits."""
    cfg = F.broadcast(AlertConfig().to_df(lake.spark).select("ctr_threshold", "struct_min_ratio"))
    near = (F.col("amount") >= F.col("ctr_threshold") * F.col("struct_min_ratio")) & (F.col("amount") < F.col("ctr_threshold"))
    return lake.ledger.filter(F.col("direction") == "credit").join(cfg, near).groupBy("account_id").agg(
        F.count("*").alias("near_limit"), F.round(F.sum("amount"), 2).alias("total")
    )


@query("calendar_range", f"""
SELECT CAST(c.d AS VARCHAR) AS day, coalesce(l.n, 0) AS txns
FROM (SELECT {D0} - CAST(i AS INTEGER) AS d FROM range(0, 400) r(i)) c
LEFT JOIN (SELECT CAST(txn_ts AS DATE) AS d, count(*) AS n FROM ledger GROUP BY 1) l USING (d)""")
def _(lake):
    days = tables.number_range(lake.spark, 0, 400).select(
        F.date_sub(clock.day(AS_OF_LEDGER), F.col("id").cast("int")).alias("d")
    )
    counts = lake.ledger.groupBy(F.to_date("txn_ts").alias("d")).agg(F.count("*").alias("n"))
    return days.join(counts, "d", "left").select(
        F.col("d").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("txns")
    )


@query("append_event_log", """
SELECT action, count(*) AS events FROM (
  SELECT event_type AS action FROM events UNION ALL SELECT event_type FROM events) GROUP BY 1""")
def _(lake):
    path = scratch_path(lake.spark, "log")
    for _run in range(2):
        tables.append_events(lake.roles.audit_log(), path)
    return lake.spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("events"))


@query("slice_replacement", """
SELECT status, priority, count(*) AS cases FROM (
  SELECT CASE WHEN status = 'new' THEN 'assigned' ELSE status END AS status, priority FROM cases) GROUP BY 1, 2""")
def _(lake):
    cases = lake.roles.cases()
    family = F.col("status") == "new"
    fresh = cases.filter(family).withColumn("status", F.lit("assigned"))
    return tables.replace_slice(cases, family, fresh).groupBy("status", "priority").agg(
        F.count("*").alias("cases")
    )


@query("keep_newest_of_family", f"""
SELECT case_id, status, {ts('opened_at')} AS opened_at FROM cases
WHERE status <> 'new' OR case_id IN (
  SELECT case_id FROM cases WHERE status = 'new' ORDER BY opened_at DESC, case_id LIMIT 2)""")
def _(lake):
    kept = tables.keep_latest_n(
        lake.roles.cases(), F.col("status") == "new", "case_id",
        [F.desc("opened_at"), F.col("case_id")], 2,
    )
    return kept.select("case_id", "status", tstr("opened_at").alias("opened_at"))


# -- conforming and quality ----------------------------------------------------

_LEDGER_COLS = ["transaction_id", "account_id", "counterparty_id", "direction", "channel",
                "merchant_category"]
_LEDGER_SQL = f"""SELECT {', '.join(_LEDGER_COLS)}, amount, {ts('txn_ts')} AS txn_ts FROM ledger"""


@query("dedupe_newest_ingest", _LEDGER_SQL)
def _(lake):
    df = conform_transactions(lake.roles.transactions())
    return df.select(*_LEDGER_COLS, "amount", tstr("txn_ts").alias("txn_ts"))


@query("batch_and_stream_feed", _LEDGER_SQL)
def _(lake):
    raw = lake.roles.transactions()
    late = F.col("_ingested_at") >= clock.at("1999-01-01")
    df = conform_transactions(raw.filter(~late), raw.filter(late).withColumn("_lane", F.lit("json")))
    return df.select(*_LEDGER_COLS, "amount", tstr("txn_ts").alias("txn_ts"))


@query("conform_card_taps", f"""
SELECT card_txn_id, card_id, city, country, lat, lon, amount, {ts('txn_ts')} AS txn_ts FROM cards""")
def _(lake):
    cards = lake.roles.cards()
    return conform_cards(cards, cards).select(
        "card_txn_id", "card_id", "city", "country", "lat", "lon", "amount",
        tstr("txn_ts").alias("txn_ts"),
    )


@query("conform_passthrough", f"""
SELECT entity_id, ubo_entity_id, ownership_pct, {ts('effective_from')} AS effective_from FROM ownership""")
def _(lake):
    df = conform_passthrough(
        lake.roles.ownership(), ["entity_id", "ubo_entity_id", "ownership_pct", "effective_from"]
    )
    return df.withColumn("effective_from", tstr("effective_from"))


@query("conform_passthrough_ratings", f"SELECT entity_id, risk_rating, {ts('rated_at')} AS rated_at FROM ratings")
def _(lake):
    df = conform_passthrough(lake.roles.risk_ratings(), ["entity_id", "risk_rating", "rated_at"])
    return df.withColumn("rated_at", tstr("rated_at"))


@query("conform_passthrough_logins", f"""
SELECT event_id, account_id, {ts('event_ts')} AS event_ts, new_device, new_geo, geo_city FROM auth""")
def _(lake):
    df = conform_passthrough(lake.roles.auth_events(), ["event_id", "account_id", "event_ts", "new_device", "new_geo", "geo_city"])
    return df.withColumn("event_ts", tstr("event_ts"))


@query("conform_passthrough_media", f"SELECT article_id, headline, source, {ts('published_at')} AS published_at FROM media")
def _(lake):
    df = conform_passthrough(lake.roles.media(), ["article_id", "headline", "source", "published_at"])
    return df.withColumn("published_at", tstr("published_at"))


def _dq_sql(dataset: str, table: str, rules: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{dataset}' AS dataset, '{r}' AS rule, count(*) AS total_rows,
  count(*) FILTER (NOT coalesce({c}, false)) AS violations,
  round(1 - count(*) FILTER (NOT coalesce({c}, false)) / CAST(count(*) AS DOUBLE), 4) AS pass_rate FROM {table}"""
        for r, c in rules.items()
    )


@query("quality_report", " UNION ALL ".join([
    _dq_sql("risk_ratings", "ratings", {
        "valid_entity_id": "entity_id IS NOT NULL", "valid_rating": "risk_rating BETWEEN 2 AND 5"}),
    _dq_sql("beneficial_ownership", "ownership", {
        "valid_entity_id": "entity_id IS NOT NULL",
        "valid_ownership": "ownership_pct IS NULL OR ownership_pct BETWEEN 0 AND 50"}),
]))
def _(lake):
    strict = Rule("valid_rating", "risk_rating BETWEEN 2 AND 5")
    owned = Rule("valid_ownership", "ownership_pct IS NULL OR ownership_pct BETWEEN 0 AND 50")
    known = Rule("valid_entity_id", "entity_id IS NOT NULL")
    return dq_report(lake.roles.risk_ratings(), "risk_ratings", (known, strict)).unionByName(
        dq_report(lake.roles.ownership(), "beneficial_ownership", (known, owned))
    )


_DECLARED = {
    "customers": "cust", "accounts": "acct", "third_parties": "tparty", "transactions": "ledger", "card_transactions": "cards",
    "risk_ratings": "ratings", "beneficial_ownership": "ownership", "auth_events": "auth", "adverse_media": "media",
    "entities": "entities", "entity_map": "emap", "alerts": "alerts",
}


@query("quality_report_declared", " UNION ALL ".join(
    _dq_sql(dataset, _DECLARED[dataset], {r.name: r.check for r in rules}) for dataset, rules in RULES.items()
))
def _(lake):
    """The declared rules over all twelve tables."""
    r = lake.roles
    frames = {
        "customers": r.customers(), "accounts": r.accounts(), "third_parties": r.third_parties(), "transactions": lake.ledger,
        "card_transactions": r.cards(), "risk_ratings": r.risk_ratings(), "beneficial_ownership": r.ownership(),
        "auth_events": r.auth_events(), "adverse_media": r.media(), "entities": lake.entities, "entity_map": lake.emap, "alerts": lake.alerts,
    }
    return reduce(lambda a, b: a.unionByName(b), (dq_report(frames[d], d) for d in RULES))


@query("quality_drop_rows", """
SELECT direction, count(*) AS txns FROM ledger WHERE amount >= 1000 AND counterparty_id IS NOT NULL GROUP BY 1""")
def _(lake):
    rules = (
        Rule("material", "amount >= 1000", drop=True),
        Rule("has_party", "counterparty_id IS NOT NULL", drop=True),
        Rule("warn_only", "amount < 0"),
    )
    return enforce(lake.ledger, rules).groupBy("direction").agg(F.count("*").alias("txns"))


# -- entity resolution ---------------------------------------------------------


@query("party_union", """
SELECT source_id, party_type, full_name, national_id, tax_number, city, country,
  CAST(dob AS VARCHAR) AS dob FROM keyed""")
def _(lake):
    df = er.parties(lake.roles.customers(), lake.roles.third_parties())
    return df.withColumn("dob", F.col("dob").cast("string"))


@query("party_cluster_keys", "SELECT source_id, party_type, cluster_key FROM keyed")
def _(lake):
    df = er.cluster_key(er.parties(lake.roles.customers(), lake.roles.third_parties()))
    return df.select("source_id", "party_type", "cluster_key")


_ENTITY_SQL = """SELECT entity_id, source_id, party_type, full_name, cluster_key, cluster_size FROM entities"""


@query("entity_resolution", _ENTITY_SQL)
def _(lake):
    df = er.resolve_entities(lake.roles.customers(), lake.roles.third_parties())
    return df.select("entity_id", "source_id", "party_type", "full_name", "cluster_key", "cluster_size")


@query("entity_resolution_hot_clusters", _ENTITY_SQL)
def _(lake):
    """The path for oversized clusters, forced by a low threshold."""
    df = er.resolve_entities(
        lake.roles.customers(), lake.roles.third_parties(), policy=SkewPolicy(hot_rows=10)
    )
    return df.select("entity_id", "source_id", "party_type", "full_name", "cluster_key", "cluster_size")


@query("entity_map", "SELECT source_id, party_type, entity_id, cluster_size FROM emap")
def _(lake):
    return lake.emap


# -- detectors -----------------------------------------------------------------


@query("rapid_movement", flat_sql("a_rapid", False))
def _(lake):
    return flat(lake.rapid_movement(), False)


@query("frequency_change", flat_sql("a_freq", False))
def _(lake):
    return flat(lake.frequency_change(), False)


@query("circular_flow", flat_sql("a_ring", False))
def _(lake):
    return flat(lake.circular_flow(), False)


@query("circular_flow_detail", """
SELECT origin, path, CAST(depth AS BIGINT) AS hops, round(total, 2) AS total FROM rings""")
def _(lake):
    rings = best_rings(detectors.material_transfers(lake.ledger, AS_OF_LEDGER, RING))
    return rings.select(
        "origin", F.array_join("path", ",").alias("path"), F.col("depth").cast("bigint").alias("hops"),
        F.round("total", 2).alias("total"),
    )


@query("dormant_reactivation", flat_sql("a_dormant"))
def _(lake):
    return flat(lake.dormant())


@query("risk_rating_change", flat_sql("a_rating"))
def _(lake):
    return flat(lake.risk_rating_change())


@query("adverse_media", flat_sql("a_media"))
def _(lake):
    return flat(lake.adverse_media())


@query("ubo_change", flat_sql("a_ubo"))
def _(lake):
    return flat(lake.ubo_change())


@query("ubo_change_hot_keys", flat_sql("a_ubo"))
def _(lake):
    """The time-sliced path for oversized keys, forced by a low threshold."""
    policy = SkewPolicy(hot_rows=20, slice_rows=5)
    return flat(detectors.detect_ubo_change(lake.roles.ownership(), lake.emap, policy))


@query("account_takeover", flat_sql("a_ato"))
def _(lake):
    return flat(lake.account_takeover())


@query("takeover_drains", f"""
SELECT account_id, transaction_id, amount, {ts('txn_ts')} AS txn_ts, {ts('anomaly_ts')} AS anomaly_ts, geo_city
FROM drains""")
def _(lake):
    df = detectors.takeover_drains(lake.roles.auth_events(), lake.roles.event_ledger(), EVENT_CFG)
    return df.withColumns({c: tstr(c) for c in ("txn_ts", "anomaly_ts")})


@query("impossible_travel", flat_sql("a_travel"))
def _(lake):
    return flat(lake.impossible_travel())


@query("structuring", flat_sql("a_struct", False))
def _(lake):
    return flat(lake.structuring(), False)


@query("fraud_alerts", flat_sql("alerts", False))
def _(lake):
    return flat(lake.alerts, False)


@query("alert_entity_attribution", """
SELECT l.account_id, x.customer_id, x.entity_id, count(*) AS txns
FROM event_ledger l LEFT JOIN acct_entity x USING (account_id) GROUP BY ALL""")
def _(lake):
    per_account = lake.roles.event_ledger().groupBy("account_id").agg(F.count("*").alias("txns"))
    return detectors.attach_entity(per_account, lake.roles.accounts(), lake.emap).select(
        "account_id", "customer_id", "entity_id", "txns"
    )


@query("alert_transactions", f"""
SELECT 'ALRT-RM-' || account_id AS alert_id, transaction_id FROM ledger
WHERE txn_ts BETWEEN {T0} - INTERVAL {RAPID_HOURS} HOUR AND {T0}
  AND account_id IN (SELECT account_ids FROM a_rapid)""")
def _(lake):
    events = detectors.rapid_events(lake.ledger, AS_OF_LEDGER, RAPID_HOURS)
    return detectors.alert_transactions(lake.rapid_movement(), events)


@query("alert_explanations", """
SELECT alert_id, explanation FROM a_dormant UNION ALL SELECT alert_id, explanation FROM a_rating
UNION ALL SELECT alert_id, explanation FROM a_ubo""")
def _(lake):
    kinds = ["dormant_reactivation", "risk_rating_change", "ubo_change"]
    return lake.alerts.filter(F.col("alert_type").isin(kinds)).select("alert_id", "explanation")


# -- screening -----------------------------------------------------------------

_HIT_COLS = ["screening_id", "entity_id", "source_id", "party_type", "entity_name", "entity_country",
             "watchlist_id", "watch_name", "list_type", "list_source", "reason", "severity",
             "match_score", "exact_match", "confidence"]
_HITS_SQL = f"SELECT {', '.join(_HIT_COLS)} FROM hits"


@query("watchlist_screening", _HITS_SQL)
def _(lake):
    return screen_names(lake.entities, lake.watchlist())


@query("watchlist_screening_long_list", _HITS_SQL)
def _(lake):
    """The piece join for lists beyond the broadcast bound, forced by a bound of one row."""
    return screen_names(lake.entities, lake.watchlist(), small_list_rows=1)


@query("screening_list", """
SELECT screening_id, source_id, entity_name, watch_name, confidence, match_score FROM hits
WHERE confidence <> 'confirmed' ORDER BY CASE confidence WHEN 'confirmed' THEN 0 WHEN 'probable' THEN 1 ELSE 2 END,
  match_score DESC, screening_id, source_id LIMIT 100""")
def _(lake):
    others = lake.hits.filter(F.col("confidence") != "confirmed")
    return screening_list(others).select(
        "screening_id", "source_id", "entity_name", "watch_name", "confidence", "match_score"
    )


@query("screening_summary", "SELECT list_type, confidence, count(*) AS hits FROM hits GROUP BY 1, 2")
def _(lake):
    return screening_summary(lake.hits)
