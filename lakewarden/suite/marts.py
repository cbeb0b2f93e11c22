"""Registered queries: customer marts, graph, alert queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewarden.plans import alerts as aq
from lakewarden.plans import graph, risk
from lakewarden.plans.medallion import AS_OF_EVENTS, AS_OF_LEDGER
from lakewarden.suite.foundation import tstr
from lakewarden.suite.parts import T0, tag, ts
from lakewarden.suite.registry import part, query

TE = f"TIMESTAMP '{AS_OF_EVENTS}'"

# -- customer marts ------------------------------------------------------------


@query("turnover_ratio", """
SELECT customer_id, declared_monthly_turnover, round(actual_monthly_turnover, 2) AS actual_monthly_turnover,
  turnover_ratio FROM c360""")
def _(lake):
    r = lake.roles
    df = risk.turnover_ratio(r.customers(), lake.ledger, r.accounts(), AS_OF_LEDGER)
    return df.withColumn("actual_monthly_turnover", F.round("actual_monthly_turnover", 2))


_C360 = ["customer_id", "full_name", "segment", "city", "country", "pep_flag", "entity_id",
         "num_accounts", "current_risk_rating", "recent_alerts", "declared_monthly_turnover"]


@query("customer_360", f"""
SELECT {', '.join(_C360)}, round(total_balance, 2) AS total_balance,
  round(actual_monthly_turnover, 2) AS actual_monthly_turnover FROM c360""")
def _(lake):
    r = lake.roles
    df = risk.customer_360(
        r.customers(), r.accounts(), r.risk_ratings(), lake.ledger, lake.alerts, lake.emap, AS_OF_LEDGER
    )
    return df.select(
        *_C360, F.round("total_balance", 2).alias("total_balance"),
        F.round("actual_monthly_turnover", 2).alias("actual_monthly_turnover"),
    )


@query("customers_list", """
SELECT customer_id, entity_id, num_accounts, round(total_balance, 2) AS total_balance, current_risk_rating, recent_alerts
FROM c360 WHERE recent_alerts >= 1 ORDER BY c360.recent_alerts DESC, c360.total_balance DESC, customer_id LIMIT 100""")
def _(lake):
    df = risk.customers_list(lake.c360, min_alerts=1)
    return df.select(
        "customer_id", "entity_id", "num_accounts", F.round("total_balance", 2).alias("total_balance"),
        "current_risk_rating", "recent_alerts",
    )


@query("customer_pack_alerts", f"""
SELECT x.customer_id, a.alert_id, a.alert_type, a.severity, {ts('a.triggered_at')} AS triggered_at,
  round(a.score, 4) AS score FROM c360 x JOIN alerts a ON a.primary_entity_id = x.entity_id""")
def _(lake):
    # formatted once for each alert, not for each customer of its entity
    shown = lake.alerts.withColumns({"triggered_at": tstr("triggered_at"), "score": F.round("score", 4)})
    pack = risk.customer_pack(lake.c360, shown, lake.media_evidence())
    return pack["alerts"].select("customer_id", "alert_id", "alert_type", "severity", "triggered_at", "score")


@query("customer_pack_media", f"""
SELECT x.customer_id, m.headline, m.source, {ts('m.published_at')} AS published_at
FROM c360 x JOIN media_evidence m ON m.entity_id = x.entity_id""")
def _(lake):
    # formatted once for each article, not for each customer of its entity
    shown = lake._saved("media-evidence", lambda: lake.media_evidence().withColumn("published_at", tstr("published_at")))
    pack = risk.customer_pack(lake.c360, lake.alerts, shown)
    return pack["adverse_media"].select("customer_id", "headline", "source", "published_at")


_PKYC = ["customer_id", "entity_id", "alert_count", "severe_alerts", "sanction_hits", "media_hits",
         "has_dormant", "dynamic_risk", "risk_band", "edd_review_required"]


@query("pkyc_customer_risk", f"SELECT {', '.join(_PKYC)} FROM pkyc")
def _(lake):
    r = lake.roles
    df = risk.pkyc_customer_risk(
        r.customers(), r.accounts(), lake.ledger, lake.alerts, lake.hits, lake.media_evidence(),
        lake.emap, AS_OF_LEDGER,
    )
    return df.select(*_PKYC)


@query("pkyc_risk_drivers", """
SELECT customer_id, concat_ws('; ',
  CASE WHEN severe_alerts > 0 THEN severe_alerts || ' severe alerts' END,
  CASE WHEN sanction_hits > 0 THEN 'sanctions/watchlist hit' END,
  CASE WHEN media_hits > 0 THEN media_hits || ' adverse-media hits' END,
  CASE WHEN coalesce(declared_monthly_turnover, 0) > 0 AND turnover_ratio >= 1.5
       THEN 'turnover ' || printf('%.1f', turnover_ratio) || 'x declared' END,
  CASE WHEN pep_flag THEN 'PEP' END, CASE WHEN has_dormant = 1 THEN 'dormant account' END,
  CASE WHEN total_balance > 5000000 THEN 'high balance exposure' END) AS risk_drivers FROM pkyc""")
def _(lake):
    return lake.pkyc.select("customer_id", "risk_drivers")


@query("pkyc_summary", """
SELECT risk_band, count(*) AS customers, count(*) FILTER (edd_review_required) AS edd_required FROM pkyc GROUP BY 1""")
def _(lake):
    return risk.pkyc_summary(lake.pkyc)


@query("pkyc_list", """
SELECT customer_id, dynamic_risk, risk_band, alert_count, severe_alerts FROM pkyc
WHERE dynamic_risk >= 20 ORDER BY dynamic_risk DESC, customer_id LIMIT 100""")
def _(lake):
    return risk.pkyc_list(lake.pkyc, 20).select(
        "customer_id", "dynamic_risk", "risk_band", "alert_count", "severe_alerts"
    )


@query("customer_behaviour", """
SELECT customer_id, txn_count, round(total_value, 2) AS total_value, round(avg_value, 3) AS avg_value, distinct_cps
FROM behaviour""")
def _(lake):
    df = risk.customer_behaviour(lake.roles.accounts(), lake.ledger, AS_OF_LEDGER)
    return df.withColumns(
        {"total_value": F.round("total_value", 2), "avg_value": F.round("avg_value", 3)}
    )


@query("peer_anomaly", """
SELECT customer_id, segment, txn_count, round(total_value, 2) AS total_value, distinct_cps,
  round(m_cnt, 1) AS peer_avg_txns, round(z_cnt, 2) AS z_txn_count, round(z_val, 2) AS z_total_value,
  round(z_cp, 2) AS z_distinct_cps, anomaly_score,
  CASE WHEN greatest(abs(z_cnt), abs(z_val), abs(z_cp)) >= 4 THEN 'critical'
       WHEN greatest(abs(z_cnt), abs(z_val), abs(z_cp)) >= 3 THEN 'high' ELSE 'medium' END AS severity
FROM anomalies""")
def _(lake):
    return lake.anomalies().select(
        "customer_id", "segment", "txn_count", F.round("total_value", 2).alias("total_value"),
        "distinct_cps", "peer_avg_txns", "z_txn_count", "z_total_value", "z_distinct_cps",
        "anomaly_score", "severity",
    )


@query("anomaly_list", """
SELECT customer_id, anomaly_score FROM anomalies ORDER BY anomaly_score DESC, customer_id LIMIT 5""")
def _(lake):
    return risk.anomaly_list(lake.anomalies(), 5).select("customer_id", "anomaly_score")


part("typology", """
SELECT g.*, a.customer_id, c.full_name, c.segment, c.declared_monthly_turnover,
  a.customer_id NOT IN (SELECT x.customer_id FROM alerts s JOIN cust_entity x ON x.entity_id = s.primary_entity_id) AS never_alerted
FROM (SELECT account_id, sum(CASE WHEN direction = 'debit' THEN amount ELSE 0 END) AS o,
    sum(CASE WHEN direction = 'credit' THEN amount ELSE 0 END) AS i, count(*) AS n
  FROM ledger WHERE merchant_category = 'gaming' GROUP BY 1) g
JOIN acct a USING (account_id) JOIN cust c ON c.customer_id = a.customer_id
WHERE n >= 10 AND i / nullif(o, 0) >= 0.3""")


@query("typology_exposure", """
SELECT 'tpp_gaming_layering' AS typology, customer_id, account_id, segment, declared_monthly_turnover,
  round(o, 2) AS gaming_out, round(i, 2) AS gaming_in, n AS gaming_txns, round(i / nullif(o, 0), 3) AS roundtrip_ratio,
  round(abs(o - i), 2) AS net_flow, never_alerted FROM typology""")
def _(lake):
    return lake.typology().drop("full_name", "explanation")


@query("typology_list", """
SELECT account_id, round(o, 2) AS gaming_out, never_alerted FROM typology ORDER BY o DESC, account_id LIMIT 25""")
def _(lake):
    return risk.typology_list(lake.typology(), limit=25).select("account_id", "gaming_out", "never_alerted")


# -- graph ---------------------------------------------------------------------

part("edges", f"""
SELECT entity_id AS source_entity_id, 'ACCT:' || account_id AS target_entity_id, 'owns_account' AS edge_type,
  CAST(1 AS DOUBLE) AS weight, account_type AS evidence FROM acct_entity JOIN acct USING (account_id) WHERE entity_id IS NOT NULL
UNION ALL
SELECT 'ACCT:' || from_acct, 'ACCT:' || to_acct, 'transacts_with', CAST(count(*) AS DOUBLE), '' FROM ledger
WHERE from_acct <> to_acct AND txn_ts BETWEEN {T0} - INTERVAL 30 DAY AND {T0} GROUP BY from_acct, to_acct
UNION ALL
SELECT f.entity_id, coalesce(g.entity_id, o.ubo_entity_id), 'beneficial_owner',
  o.ownership_pct / CAST(100 AS DOUBLE), {ts('o.effective_from')}
FROM ownership o LEFT JOIN firm_entity f ON f.source_id = o.entity_id
LEFT JOIN firm_entity g ON g.source_id = o.ubo_entity_id""")
part("egos", "SELECT DISTINCT entity_id AS ego FROM acct_entity WHERE entity_id IS NOT NULL")
part("ego_edges", """
SELECT * EXCLUDE (rn) FROM (
  SELECT ego, source_entity_id, target_entity_id, edge_type, weight, row_number() OVER (PARTITION BY ego
    ORDER BY source_entity_id NULLS FIRST, target_entity_id NULLS FIRST, edge_type, weight) AS rn
  FROM egos JOIN edges ON source_entity_id = ego OR target_entity_id = ego) WHERE rn <= 200""")


def _edges(lake):
    r = lake.roles
    return graph.entity_network(r.accounts(), lake.ledger, r.ownership(), lake.emap, AS_OF_LEDGER)


def _ego(lake):
    egos = (
        lake.roles.accounts().select("customer_id").distinct()
        .join(risk.customer_entities(lake.emap), "customer_id")
        .select(F.col("entity_id").alias("ego")).distinct()
    )
    return graph.ego_edges(_edges(lake), egos)


@query("entity_network", """
SELECT source_entity_id, target_entity_id, edge_type, round(weight, 4) AS weight, evidence FROM edges""")
def _(lake):
    first = F.map_values("evidence")[0]
    return _edges(lake).select(
        "source_entity_id", "target_entity_id", "edge_type", F.round("weight", 4).alias("weight"),
        F.when(F.col("edge_type") == "transacts_with", "").otherwise(first).alias("evidence"),
    )


@query("ego_network_edges", "SELECT ego, source_entity_id, target_entity_id, edge_type, round(weight, 4) AS weight FROM ego_edges")
def _(lake):
    return _ego(lake).withColumn("weight", F.round("weight", 4))


@query("ego_network_nodes", """
SELECT n.ego, n.id, coalesce(l.name, n.id) AS label,
  coalesce(l.kind, CASE WHEN starts_with(n.id, 'ACCT:') THEN 'account' ELSE 'other' END) AS kind
FROM (SELECT ego, source_entity_id AS id FROM ego_edges UNION SELECT ego, target_entity_id FROM ego_edges) n
LEFT JOIN (SELECT entity_id AS id, max(full_name) AS name, max(party_type) AS kind FROM entities GROUP BY 1) l USING (id)
WHERE n.id IS NOT NULL""")
def _(lake):
    return graph.ego_nodes(_ego(lake), lake.entities)


part("seed_hits", """
SELECT customer_id FROM cust WHERE contains(lower(full_name), 'ring') OR contains(lower(address), 'ring')
UNION SELECT customer_id FROM cases WHERE contains(lower(scenario), 'ring')
UNION SELECT acct.customer_id FROM tparty JOIN ledger ON counterparty_id = third_party_id JOIN acct USING (account_id)
  WHERE contains(lower(tparty.full_name), 'ring')""")
part("seeds", """
WITH best AS (SELECT customer_id, max(risk_score) AS max_score FROM cases GROUP BY customer_id)
SELECT best.customer_id, cust.full_name, cust.city, cust.country, coalesce(c360.current_risk_rating, 3) AS risk, max_score,
  CAST(seed_hits.customer_id IS NOT NULL AS INTEGER) AS is_match
FROM best JOIN cust USING (customer_id) LEFT JOIN c360 USING (customer_id) LEFT JOIN seed_hits USING (customer_id)
ORDER BY is_match DESC, max_score DESC, best.customer_id LIMIT 12""")


def _seeds(lake):
    r = lake.roles
    return graph.graph_seeds(
        r.cases(), r.customers(), lake.c360, r.accounts(), lake.ledger, r.third_parties(), "ring items"
    )


@query("graph_seeds", "SELECT * FROM seeds")
def _(lake):
    return _seeds(lake)


part("relation_rows", """
SELECT acct.customer_id, acct.account_id, ledger.counterparty_id FROM acct LEFT JOIN ledger ON ledger.account_id = acct.account_id
QUALIFY row_number() OVER (PARTITION BY acct.customer_id ORDER BY acct.account_id, ledger.counterparty_id NULLS FIRST) <= 12""")


@query("graph_relations", """
SELECT customer_id, account_id, counterparty_id, (SELECT any_value(full_name) FROM tparty WHERE third_party_id = counterparty_id) AS cp_name
FROM relation_rows""")
def _(lake):
    r = lake.roles
    return graph.graph_rels(r.customers(), r.accounts(), lake.ledger, r.third_parties())


@query("travel_legs", f"""
SELECT h.alert_id, l.leg_order, l.city, l.country, l.lat, l.lon, l.leg_ts AS txn_ts, l.merchant FROM (
  SELECT a.alert_id, p.* FROM a_travel a JOIN tap_pairs p ON p.account_id = a.account_ids
    AND p.prev_txn_ts IS NOT NULL AND date_trunc('second', p.txn_ts) = date_trunc('second', a.triggered_at)) h,
LATERAL (SELECT 0 AS leg_order, h.city, h.country, h.lat, h.lon, {ts('h.txn_ts')} AS leg_ts, h.merchant
  UNION ALL SELECT 1, h.prev_city, h.prev_country, h.prev_lat, h.prev_lon, {ts('h.prev_txn_ts')}, h.prev_merchant) l""")
def _(lake):
    return graph.travel_legs(lake.alerts, lake.roles.cards()).withColumn("txn_ts", tstr("txn_ts"))


@query("adverse_media_evidence", """
SELECT entity_id, full_name, party_type, article_id, headline, source FROM media_evidence""")
def _(lake):
    return lake.media_evidence().select(
        "entity_id", "full_name", "party_type", "article_id", "headline", "source"
    )


# -- alert queue ---------------------------------------------------------------

part("feedback", f"""
SELECT {tag('FB', 'l_orderkey')} || {tag('-', 'l_linenumber')} || {tag('-', 'l_partkey')} || {tag('-', 'l_suppkey')} AS feedback_id,
  {tag('ALRT-UBO-TP', 'l_partkey')} || '-' || strftime(l_shipdate, '%Y%m%d') AS alert_id,
  list_extract(['confirmed', 'dismissed', 'reviewing'], l_orderkey % 3 + 1) AS status, l_shipdate AS created_at
FROM lineitem""")
part("effective", """
SELECT a.* , coalesce(f.status, 'new') AS status FROM alerts a LEFT JOIN (
  SELECT alert_id, status FROM (SELECT *, row_number() OVER (PARTITION BY alert_id
    ORDER BY created_at DESC, feedback_id DESC) AS rn FROM feedback) WHERE rn = 1) f USING (alert_id)""")


@query("effective_alert_status", "SELECT alert_type, status, count(*) AS alerts FROM effective GROUP BY 1, 2")
def _(lake):
    df = aq.effective_status(lake.alerts, lake.roles.feedback())
    return df.groupBy("alert_type", "status").agg(F.count("*").alias("alerts"))


@query("alert_queue", f"""
SELECT alert_id, alert_type, severity, primary_entity_id, {ts('triggered_at')} AS triggered_at, status
FROM (SELECT * FROM effective WHERE status = 'confirmed'
  ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END,
    triggered_at DESC, alert_id LIMIT 200)""")
def _(lake):
    df = aq.alert_queue(lake.alerts, lake.roles.feedback(), status="confirmed")
    return df.select(
        "alert_id", "alert_type", "severity", "primary_entity_id",
        tstr("triggered_at").alias("triggered_at"), "status",
    )


@query("alert_summary", """
SELECT alert_type, count(*) AS cnt, count(*) FILTER (severity = 'critical') AS critical,
  count(DISTINCT primary_entity_id) AS entities, grouping(alert_type) = 1 AS is_total FROM alerts GROUP BY ROLLUP (alert_type)""")
def _(lake):
    return aq.alert_summary(lake.alerts)


@query("alert_history", """
SELECT e.alert_id, e.status, coalesce(h.n, 0) AS entries, h.trail FROM effective e
LEFT JOIN (SELECT alert_id, count(*) AS n, string_agg(status, ',' ORDER BY created_at DESC, feedback_id DESC) AS trail FROM (
  SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY created_at DESC, feedback_id DESC) AS rn FROM feedback)
  WHERE rn <= 5 GROUP BY 1) h USING (alert_id)""")
def _(lake):
    df = aq.alert_history(lake.alerts, lake.roles.feedback())
    trail = F.array_join(F.transform("feedback_history", lambda f: f["status"]), ",")
    return df.select(
        "alert_id", "status",
        F.coalesce(F.size("feedback_history").cast("bigint"), F.lit(0)).alias("entries"), trail.alias("trail"),
    )


@query("high_severity_feed", """
SELECT alert_id, alert_type, severity, '/alerts/' || alert_id AS app_link FROM alerts WHERE severity IN ('high', 'critical')""")
def _(lake):
    return aq.high_severity_feed(lake.alerts).select("alert_id", "alert_type", "severity", "app_link")


@query("weekly_report", f"""
SELECT alert_type, count(*) AS alerts_this_week, count(*) FILTER (severity = 'critical') AS critical_this_week,
  count(DISTINCT primary_entity_id) AS entities
FROM alerts WHERE triggered_at BETWEEN {TE} - INTERVAL 7 DAY AND {TE} GROUP BY 1""")
def _(lake):
    return aq.weekly_report(lake.alerts, AS_OF_EVENTS)


@query("alert_metric_view", """
SELECT alert_type, severity, CAST(CAST(triggered_at AS DATE) AS VARCHAR) AS triggered_date, count(*) AS alert_count,
  count(DISTINCT primary_entity_id) AS distinct_entities, count(*) FILTER (severity = 'critical') AS critical_alerts,
  round(avg(score), 9) AS average_score FROM alerts GROUP BY 1, 2, 3""")
def _(lake):
    df = aq.alert_metrics(lake.alerts).query(
        ["alert_type", "severity", "triggered_date"],
        ["alert_count", "distinct_entities", "critical_alerts", "average_score"],
    )
    return df.withColumns(
        {"triggered_date": F.col("triggered_date").cast("string"), "average_score": F.round("average_score", 9)}
    )
