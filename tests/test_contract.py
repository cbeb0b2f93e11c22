"""Registered queries against their check SQL, and what their plans must not contain."""

import math
import re
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from lakewarden.suite import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()

CHECKED = [
    "dedupe_newest_ingest", "quality_report", "entity_resolution", "entity_resolution_hot_clusters",
    "rapid_movement", "frequency_change", "circular_flow_detail", "risk_rating_change", "adverse_media",
    "ubo_change_hot_keys", "account_takeover", "impossible_travel", "structuring", "fraud_alerts",
    "watchlist_screening_long_list", "customer_360", "pkyc_customer_risk", "peer_anomaly", "entity_network",
    "ego_network_nodes", "travel_legs", "alert_summary", "alert_queue", "build_cases", "fold_cases",
    "resolution_flow", "case_evidence", "lifecycle_replay", "text_guardrail", "document_fields", "vector_topk",
    "str_report_validation", "sar_labels", "roc_auc", "landed_documents", "alert_config_relation", "quality_report_declared",
    "windowed_rapid_movement", "incremental_alerts", "incremental_ledger_families", "graph_seeds", "graph_relations", "eval_summary", "model_metrics", "drift_metrics", "stream_malformed_rows",
]
PLANNED = [
    "dedupe_newest_ingest", "entity_resolution", "rapid_movement", "frequency_change", "ubo_change", "account_takeover",
    "impossible_travel", "adverse_media", "watchlist_screening", "watchlist_screening_long_list", "customer_360",
    "pkyc_customer_risk", "peer_anomaly", "typology_exposure", "ego_network_edges", "graph_relations", "build_cases",
    "fold_cases", "case_evidence", "alert_history", "roc_auc", "drift_metrics",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def test_every_check_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    without = set(registry.QUERIES) - set(registry.SQL)
    assert without == {"evidence_brief", "str_report_documents", "gbt_model_scores", "gbt_holdout_metrics", "vector_ivf_recall"}


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", PLANNED)
def test_plan_has_no_single_task_or_pairwise_operator(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan
    for line in plan.splitlines():
        if re.search(r"[-+ ]Window \[", line):
            spec = line[line.index("windowspecdefinition(") + 21:]
            assert not re.match(r"[^,)]* (ASC|DESC) ", spec), f"window without partition: {line}"


def test_ledger_filters_reach_the_scan(spark):
    from lakewarden.plans.detectors import rapid_events
    from lakewarden.sources.roles import AS_OF_LEDGER, Roles

    events = rapid_events(Roles(spark, SF).transactions(), AS_OF_LEDGER).groupBy("account_id").count()
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "LessThanOrEqual(l_" in plan  # long filter lists are cut in plan text
    assert "ReadSchema: struct<l_suppkey:bigint,l_shipdate:timestamp>" in plan


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert sum(r["is_total"] for r in rows) == 1 and len(rows) > 5
