"""Case rules, lifecycle, reports, masks, text checks and model metrics."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakewarden.config import SkewPolicy
from lakewarden.functions import masks, text
from lakewarden.functions.scoring import blend_ai_risk, sla_columns
from lakewarden.plans import alerts as aq
from lakewarden.plans import cases, learning, reports, risk
from lakewarden.schemas import CASE


def make_cases(spark, rows):
    base = {
        "case_id": "CASE-1", "alert_num": 1, "customer_id": "C1", "customer_name": "Ann & Co <x>",
        "scenario": "Rapid Fund Movement", "priority": "high", "status": "new", "team_id": "TEAM_TM",
        "team_name": "AML Transaction Monitoring", "analyst_id": "AN_SARAH", "analyst_name": "Thandeka Nkosi",
        "risk_score": 80, "amount": 1000.5, "days_open": 3, "due_date": date(2024, 1, 10),
        "investigation_hours": 1.5, "opened_at": datetime(2024, 1, 1),
    }
    return spark.createDataFrame([tuple({**base, **r}[f.name] for f in CASE) for r in rows], CASE)


def test_sla(spark):
    rows = [("critical", "8"), ("critical", "7"), ("HIGH", "11"), ("high", "12"), ("medium", "24"), (None, "31"), ("odd", "x"), ("low", None)]
    df = spark.createDataFrame(rows, "p string, d string")
    got = [(r["sla_target_days"], r["sla_days_open"], r["sla_days_remaining"], r["sla_status"])
           for r in df.select("*", *[c.alias(n) for n, c in sla_columns(F.col("p"), F.col("d")).items()]).collect()]
    assert got == [
        (7, 8, -1, "breached"), (7, 7, 0, "at_risk"), (14, 11, 3, "on_track"), (14, 12, 2, "at_risk"),
        (30, 24, 6, "at_risk"), (30, 31, -1, "breached"), (30, 0, 30, "on_track"), (60, 0, 60, "on_track"),
    ]


def test_blend(spark):
    df = spark.createDataFrame([(0.9, 0.5), (0.1, 0.9), (2.0, -1.0), (0.5, 0.5)], "m double, r double")
    assert [r[0] for r in df.select(blend_ai_risk(F.col("m"), F.col("r"))).collect()] == [78.0, 90.0, 70.0, 50.0]


@pytest.mark.parametrize("policy", [cases.MOVE_POLICY, SkewPolicy(hot_rows=2, slice_rows=1)])
def test_lifecycle(spark, policy):
    df = make_cases(spark, [{"case_id": "1"}, {"case_id": "2", "status": "odd"}, {"case_id": "3", "status": "closed"}, {"case_id": "4"}])
    rows = [("1", 1, "closed"), ("1", 2, "assigned"), ("1", 3, "in_progress"), ("1", 4, "escalated"),
            ("1", 5, "in_progress"), ("1", 6, "flying"), ("1", 7, "closed"), ("1", 8, "assigned"),
            ("2", 1, "assigned"), ("3", 1, "new"), ("9", 1, "assigned")]
    events = spark.createDataFrame(rows, "case_id string, n int, target string").selectExpr(
        "case_id", "timestamp_seconds(n * 100) as event_ts", "cast(n as string) as event_id", "target"
    )
    got = {r["case_id"]: (r["final_status"], r["accepted"], r["rejected"]) for r in cases.replay_transitions(df, events, policy).collect()}
    assert got == {"1": ("closed", 5, 3), "2": ("odd", 0, 1), "3": ("closed", 0, 1), "4": ("new", 0, 0)}
    why = {(r["case_id"], r["event_id"]): r["reason"] for r in cases.rejected_transitions(df, events, policy).collect()}
    assert why["1", "1"] == "cannot move new to closed; allowed: assigned"
    assert why["1", "6"] == "unknown target status flying"
    assert why["1", "8"] == "cannot move closed to assigned; allowed: (none, terminal)"
    assert why["2", "1"] == "unknown current status odd"


def test_four_eyes_and_assignment(spark):
    filings = spark.createDataFrame(
        [("1", "Ann", "Bob"), ("2", "Ann", " ANN "), ("3", "Ann", None), ("4", "Ann", "  ")], "sar_id string, filed_by string, approved_by string"
    )
    got = {r["sar_id"]: r["violation"] for r in cases.four_eyes_violations(filings).collect()}
    assert got == {"2": "approver is the filer", "3": "no approver", "4": "no approver"}
    df = make_cases(spark, [{"case_id": "1"}, {"case_id": "2"}])
    moves = spark.createDataFrame(
        [("1", 1, "e1", "A1", "Al", "T1", "Team 1"), ("1", 2, "e2", "A2", "Bo", "", ""), ("1", 0, "e0", "A0", "Cy", "T0", "Team 0")],
        "case_id string, n int, event_id string, analyst_id string, analyst_name string, team_id string, team_name string",
    ).withColumn("event_ts", F.timestamp_seconds("n"))
    got = {r["case_id"]: (r["analyst_id"], r["team_id"], r["team_name"]) for r in cases.effective_assignment(df, moves).collect()}
    assert got["1"] == ("A2", "T1", "Team 1") and got["2"][0] == "AN_SARAH"


def test_effective_status_and_queue(spark):
    alerts = spark.createDataFrame(
        [("1", "high", 3), ("2", "critical", 1), ("3", "medium", 9), ("4", "critical", 2)], "alert_id string, severity string, n int"
    ).selectExpr("*", "'t' as alert_type", "'E' as primary_entity_id", "array('A') as account_ids",
                 "timestamp_seconds(n) as triggered_at", "0.5D as score", "'x' as explanation", "'new' as status")
    feedback = spark.createDataFrame([("1", "dismissed", 1, "a"), ("1", "confirmed", 2, "b"), ("4", "reviewing", 1, "c")],
                                     "alert_id string, status string, n int, feedback_id string").selectExpr(
        "*", "timestamp_seconds(n) as created_at", "'' as analyst_feedback", "'me' as analyst")
    queue = aq.alert_queue(alerts, feedback).collect()
    assert [(r["alert_id"], r["status"]) for r in queue] == [("4", "reviewing"), ("2", "new"), ("1", "confirmed"), ("3", "new")]
    assert [r["alert_id"] for r in aq.alert_queue(alerts, feedback, status="new", severity="critical").collect()] == ["2"]
    hist = {r["alert_id"]: r["feedback_history"] for r in aq.alert_history(alerts, feedback, 1).collect()}
    assert [f["status"] for f in hist["1"]] == ["confirmed"] and hist["2"] is None


def test_alert_history_ranks_its_feedback_once(spark, tmp_path):
    """Status and history come from one pass over the feedback: newest row, missing status, feedback of no alert."""
    spark.createDataFrame([("1", "new"), ("2", "new"), ("3", "open")], "alert_id string, status string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(
        [("1", "dismissed", 1, "a"), ("1", "confirmed", 2, "b"), ("1", "reviewing", 2, "a"), ("3", None, 5, "c"), ("3", "dismissed", 4, "d"),
         ("1", "late", None, "z"), (None, "dismissed", 9, "e")], "alert_id string, status string, n int, feedback_id string",
    ).selectExpr("*", "timestamp_seconds(n) created_at", "'' analyst_feedback", "'me' analyst").write.parquet(str(tmp_path / "f"))
    got = aq.alert_history(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "f")), 3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert got.columns == ["alert_id", "status", "feedback_history"]
    rows = {r["alert_id"]: (r["status"], r["feedback_history"] and [f["status"] for f in r["feedback_history"]]) for r in got.collect()}
    assert rows == {"1": ("confirmed", ["confirmed", "reviewing", "dismissed"]), "2": ("new", None), "3": ("open", [None, "dismissed"])}


PACK_TXN = "array<struct<transaction_id:string,amount:double,direction:string,channel:string,txn_ts:timestamp,counterparty_id:string>>"


def pack(spark, n_txns=2, hits=("Onyx & Co",), amount=5.0, name="Ann & Co <x>"):
    txns = [(f"T{i}", float(i), "debit", "wire", datetime(2024, 1, 1, 10), "TP1") for i in range(n_txns)]
    row = make_cases(spark, [{"amount": amount, "customer_name": name}])
    extra = spark.createDataFrame(
        [(txns, [("TP1", "Firm", "KY")], [(h, "sanctions", "confirmed") for h in hits], (92, "critical", True, "PEP"))],
        f"transactions {PACK_TXN}, network array<struct<counterparty_id:string,full_name:string,country:string>>,"
        " screening array<struct<watch_name:string,list_type:string,confidence:string>>,"
        " pkyc struct<dynamic_risk:int,risk_band:string,edd_review_required:boolean,risk_drivers:string>",
    )
    return row.join(extra)


def test_report_xml(spark):
    import xml.dom.minidom as minidom

    xml = reports.str_reports(pack(spark, 40, ("A", "B", "C", "D"))).first()["xml"]
    doc = minidom.parseString(xml)
    assert doc.documentElement.tagName == "report"
    assert xml.count("<transaction>") == 10
    for token in ("<report_code>STR</report_code>", "Ann &amp; Co &lt;x", "<currency_code>ZAR</currency_code>",
                  "<indicator>rules_risk_80</indicator>", "<indicator>pkyc_critical</indicator>", "watchlist: A, B, C</reason>"):
        assert token in xml, token
    assert "<narrative>" not in xml
    story = reports.str_reports(pack(spark).withColumn("n", F.lit("Why")), narrative="n").first()["xml"]
    assert "<narrative>Why</narrative>" in story


def test_report_validation(spark):
    good = reports.str_reports(pack(spark)).first()["xml"]
    docs = [
        ("good", good), ("cut", good[:200]), ("empty", "<report/>"), ("other", "<note>x</note>"), ("null", None),
        ("amount", good.replace("<total_amount>5.0<", "<total_amount>lots<")),
        ("noname", good.replace("<transactionnumber>T1</transactionnumber>", "<transactionnumber> </transactionnumber>")),
    ]
    got = {r["k"]: r for r in reports.validate_reports(spark.createDataFrame(docs, "k string, xml string")).collect()}
    assert got["good"]["valid"] and got["good"]["checks_passed"] == 12 == got["good"]["checks_total"]
    assert got["cut"]["checks_passed"] == 0 and got["null"]["checks_passed"] == 0 and not got["cut"]["valid"]
    assert got["amount"]["issues"] == ["total_amount is numeric"]
    assert got["noname"]["issues"] == ["every transaction has number + numeric amount"]
    assert "at least one transaction" in got["empty"]["issues"] and not got["empty"]["valid"]
    assert not got["other"]["valid"] and "root element is <report>" in got["other"]["issues"]
    bare = reports.str_reports(pack(spark, 0, ()))
    assert reports.validate_reports(bare).first()["issues"] == ["at least one transaction"]


def test_evidence_brief(spark):
    line = reports.evidence_brief(pack(spark)).first()["brief"]
    assert "2 flagged transactions, largest ZAR 1.00, directions debit." in line
    assert "1 watchlist hits: Onyx & Co (sanctions/confirmed)." in line and "band critical" in line


def test_guardrail(spark):
    long = "Words " * 30
    rows = [("ok", long), ("short", " " * 200 + "x"), ("leak13", long + "8001015009087"), ("leak10", long + "1234567890 and 12345678901"),
            ("amount", long + "R 5000000 and 123456789"), ("longer", long + "12345678901234"), ("none", None)]
    got = {r["k"]: (r["guardrail_pass"], r["leak_count"]) for r in text.guardrail(spark.createDataFrame(rows, "k string, t string"), "t").collect()}
    assert got == {"ok": (True, 0), "short": (False, 0), "leak13": (False, 1), "leak10": (False, 2), "amount": (True, 0),
                   "longer": (True, 0), "none": (False, 0)}


def test_extract_fields(spark):
    doc = "Letter\nClient Name: Ann Lee \n tax_number : 99\nAmount: \nNot a client name: Bo\nPEP STATUS: no"
    got = text.extract_fields(spark.createDataFrame([(doc,)], "d string"), "d").first()["fields"]
    assert got == {"client_name": "Ann Lee", "tax_number": "99", "pep_status": "no"}


def test_masks(spark):
    df = spark.createDataFrame([("ann@x.com", "+27821234567", date(1980, 5, 6), "1 Main"), (None, None, None, None)],
                               "email string, phone string, dob date, address string")
    got = masks.apply_masks(df, masks.POLICY["customers"])
    assert [tuple(r) for r in got.collect()] == [("****@x.com", "*******567", date(1980, 1, 1), "*** REDACTED ***"), (None,) * 4]
    assert masks.apply_masks(df, masks.POLICY["customers"], ["aml_pii_reviewers"]).first()["email"] == "ann@x.com"
    teams = spark.createDataFrame([("TEAM_TM",), ("TEAM_SW",), (None,)], "team_id string")
    assert masks.row_filter(teams, ["aml_compliance_oversight"]).count() == 3
    assert masks.row_filter(teams, ["aml_team_team_sw"]).count() == 1 and masks.row_filter(teams, []).count() == 0


def test_model_metrics(spark):
    rows = [(f"{i}", s, y) for i, (s, y) in enumerate([(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.3, 1), (0.1, 0)])]
    df = spark.createDataFrame(rows, "k string, s double, y int")
    pairs = [(a[1], b[1]) for a in rows for b in rows if a[2] == 1 and b[2] == 0]
    mid = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert learning.auc(df, "s", "y", "mid").first()[0] == pytest.approx(mid)
    assert learning.budget_fp(df, "s", "y", "k").first()["false_positives"] == 1
    assert learning.budget_fp(df, "s", "y", "k", k=2).first()["false_positives"] == 0
    drift = spark.createDataFrame([("a", "stable"), ("b", "warning")], "feature string, drift_status string")
    assert learning.drift_verdict(drift).first()[0] == "warning"
    versions = spark.createDataFrame([("9",), ("10",), ("x",)], "model_version string")
    assert learning.latest_metrics(versions).first()[0] == "10"


def test_trained_model_beats_chance(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(400):
        risk_score = rng.uniform(0, 100)
        rows.append((f"C{i}", rng.choice(["a", "b"]), rng.choice(["high", "low"]), risk_score, 5.0, 1.0, 1.0, 1, 10.0, 3, 0,
                     int(risk_score + rng.uniform(-20, 20) > 50)))
    df = spark.createDataFrame(rows, "case_id string, scenario string, priority string, risk_score double, amount_log double,"
                               " days_open double, investigation_hours double, num_accounts int, total_balance double,"
                               " current_risk_rating int, recent_alerts int, sar_filed int")
    train, test = learning.split_labelled(df.drop("sar_filed"), df.select("case_id", "sar_filed"))
    assert train.count() + test.count() == 400 and 90 < test.count() < 150
    scores = learning.score_cases(learning.train_sar_model(train, trees=10), test.drop("sar_filed"))
    judged = scores.join(df.select("case_id", "sar_filed"), "case_id")
    assert learning.auc(judged, "model_score", "sar_filed", "mid").first()[0] > 0.8


@pytest.mark.parametrize("frame", ["adverse_media", "alerts"])
def test_customer_pack_cuts_entities_of_many_customers(spark, monkeypatch, frame):
    """All pairs of an entity of many customers and many alerts or articles, made by many tasks."""
    monkeypatch.setattr(risk, "CELL_ROWS", 500, raising=False)
    monkeypatch.setattr(risk, "BLOCK_OWNERS", 7, raising=False)
    profiles = spark.range(120).selectExpr("concat('C', id) customer_id", "if(id < 100, 'HOT', if(id < 110, concat('E', id), null)) entity_id")
    profiles = profiles.unionByName(profiles.filter("customer_id in ('C1', 'C105')"))
    owned = "case when id < 200 then 'HOT' when id < 230 then concat('E', id % 20 + 100) end"
    alerts = spark.range(240).selectExpr(
        f"{owned} primary_entity_id", "concat('A', id % 237) alert_id", "'t' alert_type", "'high' severity", "timestamp_seconds(id) triggered_at", "0.5D score", "'x' explanation")
    media = spark.range(240).selectExpr(f"{owned} entity_id", "concat('D', id) article_id", "'h' headline", "'s' source", "date'2024-01-01' published_at")
    found, entity = (alerts, "primary_entity_id") if frame == "alerts" else (media, "entity_id")
    got = risk.customer_pack(profiles, alerts, media)[frame]
    plain = profiles.join(found.withColumnRenamed(entity, "entity_id"), "entity_id").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and plain.count() > 20_000
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 15 and max(tasks) < 6_000


def test_pkyc_components(spark, ledger, accounts, emap):
    customers = spark.createDataFrame([("C1", "UAE", 100.0, True), ("C2", "ZA", None, False)],
                                      "customer_id string, country string, declared_monthly_turnover double, pep_flag boolean").selectExpr(
        "*", "'n' full_name", "'s' segment", "'c' city", "'o' declared_occupation", "'t' kyc_tier")
    accts = accounts.selectExpr("*", "6000000D as balance", "'dormant' as status").filter("account_id in ('A1', 'A2')")
    alerts = spark.createDataFrame([("ENT1", "critical"), ("ENT1", "medium"), (None, "high")], "primary_entity_id string, severity string")
    hits = spark.createDataFrame([("C1", "customer", 0.9)], "source_id string, party_type string, match_score double")
    media = spark.createDataFrame([("ENT1",), ("ENT1",)], "entity_id string")
    txns = ledger([("A1", "credit", 300, "2024-01-01")])
    got = {r["customer_id"]: r for r in risk.pkyc_customer_risk(customers, accts, txns, alerts, hits, media, emap, "2024-01-02").collect()}
    # 12 + 5 + 40 + 16 + 8 + 6 + 6 + 20 + 10 = 123, capped
    assert got["C1"]["dynamic_risk"] == 100 and got["C1"]["risk_band"] == "critical" and got["C1"]["edd_review_required"]
    assert got["C1"]["risk_drivers"] == ("1 severe alerts; sanctions/watchlist hit; 2 adverse-media hits; turnover 3.0x declared;"
                                         " PEP; dormant account; high balance exposure")
    assert got["C2"]["dynamic_risk"] == 12 and got["C2"]["turnover_ratio"] is None and got["C2"]["risk_band"] == "low"


def test_peer_anomaly_and_typology(spark, ledger, emap):
    n = 30
    people = spark.createDataFrame([(f"C{i}", "retail") for i in range(n)], "customer_id string, segment string").selectExpr(
        "*", "'n' full_name", "'ZA' country", "100D declared_monthly_turnover")
    accts = spark.createDataFrame([(f"A{i}", f"C{i}") for i in range(n)], "account_id string, customer_id string")
    rows = [(f"A{i}", "debit", 10 + i % 3, "2024-01-01", {"cp": "X"}) for i in range(1, n)]
    rows += [("A0", "debit", 500, "2024-01-01", {"cp": f"P{i}", "category": "gaming"}) for i in range(15)]
    rows += [("A0", "credit", 480, "2024-01-01", {"cp": "P1", "category": "gaming"}) for _ in range(15)]
    txns = ledger(rows)
    behaviour = risk.customer_behaviour(accts, txns, "2024-01-02")
    got = risk.peer_anomaly(people, behaviour).collect()
    assert [(r["customer_id"], r["severity"]) for r in got] == [("C0", "critical")]
    alerts = spark.createDataFrame([("ENT2",)], "primary_entity_id string")
    exposure = risk.typology_exposure(txns, accts, people, alerts, emap).collect()
    assert [(r["account_id"], r["roundtrip_ratio"], r["net_flow"], r["never_alerted"]) for r in exposure] == [("A0", 0.96, 300.0, True)]
