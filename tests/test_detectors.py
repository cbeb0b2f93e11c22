"""Planted cases per detector: positive, boundary and negative."""

import pytest

from lakewarden.config import AlertConfig, RingConfig, SkewPolicy
from lakewarden.plans import detectors as d
from lakewarden.schemas import ALERT

AS_OF = "2024-01-02 00:00:00"
CFG = AlertConfig()


def by_account(df):
    return {r["account_ids"][0]: r for r in df.collect()}


def test_rapid_movement(ledger, accounts, emap):
    txns = ledger([
        ("A1", "credit", 4_000_000, "2024-01-01 18:00:00"),
        ("A1", "debit", 3_850_000, "2024-01-01 22:00:00"),
        ("A2", "credit", 250_000, "2024-01-01 10:00:00"),     # exactly the minimum
        ("A2", "debit", 225_000, "2024-01-01 11:00:00"),      # exactly the ratio
        ("A3", "debit", 300_000, "2024-01-01 01:00:00"),      # leaves before it arrives
        ("A3", "credit", 300_000, "2024-01-01 02:00:00"),
        ("A1", "credit", 9_000_000, "2023-12-31 23:59:59"),   # outside the window
        ("A1", "debit", 9_000_000, "2024-01-02 00:00:01"),    # after the clock
        ("A9", "credit", 300_000, "2024-01-01 01:00:00"),     # unknown account
        ("A9", "debit", 300_000, "2024-01-01 02:00:00"),
    ])
    df = d.detect_rapid_movement(txns, accounts, emap, CFG, AS_OF)
    assert df.schema.names == ALERT.names
    assert [f.dataType for f in df.schema] == [f.dataType for f in ALERT]
    got = by_account(df)
    assert set(got) == {"A1", "A2"}
    assert got["A1"]["severity"] == "critical" and got["A2"]["severity"] == "high"
    assert got["A1"]["score"] == 0.963 and got["A1"]["primary_entity_id"] == "ENT1"
    assert got["A1"]["transaction_ids"] == ["T0000", "T0001"]


def test_an_alert_keeps_all_of_its_transactions(spark, ledger, accounts, emap):
    many = ledger([("A1", "credit", 4_000_000, "2024-01-01 18:00:00")]).drop("transaction_id").crossJoin(
        spark.range(20_000).selectExpr("concat('C', id) as transaction_id")
    )
    out = ledger([("A1", "debit", 90_000_000_000, "2024-01-01 22:00:00")])
    alerts = d.detect_rapid_movement(many.unionByName(out), accounts, emap, CFG, AS_OF)
    assert len(alerts.first()["transaction_ids"]) == 20_001
    assert d.alert_transactions(alerts, d.rapid_events(many.unionByName(out), AS_OF)).count() == 20_001


def test_long_keys_keep_all_digits(spark):
    from lakewarden.sources.roles import tag
    from lakewarden.suite.parts import tag as sql_tag

    import duckdb

    keys = [7, 123456780, 123456781, 10**9 + 1, 10**12 + 7]
    ids = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select(tag("CASE-", "k")).collect()]
    assert len(set(ids)) == len(keys) and ids[0] == "CASE-00000007" and ids[3] == "CASE-1000000001"
    assert [duckdb.sql(f"SELECT {sql_tag('CASE-', str(k))}").fetchall()[0][0] for k in keys] == ids


def test_frequency_change(ledger, accounts, emap):
    rows = [("A1", "debit", 1, "2024-01-02 00:00:00")] * 40
    for day, n in ((1, 2), (2, 3), (3, 2)):
        rows += [("A1", "debit", 1, f"2023-12-0{day} 10:00:00")] * n
    rows += [("A2", "debit", 1, "2024-01-02 00:00:00")] * 10 + [("A2", "debit", 1, "2023-12-01")] * 1
    rows += [("A3", "debit", 1, "2024-01-02 00:00:00")] * 9 + [("A3", "debit", 1, "2023-12-01")] * 1
    rows += [("A4", "debit", 1, "2024-01-02 00:00:00")] * 50  # no baseline at all
    got = by_account(d.detect_frequency_change(ledger(rows), accounts, emap, CFG, AS_OF))
    assert set(got) == {"A1", "A2"}
    assert got["A1"]["severity"] == "critical" and got["A1"]["score"] == 1.0
    assert got["A2"]["evidence"]["z"] == "n/a" and got["A2"]["score"] == 0.9


def edge(a, b, amount=300_000, ts="2024-01-01 10:00:00"):
    return (a, "debit", amount, ts, {"from": a, "to": b})


def test_circular_flow(ledger, accounts, emap):
    txns = ledger([
        edge("A1", "A2"), edge("A2", "A3"), edge("A3", "A4"), edge("A4", "A1"),       # four hops
        edge("B1", "B2"), edge("B2", "B1"),                                              # two hops only
        edge("D1", "D2"), edge("D2", "D3"), edge("D3", "D1", 249_999),                  # below the floor
        edge("E1", "E2"), edge("E2", "E3"), edge("E3", "E4"), edge("E4", "E5"),
        edge("E5", "E6"), edge("E6", "E1"),                                              # six hops
        edge("F1", "F2"), edge("F2", "F3"), edge("F3", "F1", ts="2023-12-20 10:00:00"), # too old
    ])
    got = by_account(d.detect_circular_flow(txns, accounts, emap, RingConfig(), AS_OF))
    assert set(got) == {"A1", "A2", "A3", "A4"}
    assert got["A1"]["account_ids"] == ["A1", "A2", "A3", "A4", "A1"]
    assert got["A1"]["evidence"]["total"] == "1200000" and got["A1"]["score"] == 0.95


def test_dormant(ledger, accounts, emap):
    txns = ledger([
        ("A1", "debit", 500_000, "2024-01-01 10:00:00"),
        ("A2", "debit", 900_000, "2024-01-01 10:00:00"),   # idle 181 days
        ("A3", "debit", 900_000, "2024-01-01 10:00:00"),   # idle exactly 180 days
        ("A4", "debit", 900_000, "2024-01-01 10:00:00"),   # active lately
        ("A1", "debit", 499_999, "2024-01-01 11:00:00"),
    ])
    got = by_account(d.detect_dormant(txns, accounts, emap, CFG, AS_OF))
    assert set(got) == {"A1", "A2"}
    assert got["A1"]["transaction_ids"] == ["T0000"]


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(hot_rows=1, slice_rows=1)])
def test_rating_jump(spark, emap, policy):
    rows = [("C1", 1, 1), ("C1", 4, 2), ("C1", 3, 3), ("C2", 1, 1), ("C2", 3, 2), ("C3", 5, 1), ("C4", 2, 1), ("C4", 5, 9)]
    ratings = spark.createDataFrame(rows, "entity_id string, risk_rating int, d int").selectExpr(
        "entity_id", "'customer' as entity_type", "risk_rating",
        "cast(date_add(date'2024-01-01', d) as timestamp) as rated_at", "cast(d as string) as rating_id",
    )
    got = {r["alert_id"]: r for r in d.detect_risk_rating_change(ratings, emap, CFG, policy).collect()}
    assert set(got) == {"ALRT-RISK-C1-20240103", "ALRT-RISK-C4-20240110"}
    assert got["ALRT-RISK-C1-20240103"]["severity"] == "high"
    assert got["ALRT-RISK-C4-20240110"]["severity"] == "critical"
    assert got["ALRT-RISK-C4-20240110"]["primary_entity_id"] is None


def test_adverse_media_equals_membership_test(spark):
    entities = spark.createDataFrame(
        [("ENT1", "C1", "customer", "Ann Lee"), ("ENT2", "C2", "customer", "ann lee"), ("ENT1", "C3", "customer", "Ann Lee")],
        "entity_id string, source_id string, party_type string, full_name string",
    )
    media = spark.createDataFrame(
        [("M1", "Fine", ["Ann Lee", "Ann Lee", "Bo"]), ("M2", "Other", ["Bo"]), ("M3", "None", None)],
        "article_id string, headline string, named_entities array<string>",
    ).selectExpr("*", "date'2024-01-01' as published_at", "'wire' as source")
    got = d.detect_adverse_media(entities, media).collect()
    assert sorted(r["alert_id"] for r in got) == ["ALRT-AM-ENT1-M1", "ALRT-AM-ENT1-M1"]


def test_ubo_change(spark, emap):
    rows = [("F1", "F7", 1), ("F1", "F8", 2), ("F1", "F8", 3), ("F2", "F9", 1)]
    own = spark.createDataFrame(rows, "entity_id string, ubo_entity_id string, d int").selectExpr(
        "entity_id", "ubo_entity_id", "cast(date_add(date'2024-01-01', d) as timestamp) as effective_from",
        "cast(d as string) as ubo_id",
    )
    got = d.detect_ubo_change(own, emap).collect()
    assert [(r["alert_id"], r["related_entity_ids"], r["primary_entity_id"]) for r in got] == [
        ("ALRT-UBO-F1-20240103", ["F8"], "ENT3")
    ]


def auth_events(spark, rows):
    return spark.createDataFrame(
        rows, "event_id string, account_id string, t string, new_device boolean, new_geo boolean, credential_change boolean, geo_city string"
    ).selectExpr("* except (t)", "cast(t as timestamp) as event_ts")


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(hot_rows=1, slice_rows=1)])
def test_account_takeover(spark, ledger, accounts, emap, policy):
    auth = auth_events(spark, [
        ("E1", "A1", "2024-01-01 10:00:00", True, False, False, "Lagos"),
        ("E2", "A1", "2024-01-01 10:20:00", False, True, False, "Paris"),
        ("E3", "A2", "2024-01-01 10:00:00", False, False, True, None),
        ("E4", "A3", "2024-01-01 10:00:00", False, False, False, "Rome"),  # no anomaly
        ("E5", "A4", "2024-01-01 10:00:00", True, None, None, "Oslo"),
    ])
    txns = ledger([
        ("A1", "debit", 3_500_000, "2024-01-01 10:45:00"),
        ("A1", "debit", 4_000_000, "2024-01-01 10:30:00"),
        ("A2", "debit", 3_500_000, "2024-01-01 11:00:00"),   # exactly one hour
        ("A3", "debit", 9_000_000, "2024-01-01 10:10:00"),
        ("A4", "debit", 9_000_000, "2024-01-01 11:01:00"),   # 61 minutes
        ("A4", "credit", 9_000_000, "2024-01-01 10:10:00"),
        ("A4", "debit", 3_499_999, "2024-01-01 10:10:00"),
    ])
    got = by_account(d.detect_account_takeover(auth, txns, accounts, emap, CFG, policy))
    assert set(got) == {"A1", "A2"}
    assert got["A1"]["transaction_ids"] == ["T0001"]
    assert got["A1"]["evidence"] == {"geo_city": "Paris", "amount": "4000000.0"}
    assert "place unknown" in got["A2"]["explanation"]


def cards(spark, rows):
    return spark.createDataFrame(
        rows, "card_txn_id string, card_id string, account_id string, t string, lat double, lon double, city string"
    ).selectExpr("* except (t)", "cast(t as timestamp) as txn_ts")


@pytest.mark.parametrize("policy", [SkewPolicy(), SkewPolicy(hot_rows=1, slice_rows=1)])
def test_impossible_travel(spark, accounts, emap, policy):
    taps = cards(spark, [
        ("1", "K1", "A1", "2024-01-01 10:00:00", -26.2, 28.0, "Johannesburg"),
        ("2", "K1", "A1", "2024-01-01 10:30:00", 51.5, -0.1, "London"),
        ("3", "K1", "A1", "2024-01-01 10:40:00", 51.5, -0.1, "London"),
        ("4", "K2", "A2", "2024-01-01 10:00:00", -26.2, 28.0, "Johannesburg"),
        ("5", "K2", "A2", "2024-01-01 10:00:00.5", 51.5, -0.1, "London"),  # same second: no speed
    ])
    got = d.detect_impossible_travel(taps, accounts, emap, CFG, policy).collect()
    assert [r["alert_id"] for r in got] == ["ALRT-TRV-K1-202401011030"]
    assert got[0]["evidence"]["from_city"] == "Johannesburg" and got[0]["score"] == 1.0
    assert 18_000 < int(got[0]["evidence"]["implied_kmh"]) < 18_300


def test_structuring(ledger, accounts, emap):
    def cash(acct, amount, ts="2024-01-01 10:00:00", **over):
        return (acct, "credit", amount, ts, {"channel": "atm", "category": "cash", **over})

    txns = ledger([
        cash("A1", 18_750), cash("A1", 24_999.99), cash("A1", 20_000, "2023-12-26 00:00:01"),
        cash("A2", 25_000), cash("A2", 20_000), cash("A2", 20_000),                       # one at the limit
        cash("A3", 20_000), cash("A3", 20_000), cash("A3", 20_000, channel="wire"),
        *[cash("A4", 20_000)] * 5,
    ])
    got = by_account(d.detect_structuring(txns, accounts, emap, CFG, AS_OF))
    assert set(got) == {"A1", "A4"}
    assert got["A1"]["score"] == 0.5 and got["A4"]["severity"] == "critical"
    assert got["A4"]["primary_entity_id"] is None  # unresolved party: the alert survives


def test_alert_union_drops_broken_rows(spark, ledger, accounts, emap):
    from pyspark.sql import functions as F

    good = d.detect_dormant(ledger([("A1", "debit", 500_000, "2024-01-01 10:00:00")]), accounts, emap, CFG, AS_OF)
    bad = good.withColumn("severity", F.lit("urgent")).unionByName(good.withColumn("score", F.lit(1.5)))
    assert d.fraud_alerts(good, bad, good.withColumn("score", F.lit(None).cast("double"))).count() == 2


def test_config_table(spark):
    row = CFG.to_df(spark).first().asDict()
    assert row["ctr_threshold"] == 25000.0 and row["risk_jump"] == 2 and len(row) == 13
