"""Streams: lenient ingest, exactly-once restarts, incremental and stateful detection."""

import json

from pyspark.sql import functions as F

from lakewarden.config import AlertConfig
from lakewarden.functions import clock
from lakewarden.operators.conform import conform_transactions
from lakewarden.plans import detectors
from lakewarden.streaming.incremental import current_alerts, run_incremental
from lakewarden.streaming.ingest import append_lane, stream_cards, stream_ledger, stream_quarantine
from lakewarden.streaming.taps import stream_tap_pairs


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def txn(ident, acct="A1", amount=20_000.0, ts="2024-01-01T10:00:00", **extra):
    return {"transaction_id": ident, "account_id": acct, "direction": "credit", "amount": amount, "channel": "atm",
            "merchant_category": "cash", "txn_ts": ts, "is_cross_border": False, **extra}


def test_lane_is_lenient_and_exactly_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    land(src, "1.json", [txn("1"), txn("2", amount="n/a"), txn("3", brand_new=5), '{"transaction_id": "4", ', txn("5", amount="7.5")])
    for _ in range(2):  # a second run finds nothing new
        append_lane(stream_ledger(spark, str(src)), out, ck).awaitTermination()
    land(src, "2.json", [txn("6")])
    append_lane(stream_ledger(spark, str(src)), out, ck).awaitTermination()
    rows = {r["transaction_id"]: r for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == ["1", "2", "3", "5", "6"]
    assert rows["2"]["amount"] is None and json.loads(rows["2"]["_rescued"]) == {"amount": "n/a"}
    assert json.loads(rows["3"]["_rescued"]) == {"brand_new": "5"} and rows["1"]["_rescued"] is None
    assert rows["5"]["amount"] == 7.5 and rows["1"]["_ingested_at"] is not None
    append_lane(stream_quarantine(spark, str(src)), out + "q", ck + "q").awaitTermination()
    bad = spark.read.parquet(out + "q").collect()
    assert [r["line"] for r in bad] == ['{"transaction_id": "4", '] and bad[0]["file_path"].endswith("1.json")


def test_late_correction_wins(spark, tmp_path):
    src = tmp_path / "in"
    land(src, "1.json", [txn("1", amount=1), txn("2", amount=2)])
    out, ck = str(tmp_path / "o"), str(tmp_path / "c")
    append_lane(stream_ledger(spark, str(src), stamp=clock.at("2024-01-01")), out, ck).awaitTermination()
    land(src, "2.json", [txn("1", amount=9)])
    append_lane(stream_ledger(spark, str(src), stamp=clock.at("2024-01-02")), out, ck).awaitTermination()
    lane = spark.read.parquet(out).drop("_rescued")
    got = conform_transactions(lane.limit(0), lane).collect()
    assert {r["transaction_id"]: r["amount"] for r in got} == {"1": 9.0, "2": 2.0}


def test_incremental_equals_batch(spark, tmp_path, accounts, emap):
    src, root = tmp_path / "in", str(tmp_path / "run")
    cfg = AlertConfig()
    batch = spark.createDataFrame([("b1", "A1"), ("b2", "A2"), ("b3", "A2")], "transaction_id string, account_id string").selectExpr(
        "*", "null as from_acct", "null as to_acct", "'credit' as direction", "20000D as amount", "'atm' as channel",
        "'cash' as merchant_category", "timestamp'2024-01-01 08:00:00' as txn_ts", "null as counterparty_id",
        "timestamp'2024-01-01 08:00:00' as _ingested_at",
    )

    def detect(ledger):
        return detectors.detect_structuring(ledger, accounts, emap, cfg, "2024-01-02")

    def run():
        lane = stream_ledger(spark, str(src)).drop("_rescued")
        run_incremental(lane, batch, detect, root, f"{root}/ck").awaitTermination()
        return {r["account_ids"][0]: r["transaction_ids"] for r in current_alerts(spark, root).collect()}

    land(src, "1.json", [txn("s1", "A1"), txn("s2", "A2")])
    assert run() == {"A2": ["b2", "b3", "s2"]}
    land(src, "2.json", [txn("s3", "A1"), txn("s2", "A2", amount=1.0)])  # a correction takes A2 below the count
    assert run() == {"A1": ["b1", "s1", "s3"]}
    land(src, "3.json", [txn("s3", "A2"), txn("s4", "A2"), txn("s5", "A2")])  # s3 moves from A1 to A2
    assert run() == {"A2": ["b2", "b3", "s3", "s4", "s5"]}
    land(src, "4.json", [txn("s6", "A1")])  # A1 is recomputed without the moved one
    assert run() == {"A1": ["b1", "s1", "s6"], "A2": ["b2", "b3", "s3", "s4", "s5"]}


def test_stateful_travel_spans_batches(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "pairs")

    def tap(ident, ts, lat, lon, city, card="K1"):
        return {"card_txn_id": ident, "card_id": card, "account_id": "A1", "lat": lat, "lon": lon, "city": city, "txn_ts": ts}

    def run():
        pairs = stream_tap_pairs(stream_cards(spark, str(src)))

        def save(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        pairs.writeStream.foreachBatch(save).outputMode("append").option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    land(src, "1.json", [tap("1", "2024-01-01T10:00:00", -26.2, 28.0, "Johannesburg"), tap("9", "2024-01-01T10:00:00", 0.0, 0.0, "Null", "K2")])
    run()
    land(src, "2.json", [tap("2", "2024-01-01T10:30:00", 51.5, -0.1, "London"), tap("3", "2024-01-01T10:40:00", 51.5, -0.1, "London")])
    run()
    got = spark.read.parquet(out).orderBy("card_txn_id").select("card_txn_id", "prev_city", F.round("implied_kmh").alias("v")).collect()
    assert [(r[0], r[1]) for r in got] == [("1", None), ("2", "Johannesburg"), ("3", "London"), ("9", None)]
    assert got[0]["v"] is None and 18_000 < got[1]["v"] < 18_300 and got[2]["v"] == 0


def test_incremental_families_equal_batch_after_corrections(spark, tmp_path, accounts, emap):
    """Four account families over three landed batches with corrections and a move equal one batch run."""
    from functools import reduce

    from lakewarden.schemas import with_batch_id

    src, root = tmp_path / "in", str(tmp_path / "run")
    cfg, as_of = AlertConfig(), "2024-01-02"
    batch = spark.createDataFrame(
        [("b1", "A1", "credit", 20000.0, "2024-01-01 08:00:00"), ("b2", "A2", "credit", 20000.0, "2024-01-01 08:00:00"),
         ("b3", "A2", "credit", 20000.0, "2024-01-01 08:00:00"), ("b4", "A3", "credit", 300000.0, "2024-01-01 20:00:00"),
         ("b5", "A3", "debit", 290000.0, "2024-01-01 22:00:00")],
        "transaction_id string, account_id string, direction string, amount double, t string",
    ).selectExpr(
        "transaction_id", "account_id", "null as from_acct", "null as to_acct", "direction", "amount", "'atm' as channel",
        "'cash' as merchant_category", "cast(t as timestamp) as txn_ts", "null as counterparty_id",
        "timestamp'2024-01-01 08:00:00' as _ingested_at",
    )

    def detect(ledger):
        families = [
            detectors.detect_rapid_movement(ledger, accounts, emap, cfg, as_of),
            detectors.detect_frequency_change(ledger, accounts, emap, cfg, as_of),
            detectors.detect_dormant(ledger, accounts, emap, cfg, as_of),
            detectors.detect_structuring(ledger, accounts, emap, cfg, as_of),
        ]
        return reduce(lambda a, b: a.unionByName(b), families)

    def view(df):
        return sorted((r.alert_id, r.alert_type, r.severity, tuple(r.account_ids), tuple(r.transaction_ids), round(r.score, 4)) for r in df.collect())

    def run():
        lane = stream_ledger(spark, str(src)).drop("_rescued")
        run_incremental(lane, batch, detect, root, f"{root}/ck").awaitTermination()
        streamed = spark.read.parquet(f"{root}/ledger").drop("batch_id", "account_bucket")
        return view(current_alerts(spark, root)), view(detect(conform_transactions(batch, streamed)))

    land(src, "1.json", [txn("s1", "A1"), txn("s2", "A2"), txn("s7", "A1", 600000.0, "2024-01-01T12:00:00")])
    got, want = run()
    assert got == want and {a[1] for a in got} >= {"structuring", "dormant_reactivation", "rapid_movement"}
    land(src, "2.json", [txn("s3", "A1"), txn("s2", "A2", amount=1.0), txn("b5", "A3", amount=100.0, direction="debit")])
    got, want = run()
    assert got == want and not any(a[1] == "rapid_movement" for a in got)  # the correction ends the passthrough
    land(src, "3.json", [txn("s3", "A2"), txn("s4", "A2"), txn("s7", "A2", 600000.0, "2024-01-01T12:00:00")])  # s3 and s7 move to A2
    got, want = run()
    assert got == want
    assert [a[4] for a in got if a[0] == "ALRT-DORM-A2"] == [("s7",)] and not any(a[0] == "ALRT-DORM-A1" for a in got)
    index = spark.read.parquet(f"{root}/index")
    assert index.where("batch_id = -1").count() == 5 and index.where("batch_id >= 0").count() == 9


def test_lane_names_odd_values_once_a_row(spark):
    """Unknown and misfit values are rescued; the casts are not repeated for every key of a row's map."""
    from lakewarden import schemas
    from lakewarden.streaming import ingest

    lines = spark.createDataFrame(
        [('{"transaction_id":"T1","amount":"2.5"}',), ('{"transaction_id":"T2","amount":"x","extra":"1"}',),
         ('{"transaction_id":"T3","amount":null,"txn_ts":"2024-01-01 00:00:00"}',), ("{}",), ("no json",)], "value string",
    ).withColumn("_map", F.from_json("value", "map<string,string>"))
    lane = ingest._lane(lines, schemas.TRANSACTIONS, F.lit("2024-02-01").cast("timestamp"))
    assert lane.columns == [f.name for f in schemas.TRANSACTIONS if f.name != "_ingested_at"] + ["_ingested_at", "_rescued"]
    got = {(r.transaction_id, r.amount, r._rescued) for r in lane.collect()}
    assert got == {("T1", 2.5, None), ("T2", None, '{"amount":"x","extra":"1"}'), ("T3", None, None), (None, None, None)}
    for tail in lane._jdf.queryExecution().optimizedPlan().toString().split("map_filter(")[1:]:
        depth = 1
        body = ""
        for ch in tail:
            depth += (ch == "(") - (ch == ")")
            if not depth:
                break
            body += ch
        assert "cast" not in body


def test_landed_rows_are_packed_and_come_back(spark, tmp_path):
    """Landing files hold the rows packed, and the lane reads the same rows from them."""
    from lakewarden.suite.streams import _drop

    rows = spark.range(20_000).selectExpr(
        "concat('TX-', id) transaction_id", "concat('ACC', id % 50) account_id", "'debit' direction", "id / 7.0D amount",
        "timestamp_seconds(id) txn_ts", "timestamp_seconds(id) _ingested_at").coalesce(2)
    rows.drop("_ingested_at").write.json(str(tmp_path / "plain"))
    _drop(rows, str(tmp_path / "landing"))

    def size(name):
        return sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))

    assert size("landing") * 3 < size("plain")
    lane = stream_ledger(spark, str(tmp_path / "landing"), stamp=clock.at("2024-01-01"))
    append_lane(lane, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    columns = ["transaction_id", "account_id", "direction", "amount", "txn_ts"]
    landed = spark.read.parquet(str(tmp_path / "out"))
    assert landed.count() == 20_000 and landed.select(columns).exceptAll(rows.select(columns)).isEmpty()


def test_saved_tables_free_their_shuffles(spark, monkeypatch):
    """A table of the lake gives up its shuffle files once it is written."""
    from lakewarden.plans import medallion

    freed = []
    monkeypatch.setattr(medallion, "release_shuffles", freed.append, raising=False)
    lake = medallion.Lake(spark, "none")
    assert lake._saved("t", lambda: spark.range(9).repartition(3)).count() == 9 and freed == [spark]
