"""Registered queries: streaming lanes, incremental alerts, stateful and windowed streams.

The landing files are written by Spark from the given tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.config import AlertConfig
from lakewarden.functions import clock
from lakewarden.operators.conform import conform_cards, conform_transactions
from lakewarden.plans import detectors
from lakewarden.plans.medallion import AS_OF_LEDGER, DORMANT_WINDOW, EVENT_CFG, LEDGER_CFG, RAPID_HOURS
from lakewarden.schemas import with_batch_id
from lakewarden.session import release_shuffles, scratch_path
from lakewarden.streaming.incremental import current_alerts, run_incremental
from lakewarden.streaming.ingest import append_lane, stream_cards, stream_ledger, stream_quarantine
from lakewarden.streaming.taps import stream_tap_pairs
from lakewarden.streaming.windows import stream_rapid_movement
from lakewarden.suite.foundation import tstr
from lakewarden.suite.parts import ts
from lakewarden.suite.registry import query


def _drop(df: DataFrame, landing: str) -> None:
    """Land rows as JSON lines, packed: as plain text they take about ten times the room of the table."""
    df.drop("_ingested_at").write.mode("append").option("zlib.compress.level", "BEST_SPEED").json(landing, compression="gzip")


def _ingest(lake, lane: DataFrame, name: str) -> DataFrame:
    table = scratch_path(lake.spark, name)
    append_lane(lane, table, f"{table}-checkpoint").awaitTermination()
    release_shuffles(lake.spark)
    return lake.spark.read.schema(lane.schema).parquet(table)


@query("stream_ledger_lane", f"""
SELECT transaction_id, account_id, direction, amount, merchant_category, {ts('txn_ts')} AS txn_ts FROM ledger""")
def _(lake):
    landing = scratch_path(lake.spark, "landing")
    _drop(lake.ledger, landing)
    table = _ingest(lake, stream_ledger(lake.spark, landing), "lane")
    return table.select(
        "transaction_id", "account_id", "direction", "amount", "merchant_category",
        tstr("txn_ts").alias("txn_ts"),
    )


@query("stream_card_lane", f"""
SELECT card_txn_id, card_id, lat, lon, city, {ts('txn_ts')} AS txn_ts FROM cards""")
def _(lake):
    landing = scratch_path(lake.spark, "landing")
    _drop(lake.roles.cards(), landing)
    table = _ingest(lake, stream_cards(lake.spark, landing), "lane")
    return conform_cards(table.drop("_rescued")).select(
        "card_txn_id", "card_id", "lat", "lon", "city", tstr("txn_ts").alias("txn_ts")
    )


@query("stream_malformed_rows", """
SELECT 'rescued' AS lane, count(*) AS n FROM events WHERE event_type = 'error'
UNION ALL SELECT 'clean', count(*) FROM events WHERE event_type IN ('view', 'purchase', 'click')
UNION ALL SELECT 'quarantined', count(*) FROM events WHERE event_type = 'signup'""")
def _(lake):
    """Events as taps: errors get a bad amount and a new column, sign-ups are no JSON."""
    kind = F.col("merchant")
    cards = lake.roles.cards()
    good = F.to_json(F.struct(*[c for c in cards.columns if c != "_ingested_at"]))
    odd = F.to_json(F.struct("card_txn_id", "card_id", F.lit("n/a").alias("amount"), F.lit(1).alias("brand_new")))
    line = F.when(kind == "error", odd).when(kind == "signup", F.substring(good, 1, 20)).otherwise(good)
    landing = scratch_path(lake.spark, "landing")
    cards.select(line.alias("value")).write.text(landing)
    rows = _ingest(lake, stream_cards(lake.spark, landing), "lane")
    bad = _ingest(lake, stream_quarantine(lake.spark, landing), "quarantine")
    lanes = rows.select(F.when(F.col("_rescued").isNull(), "clean").otherwise("rescued").alias("lane"))
    return lanes.unionByName(bad.select(F.lit("quarantined").alias("lane"))).groupBy("lane").agg(
        F.count("*").alias("n")
    )


@query("stream_newest_wins", """
SELECT transaction_id, account_id, amount + 1 AS amount FROM ledger""")
def _(lake):
    """The whole ledger arrives twice; the corrected second arrival wins."""
    landing = [scratch_path(lake.spark, "landing") for _ in range(2)]
    _drop(lake.ledger, landing[0])
    _drop(lake.ledger.withColumn("amount", F.col("amount") + 1), landing[1])
    lanes = [
        _ingest(lake, stream_ledger(lake.spark, path, stamp=clock.at(f"2024-02-0{i + 1}")), "lane")
        for i, path in enumerate(landing)
    ]
    streamed = lanes[0].unionByName(lanes[1]).drop("_rescued")
    return conform_transactions(lake.ledger, streamed).select("transaction_id", "account_id", "amount")


@query("incremental_alerts", """
SELECT alert_id, severity, account_ids, txn_ids, round(score, 4) AS score FROM a_struct""")
def _(lake):
    """The newest half-year arrives as a stream; alerts equal the full batch run."""
    late = F.col("txn_ts") >= clock.at("2001-01-01")
    landing, root = scratch_path(lake.spark, "landing"), scratch_path(lake.spark, "incremental")
    _drop(lake.ledger.filter(late), landing)

    def detect(ledger: DataFrame) -> DataFrame:
        return detectors.detect_structuring(
            ledger, lake.roles.accounts(), lake.emap, LEDGER_CFG, AS_OF_LEDGER
        )

    lane = stream_ledger(lake.spark, landing).drop("_rescued")
    run_incremental(lane, lake.ledger.filter(~late), detect, root, f"{root}/checkpoint").awaitTermination()
    return current_alerts(lake.spark, root).select(
        "alert_id", "severity", F.array_join("account_ids", ",").alias("account_ids"),
        F.array_join("transaction_ids", ",").alias("txn_ids"), F.round("score", 4).alias("score"),
    )


@query("incremental_ledger_families", """
SELECT alert_id, alert_type, severity, account_ids, txn_ids, round(score, 4) AS score FROM a_rapid
UNION ALL SELECT alert_id, alert_type, severity, account_ids, txn_ids, round(score, 4) FROM a_freq
UNION ALL SELECT alert_id, alert_type, severity, account_ids, txn_ids, round(score, 4) FROM a_dormant
UNION ALL SELECT alert_id, alert_type, severity, account_ids, txn_ids, round(score, 4) FROM a_struct""")
def _(lake):
    """Four account-owned ledger families, run incrementally over the streamed half-year, equal the batch run."""
    late = F.col("txn_ts") >= clock.at("2001-01-01")
    landing, root = scratch_path(lake.spark, "landing"), scratch_path(lake.spark, "incremental")
    _drop(lake.ledger.filter(late), landing)

    def detect(ledger: DataFrame) -> DataFrame:
        accounts, emap = lake.roles.accounts(), lake.emap
        return reduce(DataFrame.unionByName, [
            detectors.detect_rapid_movement(ledger, accounts, emap, LEDGER_CFG, AS_OF_LEDGER, RAPID_HOURS),
            detectors.detect_frequency_change(ledger, accounts, emap, LEDGER_CFG, AS_OF_LEDGER),
            detectors.detect_dormant(ledger, accounts, emap, LEDGER_CFG, AS_OF_LEDGER, DORMANT_WINDOW),
            detectors.detect_structuring(ledger, accounts, emap, LEDGER_CFG, AS_OF_LEDGER),
        ])

    lane = stream_ledger(lake.spark, landing).drop("_rescued")
    run_incremental(lane, lake.ledger.filter(~late), detect, root, f"{root}/checkpoint").awaitTermination()
    return current_alerts(lake.spark, root).select(
        "alert_id", "alert_type", "severity", F.array_join("account_ids", ",").alias("account_ids"),
        F.array_join("transaction_ids", ",").alias("txn_ids"), F.round("score", 4).alias("score"),
    )


@query("stateful_travel", f"""
SELECT card_id, card_txn_id, prev_city, city, {ts('txn_ts')} AS txn_ts, CAST(round(implied_kmh) AS BIGINT) AS kmh
FROM tap_pairs WHERE implied_kmh > {EVENT_CFG.max_feasible_kmh}""")
def _(lake):
    landing = scratch_path(lake.spark, "landing")
    _drop(lake.roles.cards(), landing)
    out = scratch_path(lake.spark, "pairs")
    pairs = stream_tap_pairs(stream_cards(lake.spark, landing))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    (pairs.writeStream.foreachBatch(save).outputMode("append")
     .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination())
    fast = lake.spark.read.schema(with_batch_id(pairs.schema)).parquet(out).filter(
        F.col("implied_kmh") > EVENT_CFG.max_feasible_kmh
    )
    return fast.select(
        "card_id", "card_txn_id", "prev_city", "city", tstr("txn_ts").alias("txn_ts"),
        F.round("implied_kmh").cast("bigint").alias("kmh"),
    )


@query("windowed_rapid_movement", f"""
SELECT account_id, {ts('ws')} AS window_start, round(i, 2) AS inflow, round(o, 2) AS outflow FROM (
  SELECT account_id, ws, sum(CASE WHEN direction = 'credit' THEN amount END) AS i, sum(CASE WHEN direction = 'debit' THEN amount END) AS o,
    min(CASE WHEN direction = 'credit' THEN txn_ts END) AS fc, max(CASE WHEN direction = 'debit' THEN txn_ts END) AS ld
  FROM (SELECT *, date_trunc('day', txn_ts) - to_days(CAST(k AS INTEGER)) AS ws FROM event_ledger, range(0, 3) r(k)) GROUP BY 1, 2)
WHERE i >= 20 AND o >= i * CAST(0.9 AS DOUBLE) AND fc <= ld
  AND ws + INTERVAL 3 DAY <= (SELECT max(txn_ts) FROM event_ledger) - INTERVAL 2 HOUR""")
def _(lake):
    landing, out = scratch_path(lake.spark, "landing"), scratch_path(lake.spark, "windows")
    _drop(lake.roles.event_ledger(), landing)
    cfg = AlertConfig(rapid_min_amount=20.0)
    found = stream_rapid_movement(
        stream_ledger(lake.spark, landing), cfg, "3 days", "1 day", "2 hours"
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    # append: a window leaves the state when the watermark passes its end
    (found.writeStream.foreachBatch(save).outputMode("append")
     .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination())
    saved = lake.spark.read.schema(with_batch_id(found.schema)).parquet(out)
    return saved.select(
        "account_id", tstr("window_start").alias("window_start"), F.round("inflow", 2).alias("inflow"),
        F.round("outflow", 2).alias("outflow"),
    )
