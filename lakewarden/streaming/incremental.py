"""File arrival -> alerts: recompute only the accounts a batch touches.

The streamed ledger is an append-only table partitioned by a hash of the account;
newest-ingest-wins is applied when it is read together with the batch ledger.
Each micro-batch writes below its own batch number, so a replayed batch
overwrites its own output and nothing else.

Corrections may book a transaction on another account. Which account held a
transaction before is looked up in a narrow index (transaction_id, account_id)
partitioned by a hash of the transaction id: a batch reads only the index
partitions of its own ids, never the ledger. The batch ledger's part of the index,
and its alerts (every account of the batch ledger counts as touched once), are
written by the first run below batch number -1, so that accounts the stream never
reaches keep their batch alerts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakewarden.operators.conform import conform_transactions
from lakewarden.schemas import ALERT, with_batch_id

Detector = Callable[[DataFrame], DataFrame]

BUCKETS = 256
_BUCKET = "account_bucket"
_TXN_BUCKET = "txn_bucket"
#: Batch number of what the batch ledger gives before any file arrives.
INITIAL = -1


def account_bucket() -> Column:
    """Partition number of an account; a batch ledger carrying it is pruned too."""
    return F.pmod(F.xxhash64("account_id"), F.lit(BUCKETS)).cast("int")


def txn_bucket() -> Column:
    """Partition number of a transaction id in the index."""
    return F.pmod(F.xxhash64("transaction_id"), F.lit(BUCKETS)).cast("int")


def _index(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", "account_id", txn_bucket().alias(_TXN_BUCKET))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _initial(spark: SparkSession, batch_ledger: DataFrame, detect: Detector, root: str) -> None:
    """Index, touched accounts and alerts of the batch ledger, once for a root."""
    if _exists(spark, f"{root}/alerts/batch_id={INITIAL}/_SUCCESS"):
        return
    _save(_index(batch_ledger), root, "index", INITIAL, _TXN_BUCKET)
    _save(batch_ledger.select("account_id").distinct(), root, "touched", INITIAL)
    _save(detect(conform_transactions(batch_ledger)), root, "alerts", INITIAL)


def _save(df: DataFrame, root: str, part: str, batch_id: int, *partition_by: str) -> None:
    path = f"{root}/{part}/batch_id={batch_id}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def _read(spark: SparkSession, root: str, part: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{part}")


def _of_accounts(df: DataFrame, touched: DataFrame, buckets: list[int]) -> DataFrame:
    """Rows of the touched accounts, reading only their partitions where there are any."""
    if _BUCKET in df.columns:
        df = df.filter(F.col(_BUCKET).isin(buckets)).drop(_BUCKET)
    return df.join(touched, "account_id", "left_semi")


def _step(
    batch: DataFrame, batch_id: int, batch_ledger: DataFrame, detect: Detector, root: str,
    fixed_accounts: bool,
) -> None:
    spark = batch.sparkSession
    placed = batch.withColumn(_BUCKET, account_bucket())
    _save(placed, root, "ledger", batch_id, _BUCKET)
    streamed = _read(spark, root, "ledger", with_batch_id(placed.schema)).filter(
        F.col("batch_id") <= batch_id
    )
    new = streamed.filter(F.col("batch_id") == batch_id)
    _save(_index(new), root, "index", batch_id, _TXN_BUCKET)

    moves = _moves(spark, new, root, batch_id)
    if fixed_accounts:
        moves = moves.limit(0)
    _save(moves, root, "moves", batch_id)
    moved = _read(spark, root, "moves", with_batch_id(moves.schema)).filter(
        F.col("batch_id") <= batch_id
    )
    left = moved.filter(F.col("batch_id") == batch_id).select(F.col("old_account").alias("account_id"))
    _save(new.select("account_id").unionByName(left).distinct(), root, "touched", batch_id)

    touched = spark.read.parquet(f"{root}/touched/batch_id={batch_id}")
    buckets = [r[0] for r in touched.select(account_bucket()).distinct().collect()]
    ledger = conform_transactions(
        _of_accounts(batch_ledger, touched, buckets),
        _of_accounts(streamed.drop("batch_id"), touched, buckets),
    )
    now_at = moved.groupBy("transaction_id").agg(
        F.max_by("new_account", "batch_id").alias("_now")
    )
    settled = ledger.join(now_at, "transaction_id", "left").filter(
        F.col("_now").isNull() | (F.col("_now") == F.col("account_id"))
    )
    _save(detect(settled.drop("_now")), root, "alerts", batch_id)


def _moves(spark: SparkSession, new: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Transactions a correction books on another account than before.

    Reads the index partitions of the batch's transaction ids only (at most BUCKETS
    numbers come to the driver).
    """
    buckets = [r[0] for r in new.select(txn_bucket()).distinct().collect()]
    index = spark.read.schema(
        f"transaction_id string, account_id string, {_TXN_BUCKET} int, batch_id bigint"
    ).parquet(f"{root}/index")
    prior = index.filter(F.col(_TXN_BUCKET).isin(buckets) & (F.col("batch_id") < batch_id)).select(
        "transaction_id", F.col("account_id").alias("old_account")
    )
    return (
        new.select("transaction_id", F.col("account_id").alias("new_account"))
        .join(prior, "transaction_id")
        .filter(F.col("old_account") != F.col("new_account"))
        .select("transaction_id", "old_account", "new_account")
        .distinct()
    )


def run_incremental(
    lane: DataFrame, batch_ledger: DataFrame, detect: Detector, root: str, checkpoint: str,
    fixed_accounts: bool = False,
) -> StreamingQuery:
    """Process what has arrived: append it, then re-run ``detect`` for its accounts.

    ``detect`` maps a conformed ledger to alerts of any number of account-owned
    families and is called with the whole history of the touched accounts only. A
    correction may move a transaction to another account; finding those reads the
    index partitions of the batch's ids. A feed that never does so can set
    ``fixed_accounts``. The first run for a root also writes the batch ledger's index
    and alerts (batch -1).
    """
    _initial(lane.sparkSession, batch_ledger, detect, root)
    step = partial(
        _step, batch_ledger=batch_ledger, detect=detect, root=root, fixed_accounts=fixed_accounts
    )
    return (
        lane.writeStream.foreachBatch(lambda batch, batch_id: step(batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Alerts as of the last run: per account only those of its latest batch.

    An alert belongs to its first account. One without accounts is kept from the
    latest batch that gave an alert of its id.
    """
    alerts = _read(spark, root, "alerts", with_batch_id(ALERT))
    latest = (
        _read(spark, root, "touched", "account_id string, batch_id bigint")
        .groupBy("account_id")
        .agg(F.max("batch_id").alias("batch_id"))
    )
    owner = F.get("account_ids", F.lit(0)).alias("account_id")
    owned = alerts.select("*", owner)
    loose = owned.filter(F.col("account_id").isNull())
    newest = loose.groupBy("alert_id").agg(F.max("batch_id").alias("batch_id"))
    return (
        owned.join(latest, ["account_id", "batch_id"], "left_semi")
        .unionByName(loose.join(newest, ["alert_id", "batch_id"], "left_semi"))
        .drop("account_id", "batch_id")
    )
