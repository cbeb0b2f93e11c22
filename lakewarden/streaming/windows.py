"""Windowed passthrough detection over the streamed ledger.

The batch detector looks back from one clock. A stream has no single clock, so
this variant slides a 24-hour window by the hour: an approximation whose windows
start on whole hours; the batch detector stays canonical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.config import AlertConfig


def stream_rapid_movement(
    ledger: DataFrame, cfg: AlertConfig = AlertConfig(), width: str = "24 hours",
    slide: str = "1 hour", lateness: str = "2 hours",
) -> DataFrame:
    """Accounts and windows with inflow and near-equal later outflow."""
    credit, debit = (F.col("direction") == d for d in ("credit", "debit"))
    flows = (
        ledger.withWatermark("txn_ts", lateness)
        .groupBy(F.window("txn_ts", width, slide).alias("w"), "account_id")
        .agg(
            F.sum(F.when(credit, F.col("amount"))).alias("inflow"),
            F.sum(F.when(debit, F.col("amount"))).alias("outflow"),
            F.min(F.when(credit, F.col("txn_ts"))).alias("first_credit"),
            F.max(F.when(debit, F.col("txn_ts"))).alias("last_debit"),
        )
    )
    return flows.filter(
        (F.col("inflow") >= cfg.rapid_min_amount)
        & (F.col("outflow") >= F.col("inflow") * cfg.passthrough_ratio)
        & (F.col("first_credit") <= F.col("last_debit"))
    ).select(
        "account_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "inflow", "outflow",
        F.least(F.lit(1.0), F.round(F.col("outflow") / F.col("inflow"), 3)).alias("score"),
    )
