"""Audit trail and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.scoring import overall_pass


def audit_trail(log: DataFrame, case_id: str | None = None, limit: int = 100) -> DataFrame:
    """Newest audit events, of one case or of all."""
    if case_id:
        log = log.filter(F.col("case_id") == case_id)
    return (
        log.orderBy(F.desc("event_ts"), F.desc("event_id"))
        .limit(limit)
        .select("event_ts", "actor", "action", "case_id", "detail", "source")
    )


def audit_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(
        F.count("*").alias("events"), F.max("event_ts").alias("last_seen")
    )


def with_overall_pass(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "overall_pass",
        overall_pass(F.col("guardrail_pass"), F.col("groundedness"), F.col("completeness")),
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """Runs, mean judge scores and pass rates."""
    def rate(c: str):
        return F.round(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 3)

    return results.agg(
        F.count("*").alias("runs"),
        F.round(F.avg("groundedness"), 3).alias("avg_groundedness"),
        F.round(F.avg("completeness"), 3).alias("avg_completeness"),
        rate("guardrail_pass").alias("guardrail_pass_rate"),
        rate("overall_pass").alias("overall_pass_rate"),
    )
