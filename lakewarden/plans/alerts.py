"""Alert queue: effective status, filtered list, history, summaries, metric view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import clock
from lakewarden.functions.scoring import severity_rank
from lakewarden.operators.conform import dedupe_latest
from lakewarden.operators.ranking import top_k


def _is_critical() -> Column:
    return F.col("severity") == "critical"


def effective_status(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Newest analyst feedback folded over the alert's default status."""
    latest = dedupe_latest(
        feedback.select("alert_id", F.col("status").alias("_fb"), "created_at", "feedback_id"),
        ["alert_id"], ["created_at", "feedback_id"],
    ).select("alert_id", "_fb")
    return (
        alerts.join(latest, "alert_id", "left")
        .withColumn("status", F.coalesce("_fb", "status"))
        .drop("_fb")
    )


def alert_queue(
    alerts: DataFrame,
    feedback: DataFrame,
    alert_type: str | None = None,
    severity: str | None = None,
    status: str | None = None,
    limit: int = 200,
) -> DataFrame:
    """Filtered queue, most severe and newest first."""
    for name, wanted in (("alert_type", alert_type), ("severity", severity)):
        if wanted:
            alerts = alerts.filter(F.col(name) == wanted)
    queue = effective_status(alerts, feedback)
    if status:
        queue = queue.filter(F.col("status") == status)
    return (
        queue.orderBy(severity_rank(F.col("severity")), F.desc("triggered_at"), "alert_id")
        .limit(limit)
        .select(
            "alert_id", "alert_type", "severity", "primary_entity_id", "account_ids",
            "triggered_at", "score", "explanation", "status",
        )
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Counts by type plus the grand total (``is_total``) in one rollup."""
    return (
        alerts.rollup("alert_type")
        .agg(
            F.count("*").alias("cnt"),
            F.count_if(_is_critical()).alias("critical"),
            F.countDistinct("primary_entity_id").alias("entities"),
            (F.grouping("alert_type") == 1).alias("is_total"),
        )
    )


def alert_history(alerts: DataFrame, feedback: DataFrame, k: int = 5) -> DataFrame:
    """Alert detail with its last ``k`` feedback rows, for any set of alerts.

    The newest row of a history also gives the effective status, so that the feedback
    is shuffled once; feedback without an alert id is left at its scan.
    """
    known = feedback.filter(F.col("alert_id").isNotNull())
    latest = top_k(known, ["alert_id"], [F.desc("created_at"), F.desc("feedback_id")], k)
    entry = F.struct(
        "created_at", "feedback_id", F.col("status").alias("status"), "analyst_feedback", "analyst"
    )
    history = latest.groupBy("alert_id").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("feedback_history")
    )
    newest = F.get("feedback_history", F.lit(0))["status"]
    return alerts.join(history, "alert_id", "left").withColumn("status", F.coalesce(newest, "status"))


def high_severity_feed(alerts: DataFrame, link_base: str = "/alerts/") -> DataFrame:
    """High and critical alerts with a deep link each."""
    return alerts.filter(F.col("severity").isin("high", "critical")).select(
        "alert_id", "alert_type", "severity", "primary_entity_id", "score", "explanation",
        "triggered_at", F.concat(F.lit(link_base), "alert_id").alias("app_link"),
    )


def weekly_report(alerts: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Alerts of the trailing week by type."""
    return (
        alerts.filter(clock.within(F.col("triggered_at"), as_of, days=days))
        .groupBy("alert_type")
        .agg(
            F.count("*").alias("alerts_this_week"),
            F.count_if(_is_critical()).alias("critical_this_week"),
            F.countDistinct("primary_entity_id").alias("entities"),
        )
    )


@dataclass(frozen=True)
class MetricView:
    """Named dimensions and measures over one relation."""

    source: DataFrame
    dimensions: Mapping[str, Column]
    measures: Mapping[str, Column]

    def query(self, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
        keys = [self.dimensions[d].alias(d) for d in dims]
        return self.source.groupBy(*keys).agg(*[self.measures[m].alias(m) for m in measures])


def alert_metrics(alerts: DataFrame) -> MetricView:
    return MetricView(
        alerts,
        {
            "alert_type": F.col("alert_type"),
            "severity": F.col("severity"),
            "status": F.col("status"),
            "primary_entity": F.col("primary_entity_id"),
            "triggered_date": F.to_date("triggered_at"),
        },
        {
            "alert_count": F.count("*"),
            "distinct_entities": F.countDistinct("primary_entity_id"),
            "critical_alerts": F.count_if(_is_critical()),
            "average_score": F.avg("score"),
        },
    )
