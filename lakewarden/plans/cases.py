"""Case management: building, folding, reporting, evidence, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.config import (
    ANALYSTS, CASE_MOVES, CASE_STATUSES, DEFAULT_SLA_DAYS, SCENARIO_OF_ALERT, SLA_DAYS, TEAMS,
    SkewPolicy,
)
from lakewarden.functions import clock
from lakewarden.functions.scoring import lookup, severity_rank, sla_columns
from lakewarden.operators.ranking import row_index, top_k
from lakewarden.operators.skew import slice_hot_keys
from lakewarden.plans.risk import customer_entities
from lakewarden.schemas import CASE
from lakewarden.sources.tables import replace_slice

SANCTIONS_SCENARIO = "Sanctions/Watchlist Hit"
ANOMALY_SCENARIO = "Behavioural Anomaly"


def _as_cases(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in CASE])


def _round_robin(index: Column, entries: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Id and name picked by ``index`` from a fixed roster."""
    slot = (F.pmod(index, F.lit(len(entries))) + 1).cast("int")
    ids, names = (F.array(*[F.lit(e[i]) for e in entries]) for i in (0, 1))
    return F.element_at(ids, slot), F.element_at(names, slot)


# -- building ------------------------------------------------------------------


def build_cases(
    alerts: DataFrame, customers: DataFrame, emap: DataFrame, as_of,
    teams: Sequence[tuple[str, str]] = TEAMS, analysts: Sequence[tuple[str, str]] = ANALYSTS,
) -> DataFrame:
    """One case per alert, numbered in alert order and dealt round-robin.

    The number comes from range partitioning, not a global window. A party with
    several customers is represented by its smallest customer id.
    """
    person = (
        customer_entities(emap)
        .groupBy(F.col("entity_id").alias("primary_entity_id"))
        .agg(F.min("customer_id").alias("customer_id"))
    )
    order = ["alert_id", "alert_type", "triggered_at", "explanation"]
    slim = alerts.select(*order, "severity", "score", "primary_entity_id", F.col("evidence"))
    numbered = row_index(slim, order, "alert_num")
    named = numbered.join(person, "primary_entity_id", "left").join(
        customers.select("customer_id", F.col("full_name").alias("customer_name")),
        "customer_id", "left",
    )
    n = F.col("alert_num")
    team_id, team_name = _round_robin(n, teams)
    analyst_id, analyst_name = _round_robin(n, analysts)
    opened = F.to_date("triggered_at")
    target = lookup(F.col("severity"), SLA_DAYS, DEFAULT_SLA_DAYS)
    amount = F.coalesce(*[
        F.try_element_at("evidence", F.lit(k)).try_cast("double")
        for k in ("inflow", "total", "max_amount", "amount", "total_cash_in")
    ], F.lit(0.0))
    return _as_cases(
        named,
        case_id=F.concat(
            F.lit("CASE-"), F.lpad(n.cast("string"), F.greatest(F.lit(5), F.length(n.cast("string"))), F.lit("0"))
        ),
        alert_num=n,
        customer_id=F.col("customer_id"),
        customer_name=F.col("customer_name"),
        scenario=lookup(F.col("alert_type"), SCENARIO_OF_ALERT, "Related Account Movement"),
        priority=F.col("severity"),
        status=F.lit("new"),
        team_id=team_id,
        team_name=team_name,
        analyst_id=analyst_id,
        analyst_name=analyst_name,
        risk_score=F.least(F.lit(99), F.round(F.col("score") * 100).cast("int")),
        amount=amount,
        days_open=F.greatest(F.lit(0), F.datediff(clock.day(as_of), opened)),
        due_date=F.date_add(opened, target),
        investigation_hours=F.lit(0.0),
        opened_at=F.col("triggered_at"),
    )


def fold_cases(
    cases: DataFrame, hits: DataFrame, anomalies: DataFrame, customers: DataFrame, as_of
) -> DataFrame:
    """Replace the screening and anomaly families of a case table by fresh ones.

    Numbers of the families start at 90,000 and 95,000, or after the numbers before
    them where those are higher, so that no number is given twice.
    """
    families = F.col("scenario").isin(SANCTIONS_SCENARIO, ANOMALY_SCENARIO)
    used = F.coalesce(cases.filter(~families).agg(F.max("alert_num")).scalar(), F.lit(0))
    first_hit = F.greatest(F.lit(90000), used)
    first_odd = F.greatest(F.lit(95000), first_hit + hits.agg(F.count("*")).scalar())
    sw, fr = dict(TEAMS)["TEAM_SW"], dict(TEAMS)["TEAM_FR"]
    people = dict(ANALYSTS)
    common = {
        "status": F.lit("new"), "investigation_hours": F.lit(0.0), "opened_at": clock.at(as_of),
    }
    numbered = row_index(hits, ["screening_id", "source_id"], "n").join(
        customers.select(F.col("customer_id").alias("_cust")), F.col("source_id") == F.col("_cust"), "left"
    )
    listed = F.regexp_replace("watchlist_id", "[^0-9]", "").try_cast("int")
    screened = _as_cases(
        numbered,
        case_id=F.concat(F.lit("CASE-SCR-"), F.col("n").cast("string")),
        alert_num=F.col("n") + first_hit,
        customer_id=F.coalesce("_cust", "source_id"),
        customer_name=F.col("entity_name"),
        scenario=F.lit(SANCTIONS_SCENARIO),
        priority=lookup(F.col("confidence"), {"confirmed": "critical", "probable": "high"}, "medium"),
        team_id=F.lit("TEAM_SW"), team_name=F.lit(sw),
        analyst_id=F.lit("AN_LISA"), analyst_name=F.lit(people["AN_LISA"]),
        risk_score=F.round(60 + F.col("match_score") * 39),
        amount=F.lit(0.0),
        days_open=F.pmod(listed, F.lit(30)),
        due_date=F.date_add(clock.day(as_of), 7),
        **common,
    )
    odd = _as_cases(
        row_index(anomalies, ["customer_id"], "n"),
        case_id=F.concat(F.lit("CASE-ANO-"), F.col("n").cast("string")),
        alert_num=F.col("n") + first_odd,
        customer_id=F.col("customer_id"),
        customer_name=F.col("full_name"),
        scenario=F.lit(ANOMALY_SCENARIO),
        priority=F.col("severity"),
        team_id=F.lit("TEAM_FR"), team_name=F.lit(fr),
        analyst_id=F.lit("AN_MARIA"), analyst_name=F.lit(people["AN_MARIA"]),
        risk_score=F.least(F.lit(99.0), F.round(50 + F.col("anomaly_score") * 8)),
        amount=F.col("total_value"),
        days_open=F.pmod((F.col("anomaly_score") * 10).cast("int"), F.lit(30)),
        due_date=F.date_add(clock.day(as_of), 5),
        **common,
    )
    return replace_slice(cases, families, screened.unionByName(odd))


# -- executive reports ---------------------------------------------------------


def _closed() -> Column:
    return F.col("status") == "closed"


def _past_due(as_of) -> Column:
    return (F.col("due_date") < clock.day(as_of)) & ~_closed()


def exec_kpis(cases: DataFrame, as_of) -> DataFrame:
    today = clock.day(as_of)
    upcoming = F.col("due_date").between(today, F.date_add(today, 14)) & ~_closed()
    closed = F.count_if(_closed())
    return cases.agg(
        F.round(F.sum("amount") / 1e6, 2).alias("transaction_amount_m"),
        F.count("*").alias("case_volume"),
        F.count_if(upcoming).alias("upcoming_deadlines"),
        F.round(F.avg("investigation_hours"), 2).alias("avg_investigation_hours"),
        F.round(
            100.0 * F.count_if(_closed() & (F.col("risk_score") < 60)) / F.nullif(closed, F.lit(0)), 1
        ).alias("false_positive_rate"),
        F.count_if(_past_due(as_of)).alias("past_due_alerts"),
    )


def by_scenario(cases: DataFrame) -> DataFrame:
    return cases.groupBy("scenario").agg(F.count("*").alias("alerts")).orderBy(
        F.desc("alerts"), "scenario"
    )


def priority_status(cases: DataFrame) -> DataFrame:
    return cases.groupBy("priority", "status").agg(F.count("*").alias("alerts"))


def resolution_flow(cases: DataFrame) -> DataFrame:
    """Flow links scenario -> team and team -> status from one pass over the cases."""
    cube = cases.groupBy("scenario", "team_name", "status").agg(F.count("*").alias("n"))
    links = F.array(
        F.struct(F.lit(0).alias("stage"), F.col("scenario").alias("source"), F.col("team_name").alias("target")),
        F.struct(F.lit(1).alias("stage"), F.col("team_name").alias("source"), F.col("status").alias("target")),
    )
    return (
        cube.select("n", F.explode(links).alias("l"))
        .groupBy("l.stage", "l.source", "l.target")
        .agg(F.sum("n").alias("value"))
        .drop("stage")
    )


def team_performance(cases: DataFrame, as_of) -> DataFrame:
    return cases.groupBy("team_name").agg(
        F.count("*").alias("cases"),
        F.count_if(_closed()).alias("closed"),
        F.count_if(_past_due(as_of)).alias("past_due"),
        F.round(F.avg("investigation_hours"), 2).alias("avg_hours"),
        F.round(F.avg("risk_score"), 0).alias("avg_risk"),
    )


def daily_new(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.to_date("opened_at").alias("d")).agg(F.count("*").alias("alerts"))


def outstanding(cases: DataFrame) -> DataFrame:
    return cases.filter(~_closed()).groupBy("due_date").agg(F.count("*").alias("alerts"))


# -- analyst queue -------------------------------------------------------------


def analyst_kpis(cases: DataFrame) -> DataFrame:
    """Headline numbers of every analyst's queue."""
    return cases.groupBy("analyst_id").agg(
        F.count_if(F.col("priority") == "critical").alias("critical"),
        F.count_if(F.col("priority") == "high").alias("high"),
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "new").alias("new_alerts"),
    )


def analyst_weekly(cases: DataFrame) -> DataFrame:
    return cases.groupBy(
        "analyst_id", F.date_trunc("WEEK", "opened_at").alias("week"), "scenario"
    ).agg(F.count("*").alias("alerts"))


def analyst_active(
    cases: DataFrame, scores: DataFrame, analyst_id: str, priority: str | None = None,
    scenario: str | None = None, limit: int = 100,
) -> DataFrame:
    """Open cases of one analyst by risk, priority and age, with service-level columns.

    An unknown priority is ignored rather than matched.
    """
    mine = cases.filter((F.col("analyst_id") == analyst_id) & ~_closed())
    if priority and priority.lower() in SLA_DAYS:
        mine = mine.filter(F.col("priority") == priority.lower())
    if scenario:
        mine = mine.filter(F.col("scenario") == scenario)
    ranked = mine.join(scores.select("case_id", "ai_risk", "model_version"), "case_id", "left")
    return (
        ranked.orderBy(
            F.coalesce("ai_risk", "risk_score").desc(), severity_rank(F.col("priority")),
            F.desc("days_open"), "case_id",
        )
        .limit(limit)
        .select(
            "case_id", "alert_num", "customer_name", "scenario", "risk_score", "priority",
            "amount", "days_open", "status", "ai_risk", "model_version",
        )
        .withColumns(sla_columns(F.col("priority"), F.col("days_open")))
    )


# -- evidence ------------------------------------------------------------------


def case_transactions(cases, accounts, txns, k: int = 12) -> DataFrame:
    """Largest ``k`` transactions of every customer that has a case."""
    subjects = cases.select("customer_id").distinct()
    mine = accounts.join(subjects, "customer_id", "left_semi").select("customer_id", "account_id")
    rows = txns.select(
        "account_id", "transaction_id", "amount", "direction", "channel", "txn_ts",
        "counterparty_id",
    ).join(mine, "account_id")
    return top_k(rows, ["customer_id"], [F.desc("amount"), F.col("transaction_id")], k)


def case_counterparties(cases, accounts, txns, third_parties, k: int = 15) -> DataFrame:
    """First ``k`` distinct counterparties of every customer that has a case."""
    subjects = cases.select("customer_id").distinct()
    mine = accounts.join(subjects, "customer_id", "left_semi").select("customer_id", "account_id")
    pairs = (
        txns.filter(F.col("counterparty_id").isNotNull())
        .select("account_id", "counterparty_id")
        .distinct()
        .join(mine, "account_id")
        .select("customer_id", "counterparty_id")
        .distinct()
    )
    names = third_parties.select(
        F.col("third_party_id").alias("counterparty_id"), "full_name", "country"
    )
    return top_k(pairs, ["customer_id"], [F.col("counterparty_id")], k).join(
        names, "counterparty_id", "left"
    )


def _timeline(events: DataFrame, columns: Sequence[str], out: str, k: int) -> DataFrame:
    ident = next(c for c in events.columns if c.endswith("_id") and c != "case_id")
    newest = top_k(events, ["case_id"], [F.desc("created_at"), F.desc(ident)], k)
    entry = F.struct("created_at", ident, *columns)
    return newest.groupBy("case_id").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias(out)
    )


def case_evidence(
    cases, scores, accounts, txns, third_parties, notes, actions, hits, pkyc,
    k_txns: int = 12, k_parties: int = 15, k_events: int = 20,
) -> DataFrame:
    """Evidence pack of all cases at once; every nested list is bounded by its ``k``."""
    entry = F.struct(
        (-F.col("amount")).alias("_o"), "transaction_id", "amount", "direction", "channel",
        "txn_ts", "counterparty_id",
    )
    flagged = (
        case_transactions(cases, accounts, txns, k_txns)
        .groupBy("customer_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("transactions"))
    )
    network = (
        case_counterparties(cases, accounts, txns, third_parties, k_parties)
        .groupBy("customer_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("counterparty_id", "full_name", "country"))
            ).alias("network")
        )
    )
    named_hits = hits.select(
        F.col("entity_name").alias("customer_name"), "watch_name", "list_type", "confidence",
        "match_score", "screening_id",
    ).distinct()
    screened = (
        top_k(
            named_hits, ["customer_name"], [F.desc("match_score"), F.col("screening_id")], 10
        )
        .groupBy("customer_name")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (-F.col("match_score")).alias("_o"), "screening_id", "watch_name",
                        "list_type", "confidence",
                    )
                )
            ).alias("screening")
        )
    )
    risk = pkyc.select(
        "customer_id",
        F.struct("dynamic_risk", "risk_band", "edd_review_required", "risk_drivers").alias("pkyc"),
    )
    # a case is shuffled by name and by id while it is narrow; the customer's lists, the widest
    # part, are joined last and on one key, so that no later join shuffles them again
    packs = (
        cases.join(screened, "customer_name", "left")
        .join(scores.select("case_id", "ai_risk", "model_score", "rules_score"), "case_id", "left")
        .join(_timeline(notes, ["author", "note", "note_type"], "notes", k_events), "case_id", "left")
        .join(_timeline(actions, ["action", "reason", "actor"], "actions", k_events), "case_id", "left")
        .join(flagged, "customer_id", "left")
        .join(network, "customer_id", "left")
        .join(risk, "customer_id", "left")
    )
    keys = ["case_id", "customer_name", "customer_id"]
    return packs.select(
        *keys, *[c for c in cases.columns if c not in keys], "ai_risk", "model_score", "rules_score",
        "transactions", "network", "pkyc", "screening", "notes", "actions",
    )


# -- service levels and lifecycle ----------------------------------------------


def with_sla(cases: DataFrame) -> DataFrame:
    return cases.withColumns(sla_columns(F.col("priority"), F.col("days_open")))


def sla_report(cases: DataFrame) -> DataFrame:
    return with_sla(cases).groupBy("priority", "sla_status").agg(F.count("*").alias("cases"))


# Moves of one case folded inside one row; longer histories are cut in time.
MOVE_POLICY = SkewPolicy(hot_rows=5_000, slice_rows=2_000, max_hot_keys=1_000_000)

_REJECTED = "array<struct<event_id:string, target:string, reason:string>>"


def _moves_from(status: Column) -> Column:
    """Legal targets of a status; NULL when the status is unknown."""
    table = F.create_map(*[
        x for s, to in CASE_MOVES.items()
        for x in (F.lit(s), F.array(*[F.lit(t) for t in to]).cast("array<string>"))
    ])
    return F.try_element_at(table, F.coalesce(status, F.lit("")))


def _after(status: Column, target: Column) -> Column:
    legal = F.coalesce(F.array_contains(_moves_from(status), target), F.lit(False))
    return F.when(legal, target).otherwise(status)


def _refusal(status: Column, target: Column) -> Column:
    allowed = _moves_from(status)
    choices = F.when(F.size(allowed) == 0, "(none, terminal)").otherwise(
        F.array_join(F.sort_array(allowed), ", ")
    )
    return (
        F.when(allowed.isNull(), F.concat(F.lit("unknown current status "), F.coalesce(status, F.lit("NULL"))))
        .when(
            _moves_from(target).isNull(),
            F.concat(F.lit("unknown target status "), F.coalesce(target, F.lit("NULL"))),
        )
        .otherwise(
            F.concat(F.lit("cannot move "), status, F.lit(" to "), target, F.lit("; allowed: "), choices)
        )
    )


def _chain_slices(rows: pd.DataFrame) -> pd.DataFrame:
    """Start status of each slice of one long history (one row per slice)."""
    rows = rows.sort_values("_slice")
    status, starts = rows["status"].iloc[0], []
    for ends in rows["ends"]:
        starts.append(status)
        status = ends[CASE_STATUSES.index(status)] if status in CASE_STATUSES else status
    return pd.DataFrame(
        {"case_id": rows["case_id"], "_slice": rows["_slice"], "start": starts}
    )


def _replayed(cases: DataFrame, events: DataFrame, policy: SkewPolicy) -> DataFrame:
    """(case_id, slice, start, end, accepted, rejected) of every piece of history.

    A status machine composes: each piece of a long history is folded for every
    possible start status in parallel, and chaining the pieces afterwards only
    reads those small results.
    """
    typed = events.select(
        "case_id", F.col("event_ts").cast("timestamp").alias("event_ts"),
        F.col("event_id").cast("string").alias("event_id"), "target",
    )
    pieces = (
        slice_hot_keys(typed, ["case_id"], F.col("event_ts"), policy)
        .groupBy("case_id", "_slice", "_hot")
        .agg(F.sort_array(F.collect_list(F.struct("event_ts", "event_id", "target"))).alias("moves"))
        .join(cases.select("case_id", "status"), "case_id")
    )
    ends = F.transform(
        F.array(*[F.lit(s) for s in CASE_STATUSES]),
        lambda s: F.aggregate("moves", s, lambda cur, m: _after(cur, m["target"])),
    )
    chained = (
        pieces.filter("_hot")
        .select("case_id", "_slice", "status", ends.alias("ends"))
        .groupBy("case_id")
        .applyInPandas(_chain_slices, "case_id string, _slice bigint, start string")
    )
    whole = pieces.filter(~F.col("_hot")).withColumn("start", F.col("status"))
    long = pieces.filter("_hot").join(chained, ["case_id", "_slice"])
    columns = ["case_id", "_slice", "start", "moves"]
    state = f"struct<status:string, accepted:bigint, rejected:{_REJECTED}>"

    def apply(acc: Column, move: Column) -> Column:
        status, target = acc["status"], move["target"]
        legal = F.coalesce(F.array_contains(_moves_from(status), target), F.lit(False))
        refused = F.array(
            F.struct(
                move["event_id"].alias("event_id"), target.alias("target"),
                _refusal(status, target).alias("reason"),
            )
        )
        return F.struct(
            F.when(legal, target).otherwise(status).alias("status"),
            (acc["accepted"] + F.when(legal, 1).otherwise(0)).alias("accepted"),
            F.when(legal, acc["rejected"]).otherwise(F.concat(acc["rejected"], refused)).alias("rejected"),
        ).cast(state)

    start = F.struct(F.col("start"), F.lit(0), F.array()).cast(state)
    return whole.select(*columns).unionByName(long.select(*columns)).select(
        "case_id", "_slice", F.aggregate("moves", start, apply).alias("r")
    )


def replay_transitions(
    cases: DataFrame, events: DataFrame, policy: SkewPolicy = MOVE_POLICY
) -> DataFrame:
    """Final status of each case after its transition events, legal moves only."""
    outcome = _replayed(cases, events, policy).groupBy("case_id").agg(
        F.max_by("r.status", "_slice").alias("_final"),
        F.sum("r.accepted").alias("_ok"),
        F.sum(F.size("r.rejected")).alias("_bad"),
    )
    return cases.select("case_id", "status").join(outcome, "case_id", "left").select(
        "case_id", F.col("status").alias("initial_status"),
        F.coalesce("_final", "status").alias("final_status"),
        F.coalesce("_ok", F.lit(0)).alias("accepted"),
        F.coalesce("_bad", F.lit(0)).alias("rejected"),
    )


def rejected_transitions(
    cases: DataFrame, events: DataFrame, policy: SkewPolicy = MOVE_POLICY
) -> DataFrame:
    """One row per refused event with the reason."""
    return _replayed(cases, events, policy).select(
        "case_id", F.explode("r.rejected").alias("e")
    ).select("case_id", "e.*")


def four_eyes_violations(filings: DataFrame) -> DataFrame:
    """Filings without a second, different approver."""
    def plain(c: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))

    missing = plain("approved_by") == ""
    same = plain("approved_by") == plain("filed_by")
    return filings.filter(missing | same).withColumn(
        "violation", F.when(missing, "no approver").otherwise("approver is the filer")
    )


def effective_assignment(cases: DataFrame, assignments: DataFrame) -> DataFrame:
    """Newest analyst and newest named team folded over each case.

    A reassignment without a team leaves the team as the events before it set it.
    """
    newest = F.struct("event_ts", "event_id")
    has_team = F.nullif(F.col("team_id"), F.lit("")).isNotNull()
    folded = assignments.groupBy("case_id").agg(
        F.max_by(F.struct("analyst_id", "analyst_name"), newest).alias("_who"),
        F.max_by(F.struct("team_id", "team_name"), F.when(has_team, newest)).alias("_team"),
    )
    order = cases.columns
    joined = cases.join(folded, "case_id", "left")
    for part, fields in (("_who", ("analyst_id", "analyst_name")), ("_team", ("team_id", "team_name"))):
        joined = joined.withColumns({
            c: F.when(F.col(part).isNotNull(), F.col(part)[c]).otherwise(F.col(c)) for c in fields
        })
    return joined.select(*order)
