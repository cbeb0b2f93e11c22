"""The ten detector families and their union.

Each detector filters the ledger first (constant ranges reach the scan),
aggregates on the account with map-side combine, applies its threshold and only
then looks up customers and entities, so the lookups see alerts, not the ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.config import CASH_CHANNELS, AlertConfig, RingConfig, SkewPolicy
from lakewarden.functions import clock, geo
from lakewarden.operators.quality import RULES, enforce
from lakewarden.operators.rings import best_rings
from lakewarden.operators.skew import carry_last, previous
from lakewarden.schemas import ALERT


def _no_ids() -> Column:
    return F.array().cast("array<string>")


def attach_entity(df: DataFrame, accounts: DataFrame | None, emap: DataFrame) -> DataFrame:
    """Account -> customer -> entity; alerts of unresolved parties survive."""
    if accounts is not None:
        df = df.join(accounts.select("account_id", "customer_id"), "account_id", "left")
    return df.join(_entity_of(emap, "customer", "customer_id"), "customer_id", "left")


def _entity_of(emap: DataFrame, party_type: str, source: str) -> DataFrame:
    return emap.filter(F.col("party_type") == party_type).select(
        F.col("source_id").alias(source), "entity_id"
    )


def _alerts(
    df: DataFrame,
    alert_id: Column,
    alert_type: str,
    severity: Column | str,
    triggered_at: Column,
    score: Column | float,
    explanation: Column,
    evidence: dict[str, Column],
    account_ids: Column | None = None,
    related: Column | None = None,
    transaction_ids: Column | None = None,
) -> DataFrame:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    values = {
        "alert_id": alert_id,
        "alert_type": F.lit(alert_type),
        "severity": F.lit(severity) if isinstance(severity, str) else severity,
        "primary_entity_id": F.col("entity_id"),
        "related_entity_ids": _no_ids() if related is None else related,
        "account_ids": _no_ids() if account_ids is None else account_ids,
        "transaction_ids": _no_ids() if transaction_ids is None else transaction_ids,
        "triggered_at": triggered_at,
        "score": F.lit(score) if isinstance(score, float) else score,
        "explanation": explanation,
        "evidence": F.create_map(*pairs),
        "status": F.lit("new"),
        "analyst_feedback": F.lit(None),
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in ALERT])


def _with_ids(flagged: DataFrame, events: DataFrame) -> DataFrame:
    """Add the sorted ``txn_ids`` of flagged accounts, whatever their number."""
    ids = (
        events.join(flagged.select("account_id"), "account_id", "left_semi")
        .groupBy("account_id")
        .agg(F.sort_array(F.collect_set("transaction_id")).alias("txn_ids"))
    )
    return flagged.join(ids, "account_id", "left")


def alert_transactions(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """(alert_id, transaction_id) rows for account alerts, whatever their number."""
    owners = alerts.select("alert_id", F.explode("account_ids").alias("account_id"))
    return events.select("account_id", "transaction_id").distinct().join(
        owners, "account_id"
    ).select("alert_id", "transaction_id")


# -- rapid movement ------------------------------------------------------------


def rapid_events(txns: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return txns.filter(clock.within(F.col("txn_ts"), as_of, hours=hours))


def detect_rapid_movement(
    txns, accounts, emap, cfg=AlertConfig(), as_of=None, hours: int = 24,
    critical_inflow: float = 2_000_000.0,
) -> DataFrame:
    """Money that leaves almost as it came: inflow, then near-equal outflow."""
    events = rapid_events(txns, as_of, hours)
    credit, debit = (F.col("direction") == d for d in ("credit", "debit"))
    inflow, outflow = F.col("inflow"), F.col("outflow")
    flagged = (
        events.groupBy("account_id")
        .agg(
            F.sum(F.when(credit, F.col("amount"))).alias("inflow"),
            F.sum(F.when(debit, F.col("amount"))).alias("outflow"),
            F.min(F.when(credit, F.col("txn_ts"))).alias("first_credit"),
            F.max(F.when(debit, F.col("txn_ts"))).alias("last_debit"),
            F.max("txn_ts").alias("last_ts"),
            F.count("*").alias("n_txns"),
        )
        .filter(
            (inflow >= cfg.rapid_min_amount)
            & (outflow >= inflow * cfg.passthrough_ratio)
            & (F.col("first_credit") <= F.col("last_debit"))
        )
        .join(accounts.select("account_id", "customer_id"), "account_id")
    )
    df = attach_entity(_with_ids(flagged, events), None, emap)
    return _alerts(
        df,
        alert_id=F.concat(F.lit("ALRT-RM-"), "account_id"),
        alert_type="rapid_movement",
        severity=F.when(inflow >= critical_inflow, "critical").otherwise("high"),
        triggered_at=F.col("last_ts"),
        score=F.least(F.lit(1.0), F.round(outflow / inflow, 3)),
        explanation=F.concat(
            F.lit("Passthrough on account "), "account_id", F.lit(": "), clock.whole(outflow),
            F.lit(" out against "), clock.whole(inflow), F.lit(f" in within {hours}h."),
        ),
        evidence={"inflow": inflow, "outflow": outflow, "transaction_count": F.col("n_txns")},
        account_ids=F.array("account_id"),
        transaction_ids=F.col("txn_ids"),
    )


# -- frequency change ----------------------------------------------------------


def detect_frequency_change(
    txns, accounts, emap, cfg=AlertConfig(), as_of=None, baseline_days: int | None = None
) -> DataFrame:
    """Today's transaction count against the account's own earlier active days."""
    today = clock.day(as_of)
    scope = F.col("txn_ts") <= clock.at(as_of)
    if baseline_days is not None:
        scope = clock.within(F.col("txn_ts"), as_of, from_midnight=True, days=baseline_days)
    earlier = F.when(F.col("d") < today, F.col("c"))
    counts = (
        txns.filter(scope)
        .groupBy("account_id", F.to_date("txn_ts").alias("d"))
        .agg(F.count("*").alias("c"))
        .groupBy("account_id")
        .agg(
            F.sum(F.when(F.col("d") == today, F.col("c"))).alias("today_count"),
            F.avg(earlier).alias("avg_c"),
            F.stddev(earlier).alias("std_c"),
        )
        .filter(F.col("today_count").isNotNull() & F.col("avg_c").isNotNull())
    )
    n, mean, std = F.col("today_count"), F.col("avg_c"), F.col("std_c")
    z = F.when(std > 0, (n - mean) / std)
    flat = std.isNull() | (std == 0)
    fired = counts.withColumn("z", z).filter(
        (F.abs("z") >= cfg.freq_z) | (flat & (n >= F.greatest(F.lit(10.0), mean * 5)))
    )
    strength = F.abs(F.col("z"))
    return _alerts(
        attach_entity(fired, accounts, emap),
        alert_id=F.concat(F.lit("ALRT-FQ-"), "account_id"),
        alert_type="frequency_change",
        severity=F.when(F.coalesce(strength, F.lit(99.0)) >= 5, "critical").otherwise("high"),
        triggered_at=clock.at(as_of),
        score=F.least(F.lit(1.0), F.round(F.coalesce(strength, F.lit(9.0)) / 10.0, 3)),
        explanation=F.concat(
            F.lit("Account "), "account_id", F.lit(" made "), n.cast("string"),
            F.lit(" transactions today; earlier active days average "),
            F.format_string("%.1f", mean),
            F.when(F.col("z").isNotNull(), F.format_string(" (z=%.2f)", F.col("z"))).otherwise(""),
            F.lit("."),
        ),
        evidence={
            "today_count": n,
            "z": F.when(F.col("z").isNotNull(), F.format_string("%.2f", F.col("z"))).otherwise("n/a"),
        },
        account_ids=F.array("account_id"),
    )


# -- circular flow -------------------------------------------------------------


def material_transfers(txns: DataFrame, as_of, ring: RingConfig) -> DataFrame:
    return txns.filter(
        clock.within(F.col("txn_ts"), as_of, days=ring.window_days)
        & (F.col("amount") >= ring.min_amount)
        & F.col("from_acct").isNotNull()
        & F.col("to_acct").isNotNull()
        & (F.col("from_acct") != F.col("to_acct"))
    ).select("from_acct", "to_acct", "amount")


def detect_circular_flow(
    txns, accounts, emap, ring=RingConfig(), as_of=None, simple_only: bool = False
) -> DataFrame:
    """Money back at its origin after three or more hops."""
    rings = best_rings(
        material_transfers(txns, as_of, ring), ring.min_hops, ring.max_hops, simple_only
    )
    df = attach_entity(rings.withColumn("account_id", F.col("origin")), accounts, emap)
    hops = F.col("depth").cast("string")
    return _alerts(
        df,
        alert_id=F.concat(F.lit("ALRT-RING-"), "origin"),
        alert_type="circular_flow",
        severity="critical",
        triggered_at=clock.at(as_of),
        score=0.95,
        explanation=F.concat(
            F.lit("Funds return to "), "origin", F.lit(" after "), hops,
            F.lit(" hops; total moved "), clock.whole(F.col("total")), F.lit("."),
        ),
        evidence={
            "path": F.array_join("path", " -> "),
            "hops": hops,
            "total": clock.whole(F.col("total")),
        },
        account_ids=F.col("path"),
    )


# -- dormant reactivation ------------------------------------------------------


def dormant_events(txns: DataFrame, cfg: AlertConfig, as_of, window_days: int = 7) -> DataFrame:
    recent = clock.within(F.col("txn_ts"), as_of, from_midnight=True, days=window_days)
    return txns.filter(recent & (F.col("amount") >= cfg.dormant_high_value))


def detect_dormant(
    txns, accounts, emap, cfg=AlertConfig(), as_of=None, window_days: int = 7
) -> DataFrame:
    """High-value activity on an account that had been idle."""
    events = dormant_events(txns, cfg, as_of, window_days)
    idle = accounts.filter(
        F.col("last_activity_before_ts")
        < clock.at(as_of) - F.make_dt_interval(F.lit(cfg.dormant_days))
    ).select("account_id", "customer_id")
    flagged = (
        events.groupBy("account_id")
        .agg(
            F.max("amount").alias("max_amount"),
            F.max("txn_ts").alias("last_ts"),
            F.count("*").alias("n_txns"),
        )
        .join(idle, "account_id")
    )
    df = attach_entity(_with_ids(flagged, events), None, emap)
    return _alerts(
        df,
        alert_id=F.concat(F.lit("ALRT-DORM-"), "account_id"),
        alert_type="dormant_reactivation",
        severity="high",
        triggered_at=F.col("last_ts"),
        score=0.8,
        explanation=F.concat(
            F.lit("Idle account "), "account_id", F.lit(" came back with a transaction of "),
            clock.whole(F.col("max_amount")), F.lit("."),
        ),
        evidence={"max_amount": F.col("max_amount"), "transaction_count": F.col("n_txns")},
        account_ids=F.array("account_id"),
        transaction_ids=F.col("txn_ids"),
    )


# -- risk rating change --------------------------------------------------------


def detect_risk_rating_change(
    ratings, emap, cfg=AlertConfig(), policy=SkewPolicy()
) -> DataFrame:
    """Upward jump of more than ``risk_jump`` bands between consecutive ratings."""
    steps = previous(
        ratings.select("entity_id", "entity_type", "risk_rating", "rated_at", "rating_id"),
        ["entity_id"], ["rated_at", "rating_id"], {"prev_rating": "risk_rating"}, policy,
    ).filter(F.col("risk_rating") > F.col("prev_rating") + cfg.risk_jump)
    ids = emap.select(
        F.col("source_id").alias("subject"), F.col("party_type").alias("entity_type"), "entity_id"
    )
    df = steps.withColumnRenamed("entity_id", "subject").join(
        ids, ["subject", "entity_type"], "left"
    )
    new, old = F.col("risk_rating"), F.col("prev_rating")
    return _alerts(
        df,
        alert_id=F.concat_ws(
            "-", F.lit("ALRT-RISK"), "subject", F.date_format("rated_at", "yyyyMMdd")
        ),
        alert_type="risk_rating_change",
        severity=F.when(new >= 5, "critical").otherwise("high"),
        triggered_at=F.col("rated_at"),
        score=F.least(F.lit(1.0), (new - old) / 5.0),
        explanation=F.concat(
            F.lit("Risk band of "), "subject", F.lit(" rose from "), old.cast("string"),
            F.lit(" to "), new.cast("string"), F.lit("."),
        ),
        evidence={"prev_rating": old, "new_rating": new},
    )


# -- adverse media -------------------------------------------------------------


#: Distinct entity names that are broadcast to pick mentions ahead of the shuffle, at most.
MAX_BROADCAST_NAMES = 200_000


def media_matches(entities: DataFrame, media: DataFrame) -> DataFrame:
    """Entity-article pairs by exact name: exploded names meet entities in an equi-join.

    A counted list of entity names is broadcast first, so that only mentions of an
    entity are shuffled; a longer list takes the equi-join of all mentions.
    """
    mentions = media.select(
        *[c for c in media.columns if c != "named_entities"],
        F.explode(F.array_distinct("named_entities")).alias("full_name"),
    )
    names = entities.select("full_name").filter(F.col("full_name").isNotNull()).distinct()
    if names.limit(MAX_BROADCAST_NAMES + 1).count() <= MAX_BROADCAST_NAMES:
        mentions = mentions.join(F.broadcast(names), "full_name", "left_semi")
    return entities.select("entity_id", "source_id", "party_type", "full_name").join(
        mentions, "full_name"
    )


def detect_adverse_media(entities: DataFrame, media: DataFrame) -> DataFrame:
    articles = media.select("article_id", "headline", "published_at", "named_entities")
    return _alerts(
        media_matches(entities, articles),
        alert_id=F.concat_ws("-", F.lit("ALRT-AM"), "entity_id", "article_id"),
        alert_type="adverse_media",
        severity="high",
        triggered_at=F.col("published_at").cast("timestamp"),
        score=0.85,
        explanation=F.concat(
            F.lit("Adverse media names "), "full_name", F.lit(': "'), "headline", F.lit('".')
        ),
        evidence={"article_id": F.col("article_id"), "headline": F.col("headline")},
    )


# -- beneficial ownership change -----------------------------------------------


def detect_ubo_change(ownership, emap, policy=SkewPolicy()) -> DataFrame:
    """The registered beneficial owner differs from the one before."""
    steps = previous(
        ownership.select("entity_id", "ubo_entity_id", "effective_from", "ubo_id"),
        ["entity_id"], ["effective_from", "ubo_id"], {"prev_ubo": "ubo_entity_id"}, policy,
    ).filter(F.col("ubo_entity_id") != F.col("prev_ubo"))
    df = steps.withColumnRenamed("entity_id", "subject").join(
        _entity_of(emap, "third_party", "subject"), "subject", "left"
    )
    return _alerts(
        df,
        alert_id=F.concat_ws(
            "-", F.lit("ALRT-UBO"), "subject", F.date_format("effective_from", "yyyyMMdd")
        ),
        alert_type="ubo_change",
        severity="high",
        triggered_at=F.col("effective_from"),
        score=0.75,
        explanation=F.concat(
            F.lit("Beneficial owner of "), "subject", F.lit(" is now "), "ubo_entity_id",
            F.lit(", formerly "), "prev_ubo", F.lit("."),
        ),
        evidence={"prev_ubo": F.col("prev_ubo"), "new_ubo": F.col("ubo_entity_id")},
        related=F.array("ubo_entity_id"),
    )


# -- account takeover ----------------------------------------------------------


def takeover_drains(
    auth, txns, cfg=AlertConfig(), policy=SkewPolicy(), minutes: int = 60
) -> DataFrame:
    """High-value debits with the latest login anomaly at most an hour before.

    Anomalies and debits are merged into one ordered stream per account and the
    last anomaly is carried forward: one row per debit, no anomaly-debit pairs.
    """
    anomalies = auth.filter(
        F.col("new_device") | F.col("new_geo") | F.col("credential_change")
    ).select(
        "account_id", F.col("event_ts").alias("ts"), F.lit(0).alias("kind"),
        F.col("event_id").alias("ident"), F.lit(None).cast("double").alias("amount"),
        F.col("geo_city"),
    )
    debits = txns.filter(
        (F.col("direction") == "debit") & (F.col("amount") >= cfg.ato_amount)
    ).select(
        "account_id", F.col("txn_ts").alias("ts"), F.lit(1).alias("kind"),
        F.col("transaction_id").alias("ident"), "amount",
        F.lit(None).cast("string").alias("geo_city"),
    )
    merged = carry_last(
        anomalies.unionByName(debits), ["account_id"], ["ts", "kind", "ident"],
        F.struct("ts", "geo_city"), "anomaly", where=F.col("kind") == 0, policy=policy,
    )
    reach = F.col("anomaly.ts") + F.make_dt_interval(mins=F.lit(minutes))
    return merged.filter((F.col("kind") == 1) & (F.col("ts") <= reach)).select(
        "account_id", F.col("ident").alias("transaction_id"), "amount",
        F.col("ts").alias("txn_ts"), F.col("anomaly.ts").alias("anomaly_ts"),
        F.col("anomaly.geo_city").alias("geo_city"),
    )


def detect_account_takeover(
    auth, txns, accounts, emap, cfg=AlertConfig(), policy=SkewPolicy()
) -> DataFrame:
    """Login anomaly, then a large debit: the largest drain per account."""
    drains = takeover_drains(auth, txns, cfg, policy)
    columns = [c for c in drains.columns if c != "account_id"]
    largest = (
        drains.groupBy("account_id")
        .agg(
            F.max_by(
                F.struct(*columns), F.struct("amount", "txn_ts", "transaction_id")
            ).alias("d")
        )
        .select("account_id", *[F.col("d")[c].alias(c) for c in columns])
    )
    city = F.coalesce(F.col("geo_city"), F.lit(""))
    return _alerts(
        attach_entity(largest, accounts, emap),
        alert_id=F.concat(F.lit("ALRT-ATO-"), "account_id"),
        alert_type="account_takeover",
        severity="critical",
        triggered_at=F.col("txn_ts"),
        score=0.9,
        explanation=F.concat(
            F.lit("Debit of "), clock.whole(F.col("amount")), F.lit(" on "), "account_id",
            F.lit(" within 1h of a login anomaly ("),
            F.coalesce(F.col("geo_city"), F.lit("place unknown")), F.lit(")."),
        ),
        evidence={"geo_city": city, "amount": F.col("amount")},
        account_ids=F.array("account_id"),
        transaction_ids=F.array("transaction_id"),
    )


# -- impossible travel ---------------------------------------------------------

_TAP = ["txn_ts", "lat", "lon", "city", "country", "merchant"]


def tap_pairs(cards: DataFrame, policy=SkewPolicy()) -> DataFrame:
    """Each tap with the previous one of its card and the implied speed."""
    columns = ["card_id", "account_id", "card_txn_id", *_TAP]
    taps = previous(
        cards.select(*[c for c in columns if c in cards.columns]),
        ["card_id"], ["txn_ts", "card_txn_id"],
        {f"prev_{c}": c for c in _TAP if c in cards.columns}, policy,
    )
    km = geo.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    return taps.withColumn(
        "implied_kmh", geo.speed_kmh(km, F.col("prev_txn_ts"), F.col("txn_ts"))
    )


def detect_impossible_travel(
    cards, accounts, emap, cfg=AlertConfig(), policy=SkewPolicy()
) -> DataFrame:
    """Two consecutive taps of one card too far apart for the time between them."""
    fast = tap_pairs(cards, policy).filter(F.col("implied_kmh") > cfg.max_feasible_kmh)
    return travel_alerts(fast, accounts, emap)


def travel_alerts(fast: DataFrame, accounts: DataFrame, emap: DataFrame) -> DataFrame:
    speed = clock.whole(F.col("implied_kmh"))
    places = [F.coalesce(F.col(c), F.lit("")) for c in ("prev_city", "city")]
    return _alerts(
        attach_entity(fast, accounts, emap),
        alert_id=F.concat_ws(
            "-", F.lit("ALRT-TRV"), "card_id", F.date_format("txn_ts", "yyyyMMddHHmm")
        ),
        alert_type="impossible_travel",
        severity="critical",
        triggered_at=F.col("txn_ts"),
        score=F.least(F.lit(1.0), F.round(F.col("implied_kmh") / 2000.0, 3)),
        explanation=F.concat(
            F.lit("Card "), "card_id", F.lit(" went from "), places[0], F.lit(" to "), places[1],
            F.lit(" at an implied "), speed, F.lit(" km/h."),
        ),
        evidence={"from_city": places[0], "to_city": places[1], "implied_kmh": speed},
        account_ids=F.array("account_id"),
    )


# -- cash structuring ----------------------------------------------------------


def structuring_events(txns: DataFrame, cfg: AlertConfig, as_of) -> DataFrame:
    """Cash deposits just below the reporting threshold in the look-back window."""
    return txns.filter(
        (F.col("direction") == "credit")
        & F.col("channel").isin(CASH_CHANNELS)
        & (F.col("merchant_category") == "cash")
        & (F.col("amount") >= cfg.struct_min_ratio * cfg.ctr_threshold)
        & (F.col("amount") < cfg.ctr_threshold)
        & clock.within(F.col("txn_ts"), as_of, days=cfg.struct_window_days)
    )


def detect_structuring(txns, accounts, emap, cfg=AlertConfig(), as_of=None) -> DataFrame:
    """Clusters of sub-threshold cash deposits into one account."""
    events = structuring_events(txns, cfg, as_of)
    n = F.col("near_deposits")
    flagged = (
        events.groupBy("account_id")
        .agg(
            F.count("*").alias("near_deposits"),
            F.sum("amount").alias("total_cash_in"),
            F.max("txn_ts").alias("last_ts"),
        )
        .filter(n >= cfg.struct_min_count)
        .join(accounts.select("account_id", "customer_id"), "account_id")
    )
    df = attach_entity(_with_ids(flagged, events), None, emap)
    total = clock.whole(F.col("total_cash_in"))
    return _alerts(
        df,
        alert_id=F.concat(F.lit("ALRT-STRUCT-"), "account_id"),
        alert_type="structuring",
        severity=F.when(n >= 5, "critical").otherwise("high"),
        triggered_at=F.col("last_ts"),
        score=F.least(F.lit(1.0), F.round(n / 6.0, 3)),
        explanation=F.concat(
            F.lit("Account "), "account_id", F.lit(" took "), n.cast("string"),
            F.lit(" cash deposits just under the reporting threshold within "),
            F.lit(f"{cfg.struct_window_days} days, together "), total, F.lit("."),
        ),
        evidence={"near_deposits": n, "total_cash_in": total},
        account_ids=F.array("account_id"),
        transaction_ids=F.col("txn_ids"),
    )


# -- union ---------------------------------------------------------------------


def fraud_alerts(*families: DataFrame) -> DataFrame:
    """All families in one relation; rows breaking an alert invariant are dropped."""
    return enforce(reduce(DataFrame.unionByName, families), RULES["alerts"])
