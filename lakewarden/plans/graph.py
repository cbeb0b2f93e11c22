"""Entity graph: edge list, ego networks, seeds, relations and travel legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.config import SkewPolicy
from lakewarden.functions import clock
from lakewarden.operators.ranking import top_k
from lakewarden.plans.detectors import tap_pairs
from lakewarden.plans.risk import customer_entities


def _acct(c: str):
    return F.concat(F.lit("ACCT:"), c)


def entity_network(accounts, txns, ownership, emap, as_of, days: int = 30) -> DataFrame:
    """Ownership, transfer and beneficial-owner edges with weights."""
    owns = accounts.join(customer_entities(emap), "customer_id").select(
        F.col("entity_id").alias("source_entity_id"),
        _acct("account_id").alias("target_entity_id"),
        F.lit("owns_account").alias("edge_type"),
        F.lit(1.0).alias("weight"),
        F.create_map(F.lit("account_type"), "account_type").alias("evidence"),
    )
    transfers = (
        txns.filter(
            clock.within(F.col("txn_ts"), as_of, days=days)
            & F.col("from_acct").isNotNull()
            & F.col("to_acct").isNotNull()
            & (F.col("from_acct") != F.col("to_acct"))
        )
        .groupBy("from_acct", "to_acct")
        .agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
        .select(
            _acct("from_acct").alias("source_entity_id"),
            _acct("to_acct").alias("target_entity_id"),
            F.lit("transacts_with").alias("edge_type"),
            F.col("n").cast("double").alias("weight"),
            F.create_map(F.lit("total_amount"), clock.whole(F.col("total"))).alias("evidence"),
        )
    )
    firms = emap.filter(F.col("party_type") == "third_party")
    owned = firms.select(F.col("source_id").alias("entity_id"), F.col("entity_id").alias("_owned"))
    owner = firms.select(
        F.col("source_id").alias("ubo_entity_id"), F.col("entity_id").alias("_owner")
    )
    holdings = (
        ownership.join(owned, "entity_id", "left")
        .join(owner, "ubo_entity_id", "left")
        .select(
            F.col("_owned").alias("source_entity_id"),
            F.coalesce("_owner", "ubo_entity_id").alias("target_entity_id"),
            F.lit("beneficial_owner").alias("edge_type"),
            (F.col("ownership_pct") / 100.0).alias("weight"),
            F.create_map(
                F.lit("effective_from"), F.col("effective_from").cast("string")
            ).alias("evidence"),
        )
    )
    return owns.unionByName(transfers).unionByName(holdings)


def ego_edges(edges: DataFrame, egos: DataFrame, limit: int = 200) -> DataFrame:
    """Up to ``limit`` edges touching each ego id (column ``ego``).

    Two equi-joins instead of one OR condition; a self-loop counts once.
    """
    out = edges.join(egos, edges.source_entity_id == egos.ego)
    into = edges.filter(
        ~F.col("source_entity_id").eqNullSafe(F.col("target_entity_id"))
    ).join(egos, F.col("target_entity_id") == egos.ego)
    touching = out.unionByName(into).select(
        "ego", "source_entity_id", "target_entity_id", "edge_type", "weight"
    )
    order = [F.col(c) for c in ("source_entity_id", "target_entity_id", "edge_type", "weight")]
    return top_k(touching, ["ego"], order, limit)


def ego_nodes(ego: DataFrame, entities: DataFrame) -> DataFrame:
    """Node set of ego edges with label and kind."""
    ends = ["source_entity_id", "target_entity_id"]
    nodes = ego.select("ego", F.explode(F.array(*ends)).alias("id")).filter(
        F.col("id").isNotNull()
    ).distinct()
    labels = entities.groupBy(F.col("entity_id").alias("id")).agg(
        F.max("full_name").alias("_name"), F.max("party_type").alias("_kind")
    )
    kind = F.when(F.col("id").startswith("ACCT:"), "account").otherwise("other")
    return nodes.join(labels, "id", "left").select(
        "ego", "id",
        F.coalesce("_name", "id").alias("label"),
        F.coalesce(F.col("_kind"), kind).alias("kind"),
    )


def graph_seeds(
    cases, customers, c360, accounts, txns, third_parties, keyword: str | None = None,
    limit: int = 12,
) -> DataFrame:
    """Customers for the graph: text matches first, then the highest case score."""
    scores = cases.groupBy("customer_id", "scenario").agg(F.max("risk_score").alias("s"))
    base = scores.join(
        customers.select("customer_id", "full_name", "city", "country", "address"), "customer_id"
    ).join(
        c360.select("customer_id", F.col("current_risk_rating").alias("_rating")),
        "customer_id", "left",
    )
    hit = F.lit(0)
    if keyword and keyword.strip():
        needle = f"%{keyword.split()[0]}%"
        named = third_parties.filter(F.col("full_name").ilike(needle)).select(
            F.col("third_party_id").alias("counterparty_id")
        )
        linked = (
            txns.select("account_id", "counterparty_id")
            .join(named, "counterparty_id", "left_semi")
            .select("account_id")
            .distinct()
            .join(accounts.select("account_id", "customer_id"), "account_id")
            .select("customer_id", F.lit(1).alias("_linked"))
            .distinct()
        )
        base = base.join(linked, "customer_id", "left")
        text = [F.col(c).ilike(needle) for c in ("full_name", "scenario", "address")]
        hit = F.when(text[0] | text[1] | text[2] | F.col("_linked").isNotNull(), 1).otherwise(0)
    return (
        base.withColumn("_hit", hit)
        .groupBy("customer_id", "full_name", "city", "country", "_rating")
        .agg(F.max("s").alias("max_score"), F.max("_hit").alias("is_match"))
        .orderBy(F.desc("is_match"), F.desc("max_score"), "customer_id")
        .limit(limit)
        .select(
            "customer_id", "full_name", "city", "country",
            F.coalesce("_rating", F.lit(3)).alias("risk"), "max_score", "is_match",
        )
    )


def graph_rels(seeds, accounts, txns, third_parties, k: int = 12) -> DataFrame:
    """First ``k`` account-counterparty rows of each seed customer."""
    mine = accounts.join(seeds.select("customer_id"), "customer_id", "left_semi").select(
        "customer_id", "account_id"
    )
    # the ledger is cut to k rows per account first, so that a busy account is never joined whole
    firsts = top_k(txns.select("account_id", "counterparty_id"), ["account_id"], [F.col("counterparty_id")], k)
    rows = mine.join(firsts, "account_id", "left")
    capped = top_k(rows, ["customer_id"], [F.col("account_id"), F.col("counterparty_id")], k)
    names = third_parties.select(
        F.col("third_party_id").alias("counterparty_id"), F.col("full_name").alias("cp_name")
    )
    return capped.join(names, "counterparty_id", "left").select(
        "customer_id", "account_id", "counterparty_id", "cp_name"
    )


def travel_legs(alerts: DataFrame, cards: DataFrame, policy=SkewPolicy()) -> DataFrame:
    """Both taps behind each travel alert: leg 0 arrives, leg 1 departs.

    Pairs follow the card, as the detector does, and meet the alert on account
    and second.
    """
    wanted = alerts.filter(F.col("alert_type") == "impossible_travel").select(
        "alert_id", F.get("account_ids", F.lit(0)).alias("account_id"),
        F.date_trunc("SECOND", "triggered_at").alias("_second"),
    )
    # only cards with a tap on an alerted account can have a pair there
    used = cards.join(wanted.select("account_id").distinct(), "account_id", "left_semi").select("card_id").distinct()
    cards = cards.join(used, "card_id", "left_semi")
    pairs = tap_pairs(cards, policy).filter(F.col("prev_txn_ts").isNotNull()).withColumn(
        "_second", F.date_trunc("SECOND", "txn_ts")
    )
    leg = ["city", "country", "lat", "lon", "txn_ts", "merchant"]
    arrive = F.struct(F.lit(0).alias("leg_order"), *[F.col(c) for c in leg])
    depart = F.struct(F.lit(1).alias("leg_order"), *[F.col(f"prev_{c}").alias(c) for c in leg])
    return (
        pairs.join(wanted, ["account_id", "_second"])
        .select("alert_id", F.explode(F.array(arrive, depart)).alias("leg"))
        .select("alert_id", "leg.*")
    )
