"""Customer risk marts: turnover, 360 profile, perpetual KYC, peers, typologies.

Every signal is aggregated to one row per account, then per customer, before
any join; the joins are key-unique on their right side.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.config import HIGH_RISK_COUNTRIES
from lakewarden.functions import clock
from lakewarden.operators.conform import dedupe_latest
from lakewarden.session import cut_lineage


def _zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def customer_entities(emap: DataFrame) -> DataFrame:
    return emap.filter(F.col("party_type") == "customer").select(
        F.col("source_id").alias("customer_id"), "entity_id"
    )


# -- turnover ------------------------------------------------------------------


def monthly_turnover(txns: DataFrame, accounts: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Credit turnover per customer over the trailing window."""
    per_account = (
        txns.filter(clock.within(F.col("txn_ts"), as_of, days=days))
        .groupBy("account_id")
        .agg(F.sum(F.when(F.col("direction") == "credit", F.col("amount")).otherwise(0.0)).alias("t"))
    )
    return (
        per_account.join(accounts.select("account_id", "customer_id"), "account_id")
        .groupBy("customer_id")
        .agg(F.sum("t").alias("actual_monthly_turnover"))
    )


def _ratio(actual: Column, declared: Column) -> Column:
    return F.round(_zero(actual) / F.nullif(declared, F.lit(0.0)), 1)


def turnover_ratio(customers, txns, accounts, as_of) -> DataFrame:
    """Actual against declared monthly turnover, all customers kept."""
    actual = F.col("actual_monthly_turnover")
    declared = F.col("declared_monthly_turnover")
    return customers.select("customer_id", "declared_monthly_turnover").join(
        monthly_turnover(txns, accounts, as_of), "customer_id", "left"
    ).select(
        "customer_id",
        _zero(declared).alias("declared_monthly_turnover"),
        _zero(actual).alias("actual_monthly_turnover"),
        _ratio(actual, declared).alias("turnover_ratio"),
    )


# -- customer 360 --------------------------------------------------------------


def alert_counts(alerts: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """Alerts per entity, optionally only the trailing days."""
    if days is not None:
        alerts = alerts.filter(clock.within(F.col("triggered_at"), as_of, days=days))
    severe = F.col("severity").isin("critical", "high")
    return (
        alerts.filter(F.col("primary_entity_id").isNotNull())
        .groupBy(F.col("primary_entity_id").alias("entity_id"))
        .agg(F.count("*").alias("alert_count"), F.count_if(severe).alias("severe_alerts"))
    )


def customer_360(
    customers, accounts, ratings, txns, alerts, emap, as_of, alerts_as_of=None
) -> DataFrame:
    """Profile, account rollup, latest rating, recent alerts and turnover per customer."""
    rollup = accounts.groupBy("customer_id").agg(
        F.count("*").alias("num_accounts"), F.sum("balance").alias("total_balance")
    )
    latest = dedupe_latest(
        ratings.filter(F.col("entity_type") == "customer").select(
            F.col("entity_id").alias("customer_id"), "risk_rating", "rated_at", "rating_id"
        ),
        ["customer_id"], ["rated_at", "rating_id"],
    ).select("customer_id", "risk_rating")
    recent = alert_counts(alerts, alerts_as_of or as_of, 30)
    joined = (
        customers.join(customer_entities(emap), "customer_id", "left")
        .join(rollup, "customer_id", "left")
        .join(latest, "customer_id", "left")
        .join(monthly_turnover(txns, accounts, as_of), "customer_id", "left")
        .join(recent, "entity_id", "left")
    )
    declared = F.col("declared_monthly_turnover")
    return joined.select(
        "customer_id", "full_name", "segment", "city", "country", "onboarded_at",
        "declared_occupation", "pep_flag", "entity_id",
        _zero("num_accounts").alias("num_accounts"),
        _zero("total_balance").alias("total_balance"),
        _zero(declared).alias("declared_monthly_turnover"),
        _zero("actual_monthly_turnover").alias("actual_monthly_turnover"),
        _ratio(F.col("actual_monthly_turnover"), declared).alias("turnover_ratio"),
        F.col("risk_rating").alias("current_risk_rating"),
        _zero("alert_count").alias("recent_alerts"),
    )


def customers_list(c360: DataFrame, min_alerts: int = 0, limit: int = 100) -> DataFrame:
    """Customers with the most recent alerts, then the largest balance."""
    return (
        c360.filter(F.col("recent_alerts") >= min_alerts)
        .orderBy(F.desc("recent_alerts"), F.desc("total_balance"), "customer_id")
        .limit(limit)
        .select(
            "customer_id", "full_name", "segment", "city", "country", "entity_id",
            "num_accounts", "total_balance", "current_risk_rating", "recent_alerts",
        )
    )


#: Rows that one cell of ``meet_owners`` returns, about.
CELL_ROWS = 4_000_000
#: Customers in one array of an entity, about.
BLOCK_OWNERS = 4_096


def meet_owners(owners: DataFrame, found: DataFrame, salt: str) -> DataFrame:
    """Inner join on ``entity_id`` where both sides repeat a key, in tasks of about equal output.

    A key of n owners and m rows returns n * m rows, which shuffle sizes do not show. Such a
    key is cut into cells of about ``CELL_ROWS`` rows: its rows are dealt to the cells by a hash
    of ``salt``, its owners, packed into arrays, go to every cell. Columns of ``found`` are
    computed ahead of the shuffle, once a row, not once for each owner.
    """
    spark = found.sparkSession
    found = found.filter(F.col("entity_id").isNotNull())
    n, m = F.col("_n"), F.col("_m")
    sizes = cut_lineage(
        owners.groupBy("entity_id").agg(F.count("*").alias("_n"))
        .join(found.groupBy("entity_id").agg(F.count("*").alias("_m")), "entity_id")
        .select("entity_id", "_n", (n * m).alias("_out"))
    )
    # the keys of several cells are few: no more than cells
    large = F.broadcast(sizes.filter(F.col("_out") > CELL_ROWS).select(
        "entity_id", F.ceil(F.col("_out") / CELL_ROWS).alias("_cells"), F.ceil(n / BLOCK_OWNERS).alias("_blocks")
    ))
    total = sizes.agg(F.sum("_out")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CELL_ROWS))

    def one(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(1))

    packed = (
        owners.join(large, "entity_id", "left")
        .withColumn("_block", F.pmod(F.xxhash64("customer_id"), one("_blocks")))
        .groupBy("entity_id", "_block", one("_cells").alias("_cells"))
        .agg(F.collect_list(F.struct("customer_id")).alias("_owners"))
        .select("entity_id", "_owners", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1)).alias("_cell"))
    )
    dealt = found.join(large.select("entity_id", "_cells"), "entity_id", "left").withColumn(
        "_cell", F.pmod(F.xxhash64(salt), one("_cells"))
    ).drop("_cells")
    # a number of parts that is given stays: the sizes of the sides say nothing about the output
    key = ["entity_id", "_cell"]
    met = dealt.repartition(parts, *key).join(packed.repartition(parts, *key).hint("shuffle_hash"), key)
    shown = [c for c in found.columns if c != "entity_id"]
    return met.select(F.explode("_owners").alias("_owner"), *shown).select("_owner.customer_id", *shown)


class _Frames(Mapping):
    """Named frames, each built when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def customer_pack(profiles: DataFrame, alerts: DataFrame, media: DataFrame) -> Mapping[str, DataFrame]:
    """Drill-down of any set of customers as three related frames.

    Alerts and articles stay one row each, keyed by customer, so a customer with
    very many alerts is not collected into a single row.
    """
    owners = profiles.filter(F.col("entity_id").isNotNull()).select("customer_id", "entity_id")
    found = alerts.select(
        F.col("primary_entity_id").alias("entity_id"), "alert_id", "alert_type", "severity",
        "triggered_at", "score", "explanation",
    )
    articles = media.select("entity_id", "article_id", "headline", "source", "published_at")
    return _Frames({
        "profile": lambda: profiles,
        "alerts": lambda: meet_owners(owners, found, "alert_id"),
        "adverse_media": lambda: meet_owners(owners, articles, "article_id").drop("article_id"),
    })


# -- perpetual KYC -------------------------------------------------------------


def media_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("entity_id").agg(F.count("*").alias("media_hits"))


def pkyc_customer_risk(
    customers, accounts, txns, alerts, hits, media, emap, as_of
) -> DataFrame:
    """Dynamic 0-100 customer risk, its band, the review flag and its drivers."""
    accts = accounts.groupBy("customer_id").agg(
        F.sum("balance").alias("total_balance"),
        F.max(F.when(F.col("status") == "dormant", 1).otherwise(0)).alias("has_dormant"),
    )
    sanctions = (
        hits.filter(F.col("party_type") == "customer")
        .groupBy(F.col("source_id").alias("customer_id"))
        .agg(F.count("*").alias("sanction_hits"))
    )
    joined = (
        customers.join(customer_entities(emap), "customer_id", "left")
        .join(monthly_turnover(txns, accounts, as_of), "customer_id", "left")
        .join(sanctions, "customer_id", "left")
        .join(accts, "customer_id", "left")
        .join(alert_counts(alerts), "entity_id", "left")
        .join(media_counts(media), "entity_id", "left")
    )
    declared = F.col("declared_monthly_turnover")
    base = joined.select(
        "customer_id", "full_name", "segment", "city", "country", "entity_id",
        "declared_occupation", "pep_flag", "kyc_tier",
        declared.alias("_declared"),
        _zero(declared).alias("declared_monthly_turnover"),
        _zero("actual_monthly_turnover").alias("actual_monthly_turnover"),
        _ratio(F.col("actual_monthly_turnover"), declared).alias("turnover_ratio"),
        *[
            _zero(c).alias(c)
            for c in (
                "alert_count", "severe_alerts", "sanction_hits", "media_hits",
                "total_balance", "has_dormant",
            )
        ],
    )
    scored = base.withColumn("dynamic_risk", _risk_points()).drop("_declared")
    risk = F.col("dynamic_risk")
    band = (
        F.when(risk >= 70, "critical").when(risk >= 45, "high").when(risk >= 20, "medium")
        .otherwise("low")
    )
    return scored.withColumns(
        {"risk_band": band, "edd_review_required": risk >= 45, "risk_drivers": _risk_drivers()}
    )


def _risk_points() -> Column:
    """Fixed weights of the score components."""
    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    declared, actual = F.col("_declared"), F.col("actual_monthly_turnover")
    breach = F.when((declared > 0) & (actual >= 3 * declared), 20).when(
        (declared > 0) & (actual >= 1.5 * declared), 8
    ).otherwise(0)
    total = (
        F.col("severe_alerts") * 12
        + (F.col("alert_count") - F.col("severe_alerts")) * 5
        + points(F.col("sanction_hits") > 0, 40)
        + F.col("media_hits") * 8
        + points(F.col("country").isin(HIGH_RISK_COUNTRIES), 8)
        + points(F.col("has_dormant") == 1, 6)
        + points(F.col("total_balance") > 5_000_000, 6)
        + breach
        + points(F.col("pep_flag"), 10)
    )
    return F.least(F.lit(100).cast("long"), total.cast("long"))


# The driver phrases below.
def _risk_drivers() -> Column:
    counted = [("severe_alerts", " severe alerts"), ("media_hits", " adverse-media hits")]
    severe, media = (
        F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(label)))
        for c, label in counted
    )
    ratio = F.col("turnover_ratio")
    over = F.when(
        (F.col("declared_monthly_turnover") > 0) & (ratio >= 1.5),
        F.format_string("turnover %.1fx declared", ratio),
    )
    return F.concat_ws(
        "; ",
        severe,
        F.when(F.col("sanction_hits") > 0, "sanctions/watchlist hit"),
        media,
        over,
        F.when(F.col("pep_flag"), "PEP"),
        F.when(F.col("has_dormant") == 1, "dormant account"),
        F.when(F.col("total_balance") > 5_000_000, "high balance exposure"),
    )


def pkyc_summary(pkyc: DataFrame) -> DataFrame:
    return pkyc.groupBy("risk_band").agg(
        F.count("*").alias("customers"), F.count_if("edd_review_required").alias("edd_required")
    )


def pkyc_list(pkyc: DataFrame, min_risk: int = 0, limit: int = 100) -> DataFrame:
    return (
        pkyc.filter(F.col("dynamic_risk") >= min_risk)
        .orderBy(F.desc("dynamic_risk"), "customer_id")
        .limit(limit)
        .select(
            "customer_id", "full_name", "segment", "country", "entity_id", "dynamic_risk",
            "risk_band", "edd_review_required", "risk_drivers", "alert_count", "severe_alerts",
            "sanction_hits", "media_hits",
        )
    )


# -- peer groups ---------------------------------------------------------------


def customer_behaviour(accounts: DataFrame, txns: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Per customer: count, value, mean value and distinct counterparties; zero rows kept.

    The ledger collapses to (account, counterparty) first, so the distinct count
    works on combined rows and no account has to fit a task.
    """
    pairs = (
        txns.filter(clock.within(F.col("txn_ts"), as_of, days=days))
        .groupBy("account_id", "counterparty_id")
        .agg(
            F.count("transaction_id").alias("n"), F.sum("amount").alias("v"),
            F.count("amount").alias("nv"),
        )
    )
    per_customer = (
        pairs.join(accounts.select("account_id", "customer_id"), "account_id")
        .groupBy("customer_id")
        .agg(
            F.sum("n").alias("txn_count"), F.sum("v").alias("total_value"),
            F.sum("nv").alias("_valued"),
            F.countDistinct("counterparty_id").alias("distinct_cps"),
        )
    )
    return (
        accounts.select("customer_id").distinct().join(per_customer, "customer_id", "left")
    ).select(
        "customer_id",
        _zero("txn_count").alias("txn_count"),
        F.coalesce("total_value", F.lit(0.0)).alias("total_value"),
        F.coalesce(F.try_divide("total_value", "_valued"), F.lit(0.0)).alias("avg_value"),
        _zero("distinct_cps").alias("distinct_cps"),
    )


def peer_anomaly(customers, behaviour: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Customers far from their segment's mean in count, value or counterparties.

    Segment statistics are one row per segment; the join side is sized at run
    time, broadcast when small and skew-split otherwise.
    """
    measures = {"cnt": "txn_count", "val": "total_value", "cp": "distinct_cps"}
    feat = customers.select("customer_id", "full_name", "segment", "country").join(
        behaviour, "customer_id"
    )
    stats = [
        f(c).alias(f"{p}_{m}")
        for m, c in measures.items()
        for p, f in (("m", F.avg), ("s", F.stddev))
    ]
    scored = feat.join(feat.groupBy("segment").agg(*stats), "segment").withColumns(
        {
            f"z_{m}": (F.col(c) - F.col(f"m_{m}")) / F.nullif(F.col(f"s_{m}"), F.lit(0.0))
            for m, c in measures.items()
        }
    )
    strength = F.greatest(*[F.abs(f"z_{m}") for m in measures])
    labels = {"cnt": "txn volume %.1fσ from peers", "val": "total value %.1fσ from peers",
              "cp": "counterparty count %.1fσ from peers"}
    reasons = [
        F.when(F.abs(f"z_{m}") >= threshold, F.format_string(label, F.col(f"z_{m}")))
        for m, label in labels.items()
    ]
    return scored.filter(strength >= threshold).select(
        "customer_id", "full_name", "segment", "country",
        "txn_count", "total_value", "avg_value", "distinct_cps",
        F.round("m_cnt", 1).alias("peer_avg_txns"),
        F.round("m_val", 0).alias("peer_avg_value"),
        F.round("z_cnt", 2).alias("z_txn_count"),
        F.round("z_val", 2).alias("z_total_value"),
        F.round("z_cp", 2).alias("z_distinct_cps"),
        F.round(strength, 2).alias("anomaly_score"),
        F.when(strength >= 4, "critical").when(strength >= 3, "high").otherwise("medium").alias(
            "severity"
        ),
        F.concat_ws("; ", *reasons).alias("explanation"),
    )


def anomaly_list(anomalies: DataFrame, limit: int = 100) -> DataFrame:
    return anomalies.orderBy(F.desc("anomaly_score"), "customer_id").limit(limit)


# -- typology sweep ------------------------------------------------------------


def typology_exposure(
    txns, accounts, customers, alerts, emap,
    typology: str = "tpp_gaming_layering", category: str = "gaming",
    min_txns: int = 10, min_ratio: float = 0.8,
) -> DataFrame:
    """Accounts whose flow through a merchant category comes back almost whole."""
    debit, credit = (F.col("direction") == d for d in ("debit", "credit"))
    flow_out, flow_in = F.col("gaming_out"), F.col("gaming_in")
    ratio = flow_in / F.nullif(flow_out, F.lit(0.0))
    flows = (
        txns.filter(F.col("merchant_category") == category)
        .groupBy("account_id")
        .agg(
            F.sum(F.when(debit, F.col("amount")).otherwise(0.0)).alias("gaming_out"),
            F.sum(F.when(credit, F.col("amount")).otherwise(0.0)).alias("gaming_in"),
            F.count("*").alias("gaming_txns"),
        )
        .filter((F.col("gaming_txns") >= min_txns) & (ratio >= min_ratio))
    )
    alerted = (
        alerts.select(F.col("primary_entity_id").alias("entity_id"))
        .distinct()
        .join(customer_entities(emap), "entity_id")
        .select("customer_id", F.lit(True).alias("_alerted"))
    )
    never = F.col("_alerted").isNull()
    return (
        flows.join(accounts.select("account_id", "customer_id"), "account_id")
        .join(
            customers.select("customer_id", "full_name", "segment", "declared_monthly_turnover"),
            "customer_id",
        )
        .join(alerted, "customer_id", "left")
        .select(
            F.lit(typology).alias("typology"),
            "customer_id", "account_id", "full_name", "segment", "declared_monthly_turnover",
            F.round(flow_out, 2).alias("gaming_out"),
            F.round(flow_in, 2).alias("gaming_in"),
            "gaming_txns",
            F.round(ratio, 3).alias("roundtrip_ratio"),
            F.round(F.abs(flow_out - flow_in), 2).alias("net_flow"),
            never.alias("never_alerted"),
            F.concat(
                clock.whole(flow_out), F.lit(" out and "), clock.whole(flow_in),
                F.lit(f" back through {category} merchants in "),
                F.col("gaming_txns").cast("string"), F.lit(" transactions"),
                F.when(never, "; no monitoring rule fired.").otherwise("."),
            ).alias("explanation"),
        )
    )


def typology_list(exposure: DataFrame, only_unalerted: bool = False, limit: int = 100) -> DataFrame:
    if only_unalerted:
        exposure = exposure.filter("never_alerted")
    return exposure.orderBy(F.desc("gaming_out"), "account_id").limit(limit)


