"""Raw -> conformed -> alerts -> marts over one data directory.

Tables used by several consumers (conformed ledger, resolved entities, alerts,
profile and screening marts) are written once to the shared folder and read
back; everything else stays a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.config import AlertConfig, RingConfig
from lakewarden.operators.conform import conform_transactions
from lakewarden.operators.entities import entity_map, resolve_entities
from lakewarden.operators.screening import screen_names
from lakewarden.plans import cases, detectors, learning, risk
from lakewarden.session import configure, release_shuffles, scratch_path
from lakewarden.sources.roles import AS_OF_EVENTS, AS_OF_LEDGER, Roles
from lakewarden.sources.tables import values_df, watchlist, write_overwrite
from lakewarden.schemas import WATCHLIST

# Thresholds that fit the amounts and dates of the bundled test tables.
LEDGER_CFG = AlertConfig(
    rapid_min_amount=20_000.0, freq_z=0.3, dormant_high_value=60_000.0,
    ctr_threshold=60_000.0, struct_min_ratio=0.5, struct_window_days=730,
)
EVENT_CFG = AlertConfig(ato_amount=50.0)
RING = RingConfig(window_days=14, min_amount=20_000.0)
RAPID_HOURS = 24 * 30
DORMANT_WINDOW = 60

# Names of the test tables put on the screening list beside the fixed rows.
TEST_WATCH_NAMES = ["small ring", "red widget", "blue bolt", "old gear"]


class Lake:
    """Lazily built tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.roles = Roles(spark, sf_dir)

    def _saved(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        df = build()
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        schema = df.schema
        del df
        release_shuffles(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    # conformed

    @cached_property
    def ledger(self) -> DataFrame:
        # each file in time order: a family that reads a window decodes only the pages of that window
        return self._saved(
            "ledger", lambda: conform_transactions(self.roles.transactions()).sortWithinPartitions("txn_ts")
        )

    @cached_property
    def entities(self) -> DataFrame:
        return self._saved(
            "entities",
            lambda: resolve_entities(self.roles.customers(), self.roles.third_parties()),
        )

    @property
    def emap(self) -> DataFrame:
        return entity_map(self.entities)

    # alerts

    def rapid_movement(self) -> DataFrame:
        return detectors.detect_rapid_movement(
            self.ledger, self.roles.accounts(), self.emap, LEDGER_CFG, AS_OF_LEDGER, RAPID_HOURS
        )

    def frequency_change(self) -> DataFrame:
        return detectors.detect_frequency_change(
            self.ledger, self.roles.accounts(), self.emap, LEDGER_CFG, AS_OF_LEDGER
        )

    def circular_flow(self, simple_only: bool = False) -> DataFrame:
        return detectors.detect_circular_flow(
            self.ledger, self.roles.accounts(), self.emap, RING, AS_OF_LEDGER, simple_only
        )

    def dormant(self) -> DataFrame:
        return detectors.detect_dormant(
            self.ledger, self.roles.accounts(), self.emap, LEDGER_CFG, AS_OF_LEDGER, DORMANT_WINDOW
        )

    def risk_rating_change(self) -> DataFrame:
        return detectors.detect_risk_rating_change(self.roles.risk_ratings(), self.emap, LEDGER_CFG)

    def adverse_media(self) -> DataFrame:
        return detectors.detect_adverse_media(self.roles.media_parties(self.emap), self.roles.media())

    def ubo_change(self) -> DataFrame:
        return detectors.detect_ubo_change(self.roles.ownership(), self.emap)

    def account_takeover(self) -> DataFrame:
        return detectors.detect_account_takeover(
            self.roles.auth_events(), self.roles.event_ledger(), self.roles.accounts(), self.emap,
            EVENT_CFG,
        )

    def impossible_travel(self) -> DataFrame:
        return detectors.detect_impossible_travel(
            self.roles.cards(), self.roles.accounts(), self.emap, EVENT_CFG
        )

    def structuring(self) -> DataFrame:
        return detectors.detect_structuring(
            self.ledger, self.roles.accounts(), self.emap, LEDGER_CFG, AS_OF_LEDGER
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return self._saved(
            "alerts",
            lambda: detectors.fraud_alerts(
                self.rapid_movement(), self.frequency_change(), self.circular_flow(),
                self.dormant(), self.risk_rating_change(), self.adverse_media(),
                self.ubo_change(), self.account_takeover(), self.impossible_travel(),
                self.structuring(),
            ),
        )

    # marts

    def watchlist(self) -> DataFrame:
        test = [
            (f"WT{i:04d}", name, "sanctions", "Test List", "", "test entry", "high")
            for i, name in enumerate(TEST_WATCH_NAMES, start=1)
        ]
        return watchlist(self.spark).unionByName(values_df(self.spark, test, WATCHLIST))

    @cached_property
    def hits(self) -> DataFrame:
        return self._saved("hits", lambda: screen_names(self.entities, self.watchlist()))

    def media_evidence(self) -> DataFrame:
        return detectors.media_matches(self.roles.media_parties(self.emap), self.roles.media())

    @cached_property
    def c360(self) -> DataFrame:
        return self._saved(
            "c360",
            lambda: risk.customer_360(
                self.roles.customers(), self.roles.accounts(), self.roles.risk_ratings(),
                self.ledger, self.alerts, self.emap, AS_OF_LEDGER,
            ),
        )

    @cached_property
    def pkyc(self) -> DataFrame:
        return self._saved(
            "pkyc",
            lambda: risk.pkyc_customer_risk(
                self.roles.customers(), self.roles.accounts(), self.ledger, self.alerts,
                self.hits, self.media_evidence(), self.emap, AS_OF_LEDGER,
            ),
        )

    def anomalies(self, threshold: float = 1.5) -> DataFrame:
        behaviour = risk.customer_behaviour(self.roles.accounts(), self.ledger, AS_OF_LEDGER)
        return risk.peer_anomaly(self.roles.customers(), behaviour, threshold)

    def typology(self) -> DataFrame:
        return risk.typology_exposure(
            self.ledger, self.roles.accounts(), self.roles.customers(), self.alerts, self.emap,
            min_ratio=0.3,
        )

    @cached_property
    def features(self) -> DataFrame:
        return self._saved(
            "features", lambda: learning.alert_features(self.roles.cases(), self.c360)
        )

    def labels(self) -> DataFrame:
        return learning.sar_labels(self.features, self.noise())

    @cached_property
    def trained_scores(self) -> DataFrame:
        """The score table: a model fitted on the training split overwrites it with every case."""
        train, _held_out = learning.split_labelled(self.features, self.labels())
        scores = learning.score_cases(learning.train_sar_model(train), self.features)
        path = scratch_path(self.spark, "case_scores")
        write_overwrite(scores, path)
        return self.spark.read.schema(scores.schema).parquet(path)

    def case_number(self):
        """All digits of a case id."""
        return F.substring("case_id", len("CASE-") + 1, 20).cast("bigint")

    def noise(self):
        """Arithmetic label noise, so that another engine can recompute it."""
        return self.case_number() * 7919 % 1000 / 1000.0

    def case_bucket(self):
        return self.case_number() % 10

    def scores(self) -> DataFrame:
        return learning.surrogate_scores(self.features)

    def evidence(self) -> DataFrame:
        r = self.roles
        return cases.case_evidence(
            r.cases(), self.scores(), r.accounts(), self.ledger, r.third_parties(), r.notes(),
            r.actions(), self.hits, self.pkyc,
        )


_LAKES: dict[tuple[str, str], Lake] = {}


def lake(spark: SparkSession, sf_dir: str) -> Lake:
    """One ``Lake`` per session and directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAKES:
        _LAKES[key] = Lake(spark, sf_dir)
    configure(spark)
    return _LAKES[key]


__all__ = ["AS_OF_EVENTS", "AS_OF_LEDGER", "Lake", "lake"]
