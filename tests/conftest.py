import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakewarden.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "lakewarden-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ledger(spark):
    """Build a small ledger from (account, direction, amount, time, extra) tuples."""

    def make(rows):
        full = []
        for i, (acct, direction, amount, ts, *extra) in enumerate(rows):
            e = extra[0] if extra else {}
            full.append((
                f"T{i:04d}", acct, e.get("from"), e.get("to"), direction, float(amount),
                e.get("cp"), e.get("channel"), e.get("category"), ts,
            ))
        return spark.createDataFrame(
            full,
            "transaction_id string, account_id string, from_acct string, to_acct string,"
            " direction string, amount double, counterparty_id string, channel string,"
            " merchant_category string, t string",
        ).selectExpr("* except (t)", "cast(t as timestamp) as txn_ts")

    return make


@pytest.fixture(scope="session")
def emap(spark):
    return spark.createDataFrame(
        [("C1", "customer", "ENT1", 1), ("C2", "customer", "ENT2", 1), ("F1", "third_party", "ENT3", 1)],
        "source_id string, party_type string, entity_id string, cluster_size bigint",
    )


@pytest.fixture(scope="session")
def accounts(spark):
    return spark.createDataFrame(
        [("A1", "C1", "2020-01-01"), ("A2", "C2", "2023-07-05"), ("A3", "C1", "2023-07-06"), ("A4", "C9", "2023-12-01")],
        "account_id string, customer_id string, t string",
    ).selectExpr("account_id", "customer_id", "cast(t as timestamp) as last_activity_before_ts")
