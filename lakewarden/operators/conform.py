"""Conforming raw feeds: newest-wins de-duplication and feed unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.ranking import top_k


def dedupe_latest(
    df: DataFrame, keys: Sequence[str], newest: Sequence[str | Column]
) -> DataFrame:
    """One row per key: the greatest by ``newest``, compared left to right, NULLs last.

    The rank filter becomes a group limit ahead of the shuffle, so a key repeated
    in a third of all rows reaches its reducer as one row per map task.
    """
    return top_k(df, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in newest], 1)


def conform_feed(
    batch: DataFrame, stream: DataFrame | None, key: str, newest: Sequence[str | Column]
) -> DataFrame:
    """Historical feed plus streamed feed, newest ingest wins.

    Column lists follow the batch table: a column only the stream knows is left
    out, one only the batch knows is NULL for streamed rows.
    """
    feed = batch
    if stream is not None:
        extra = [c for c in stream.columns if c not in batch.columns]
        feed = batch.unionByName(stream.drop(*extra), allowMissingColumns=True)
    return dedupe_latest(feed.filter(F.col(key).isNotNull()), [key], newest)


def conform_transactions(batch: DataFrame, stream: DataFrame | None = None) -> DataFrame:
    """Ledger: rows without a transaction id are dropped, then newest ingest wins."""
    tie = ["_ingested_at", "txn_ts", "account_id", "counterparty_id", "amount"]
    return conform_feed(batch, stream, "transaction_id", [c for c in tie if c in batch.columns])


def conform_cards(batch: DataFrame, stream: DataFrame | None = None) -> DataFrame:
    """Card taps: rows without a tap id are dropped, then newest ingest wins."""
    tie = ["_ingested_at", "txn_ts", "card_id", "amount"]
    return conform_feed(batch, stream, "card_txn_id", [c for c in tie if c in batch.columns])


def conform_passthrough(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Declared columns only, in declared order."""
    return df.select(*columns)
