"""Stateful impossible-travel detection over streamed card taps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakewarden.functions import geo

_OUT = (
    "card_id string, account_id string, card_txn_id string, txn_ts timestamp, lat double,"
    " lon double, city string, prev_txn_ts timestamp, prev_lat double, prev_lon double,"
    " prev_city string"
)
_STATE = "txn_ts timestamp, lat double, lon double, city string"
_HELD = ["txn_ts", "lat", "lon", "city"]


def _pair_up(ttl_ms: int):
    """State function: the latest tap of a card, paired with the next ones."""

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taps = pd.concat(list(batches), ignore_index=True).sort_values(["txn_ts", "card_txn_id"])
        known = dict(zip(_HELD, state.get, strict=True)) if state.exists else None
        if known is not None:
            taps = taps[taps["txn_ts"] >= pd.Timestamp(known["txn_ts"])]
        if not taps.empty:
            pairs = taps.assign(**{f"prev_{c}": taps[c].shift(1) for c in _HELD})
            if known is not None:
                for c in _HELD:
                    pairs.loc[pairs.index[0], f"prev_{c}"] = known[c]
            tail = taps.iloc[-1]
            state.update(tuple(
                tail[c].to_pydatetime() if c == "txn_ts" else tail[c] for c in _HELD
            ))
            pairs["prev_city"] = pairs["prev_city"].astype(object).where(pairs["prev_city"].notna(), None)
            yield pairs[[c.split()[0] for c in _OUT.split(", ")]]
        last_ms = int(pd.Timestamp(state.get[0]).timestamp() * 1000)
        state.setTimeoutTimestamp(max(last_ms + ttl_ms, state.getCurrentWatermarkMs() + 1))

    return step


def stream_tap_pairs(
    cards: DataFrame, ttl_days: int = 30, lateness: str = "1 hour"
) -> DataFrame:
    """Each streamed tap with its card's previous tap and the implied speed.

    State is one tap per card and expires ``ttl_days`` of event time after it. A tap
    older than the remembered one is late and yields no pair; on input in event
    order the result equals the batch operator. ``maxFilesPerTrigger`` on the
    lane bounds how many taps of one card meet in one call.
    """
    slim = cards.withWatermark("txn_ts", lateness).select(
        "card_id", "account_id", "card_txn_id", "txn_ts", "lat", "lon", "city"
    )
    paired = slim.groupBy("card_id").applyInPandasWithState(
        _pair_up(ttl_days * 86_400_000), _OUT, _STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    km = geo.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    return paired.withColumn(
        "implied_kmh", geo.speed_kmh(km, F.col("prev_txn_ts"), F.col("txn_ts"))
    )
