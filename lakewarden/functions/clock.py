"""The explicit clock: every operator takes ``as_of`` instead of reading the wall clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: str | datetime) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)


def _literal(t: datetime) -> Column:
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def at(as_of: str | datetime) -> Column:
    """The clock as a constant timestamp."""
    return _literal(moment(as_of))


def day(as_of: str | datetime) -> Column:
    return F.lit(moment(as_of).date())


def within(
    ts: Column, as_of: str | datetime, from_midnight: bool = False, **window: float
) -> Column:
    """Trailing window ``[as_of - window, as_of]`` as a constant range, so it pushes down."""
    end = moment(as_of)
    start = end - timedelta(**window)
    if from_midnight:
        start = datetime.combine(start.date(), datetime.min.time())
    return (ts >= _literal(start)) & (ts <= _literal(end))


def whole(c: Column) -> Column:
    """Amount rounded to a whole number, for text."""
    return F.round(c).cast("bigint").cast("string")
