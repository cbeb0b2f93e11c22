"""Ordered per-key operators that survive a key holding a third of all rows.

``lag`` over ``partitionBy(key)`` sorts a whole key in one task. Here a hot key
is cut into slices of equal row counts (positions from range partitioning, so
equal timestamps are cut too); each slice is an own window partition, and only
the last value of a slice is carried into the next one. Keys that are not hot
stay whole, so the usual case costs one shuffle, as the plain window does, plus
a map-side combined count on the key column. ``slice_hot_keys`` (time slices)
remains for the case lifecycle, which cuts by time on purpose.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.config import SkewPolicy
from lakewarden.operators.ranking import row_index

_SLICE = "_slice"
_HOT = "_hot"


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"{k}_h"]) for k in keys]
    )


def slice_hot_keys(
    df: DataFrame, keys: Sequence[str], ts: Column, policy: SkewPolicy
) -> DataFrame:
    """Add ``_slice`` (0 for whole keys) and ``_hot``.

    The list of hot keys is broadcast: it holds at most ``policy.max_hot_keys``
    rows. A key left out by that bound is handled whole, so results never change.
    """
    second = F.unix_micros(ts.cast("timestamp"))
    rows, low, high = F.col("_rows"), F.col("_low"), F.col("_high")
    hot = (
        df.groupBy(*[F.col(k).alias(f"{k}_h") for k in keys])
        .agg(F.count("*").alias("_rows"), F.min(second).alias("_low"), F.max(second).alias("_high"))
        .filter((rows >= policy.hot_rows) & low.isNotNull())
        .orderBy(F.desc("_rows"))
        .limit(policy.max_hot_keys)
        .select(
            *[f"{k}_h" for k in keys],
            "_low",
            F.greatest(
                F.lit(1), F.ceil((high - low + 1) / F.ceil(rows / policy.slice_rows))
            ).alias("_width"),
        )
    )
    return (
        df.join(F.broadcast(hot), _null_safe(df, hot, keys), "left")
        .withColumn(_HOT, F.col("_width").isNotNull())
        .withColumn(
            _SLICE, F.coalesce(F.floor((second - F.col("_low")) / F.col("_width")), F.lit(0))
        )
        .drop("_low", "_width", *[f"{k}_h" for k in keys])
    )


def _sliced_carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], frame_end: int) -> DataFrame:
    """Add ``_near``: the carried ``_src`` of rows cut into slices of equal row counts.

    Rows are numbered in (keys, order) by range partitioning (``row_index``); a slice
    is ``slice_rows`` consecutive positions, so equal timestamps are cut like any
    others. Within a (key, slice) the window carries; into a slice, the last source
    of the key's earlier slices is carried by a second, small window over slice tails.
    """
    rows = df.withColumn(_SLICE, F.floor((F.col("_pos") - 1) / F.col("_slice_rows")))
    local = W.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(W.unboundedPreceding, frame_end)
    nearby = F.last("_src", ignorenulls=True).over(local)
    by_slice = W.partitionBy(*[f"{k}_h" for k in keys]).orderBy(f"{_SLICE}_h")
    before = (
        rows.groupBy(*[F.col(k).alias(f"{k}_h") for k in keys], F.col(_SLICE).alias(f"{_SLICE}_h"))
        .agg(F.max_by("_src", F.when(F.col("_src").isNotNull(), F.struct(*order))).alias("_tail"))
        .withColumn("_before", F.last("_tail", ignorenulls=True).over(by_slice.rowsBetween(W.unboundedPreceding, -1)))
        .drop("_tail")
    )
    marked = rows.withColumn("_near", nearby)
    return (
        marked.join(before, _null_safe(marked, before, [*keys, _SLICE]), "left")
        .withColumn("_near", F.coalesce(F.col("_near"), F.col("_before")))
        .drop("_before", _SLICE, "_pos", "_slice_rows", *[f"{k}_h" for k in [*keys, _SLICE]])
    )


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    where: Column | None = None,
    include_current: bool = False,
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Add ``out``: ``value`` of the latest earlier row of the same key.

    With ``where``, only rows satisfying it are a source (an as-of join against
    rows unioned into the same frame). ``order[0]`` must be the event time; the
    other columns break ties.

    Keys of fewer than ``policy.hot_rows`` rows take one window. Rows of hot keys
    are numbered by range partitioning and cut into slices of ``slice_rows``
    rows, whatever their timestamps. The hot list is broadcast to split the rows
    when it has at most ``max_hot_keys`` entries (it can never have more than
    rows / hot_rows); beyond that, every row takes the sliced path, with no
    broadcast and no key left whole.
    """
    source = F.lit(True) if where is None else where
    frame_end = 0 if include_current else -1
    marked = df.withColumn("_src", F.when(source, F.struct(value.alias("v"))))
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, frame_end)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_near", F.last("_src", ignorenulls=True).over(window))

    def sliced(rows: DataFrame) -> DataFrame:
        return _sliced_carry(_numbered(rows, keys, order, policy), keys, order, frame_end)

    done = _by_heat(marked, keys, policy, plain, sliced)
    return done.withColumn(out, F.col("_near")["v"]).drop("_near", "_src")


def _numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], policy: SkewPolicy) -> DataFrame:
    return row_index(rows, [*keys, *order], "_pos").withColumn("_slice_rows", F.lit(policy.slice_rows))


def _by_heat(
    df: DataFrame, keys: Sequence[str], policy: SkewPolicy,
    plain: Callable[[DataFrame], DataFrame], sliced: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Rows of cold keys through ``plain``, those of hot keys through ``sliced``."""
    hot = (
        df.groupBy(*[F.col(k).alias(f"{k}_h") for k in keys])
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") >= policy.hot_rows)
        .select(*[f"{k}_h" for k in keys])
    )
    n_hot = hot.count()
    if n_hot == 0:
        return plain(df)
    if n_hot > policy.max_hot_keys:
        return sliced(df)
    flagged = df.join(
        F.broadcast(hot.withColumn(_HOT, F.lit(True))), _null_safe(df, hot, keys), "left",
    ).withColumn(_HOT, F.coalesce(F.col(_HOT), F.lit(False))).drop(*[f"{k}_h" for k in keys])
    return plain(flagged.filter(~F.col(_HOT))).unionByName(sliced(flagged.filter(F.col(_HOT)))).drop(_HOT)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """``lag`` of several columns (``{output: input}``) under one ordering.

    Cold keys lag the columns themselves, so that a shuffled row holds no second copy of
    them; hot keys carry them as one value, as ``carry_last`` does.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    value = F.struct(*[F.col(src).alias(name) for name, src in columns.items()])

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select("*", *[F.lag(src).over(window).alias(name) for name, src in columns.items()])

    def sliced(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("_src", F.struct(value.alias("v")))
        near = _sliced_carry(_numbered(marked, keys, order, policy), keys, order, -1)
        return near.select(*rows.columns, *[F.col("_near")["v"][name].alias(name) for name in columns])

    return _by_heat(df, keys, policy, plain, sliced)


def join_unique(
    big: DataFrame, dim: DataFrame, key: str, weight: str, policy: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Inner join to a relation with one row per key and its row count ``weight``.

    Rows of hot keys never shuffle: the hot part of ``dim`` is broadcast (at most
    ``max_hot_keys`` rows); everything else takes the ordinary join.
    """
    hot = (
        dim.filter(F.col(weight) >= policy.hot_rows)
        .orderBy(F.desc(weight), key)
        .limit(policy.max_hot_keys)
    )
    hot_keys = hot.select(key)
    on_hot = big.join(F.broadcast(hot), key)
    rest = big.join(F.broadcast(hot_keys), key, "left_anti")
    return on_hot.unionByName(rest.join(dim, key))
