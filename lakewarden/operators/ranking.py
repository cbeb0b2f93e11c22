"""Ranks and running totals without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.session import cut_lineage

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id = partition << 33 | row


def _offsets(per_partition: list[tuple[int, int]]) -> Column:
    """Literal array: rows in all partitions before partition ``i``."""
    counts = dict(per_partition)
    width = max(counts, default=0) + 1
    before = [0, *accumulate(counts.get(i, 0) for i in range(width))][:width]
    return F.lit([int(b) for b in before])


def row_index(df: DataFrame, order: Sequence[str], out: str = "row_index") -> DataFrame:
    """1-based position of each row in the total order.

    Range partitioning sorts the rows across tasks; a position is the number of
    rows in earlier partitions plus the position inside its own. The sorted rows
    are checkpointed so that both parts come from one evaluation, and only one
    count per partition reaches the driver.
    """
    mid = F.monotonically_increasing_id()
    ranked = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", mid)
    )
    part = F.shiftright("_mid", 33)
    counts = ranked.groupBy(part.alias("p")).count().collect()
    start = _offsets([(r["p"], r["count"]) for r in counts])
    local = F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))
    position = F.element_at(start, part.cast("int") + 1) + local + 1
    return ranked.withColumn(out, position.cast("long")).drop("_mid")


def dense_rank(df: DataFrame, key: str, out: str = "dense_rank") -> DataFrame:
    """One row per distinct ``key`` with its dense rank in ascending order."""
    return row_index(df.select(key).distinct(), [key], out)


def running_totals(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Add ``<c>_before``: sum of ``c`` over all rows with a smaller ``key``.

    ``key`` must be unique, which the caller gets by grouping on it first.
    """
    pinned = cut_lineage(
        df.repartitionByRange(key)
        .sortWithinPartitions(key)
        .withColumn("_part", F.spark_partition_id())
    )
    sums = pinned.groupBy("_part").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    window = W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    totals = {}
    for c in columns:
        start = _offsets([(r["_part"], r[c] or 0) for r in sums])
        inside = F.coalesce(F.sum(c).over(window), F.lit(0))
        totals[f"{c}_before"] = F.element_at(start, F.col("_part") + 1) + inside
    return pinned.withColumns(totals).drop("_part")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key.

    Catalyst turns the rank filter into a per-task group limit ahead of the
    shuffle, so a hot key sends at most ``k`` rows per map task.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")
