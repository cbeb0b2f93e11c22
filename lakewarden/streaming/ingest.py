"""Streaming JSON lanes: incremental discovery, lenient casts, quarantine.

Every line is parsed into a string map first. A line that is not JSON goes to
the quarantine; a value that does not fit its type, and any column the schema
does not know, is kept in ``_rescued`` instead of failing the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakewarden import schemas

_INGESTED = "_ingested_at"


def _lines(spark: SparkSession, landing: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(landing).filter(F.trim("value") != "").withColumn(
        "_map", F.from_json("value", "map<string,string>")
    )


def _lane(lines: DataFrame, schema: T.StructType, stamp: Column | None) -> DataFrame:
    fields = [f for f in schema if f.name != _INGESTED]
    raw = {f.name: F.col("_map")[f.name] for f in fields}
    typed = {f.name: raw[f.name].try_cast(f.dataType) for f in fields}
    known = F.array(*[F.lit(f.name) for f in fields])
    misfits = F.array(*[
        F.when(raw[f.name].isNotNull() & typed[f.name].isNull(), F.lit(f.name)) for f in fields
    ])
    # named once a row, not once for each key of its map: few rows have any
    odd = F.concat(F.array_except(F.map_keys("_map"), known), F.array_compact(misfits))
    good = lines.filter(F.col("_map").isNotNull()).select(
        *[c.alias(n) for n, c in typed.items()], "_map", odd.alias("_odd")
    )
    rescued = F.map_filter("_map", lambda k, _v: F.array_contains("_odd", k))
    return good.select(
        *typed,
        (F.current_timestamp() if stamp is None else stamp).alias(_INGESTED),
        F.when(F.size("_odd") > 0, F.to_json(rescued)).alias("_rescued"),
    )


def stream_ledger(
    spark: SparkSession, landing: str, max_files: int | None = None, stamp: Column | None = None
) -> DataFrame:
    """Ledger transactions from JSON lines."""
    return _lane(_lines(spark, landing, max_files), schemas.TRANSACTIONS, stamp)


def stream_cards(
    spark: SparkSession, landing: str, max_files: int | None = None, stamp: Column | None = None
) -> DataFrame:
    """Card taps from JSON lines."""
    return _lane(_lines(spark, landing, max_files), schemas.CARD_TRANSACTIONS, stamp)


def stream_quarantine(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Lines that are not JSON, with the file they came from."""
    lines = _lines(spark, landing, max_files)
    return lines.filter(F.col("_map").isNull()).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path")
    )


def append_lane(lane: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived, exactly once, and stop."""
    return (
        lane.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
