"""Batch sources and sinks."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import schemas
from lakewarden.config import ANALYSTS, TEAMS, WATCHLIST


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Typed scan of a declared table: no schema inference, columns prune to the scan."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: path metadata and the whole content."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("doc_text")
    )


#: Characters that Spark writes as %XX in the name of a partition folder.
_ESCAPED = {chr(i) for i in range(1, 32)} | set("\x7f\"#%'*/:=?\\{[]^")


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder of the local (or a mounted) file system, else None."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop_path).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _land_files(root: str, key: str):
    """Task that writes sorted rows as files: one of each value of ``key``, moved to its name when whole."""

    def name(value: str | None) -> str:
        shown = "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in value or "")
        return f"{key}={shown or '__HIVE_DEFAULT_PARTITION__'}.txt"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        folder = f"{root}/task={context.partitionId():05d}"
        own = f"{folder}/.{context.taskAttemptId()}"
        rows = ((name(v), t) for b in batches for v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        n = 0
        for file, group in itertools.groupby(rows, key=lambda row: row[0]):
            os.makedirs(folder, exist_ok=True)
            with open(own, "wb") as out:
                for _file, text in group:
                    out.write((text or "").encode() + b"\n")
            os.replace(own, f"{folder}/{file}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    return write


def land_documents(docs: DataFrame, path: str, key: str, text: str) -> None:
    """Write each row's text as a text file of its own, named ``key=value`` below its task's folder.

    Without its native library Hadoop starts a process for the rights of each local file,
    and a folder a row has to be listed by itself; so on a local file system tasks write
    the files themselves. Elsewhere the text writer makes a folder ``key=value`` for each
    value, and tasks move their own files when they end; by default the driver would move
    every file, one after the other, after the last task.
    """
    rows = docs.select(F.col(key), F.col(text).alias("value"))
    root = _local_path(docs.sparkSession, path) if isinstance(docs, DataFrame) else None
    if root is None:
        (
            rows.write
            .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
            .partitionBy(key).text(path)
        )
        return
    os.makedirs(root)
    named = rows.select(F.col(key).cast("string").alias("key"), "value").sortWithinPartitions("key")
    # a task for each part of the scan, as the text writer has: rows of one value in one part share a file
    named.mapInArrow(_land_files(root, key), "n long").agg(F.sum("n")).collect()


def values_df(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """Small inline relation."""
    return spark.createDataFrame(list(rows), schema)


def number_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Distributed number generator, ``start`` included and ``end`` not."""
    return spark.range(start, end)


def watchlist(spark: SparkSession) -> DataFrame:
    return values_df(spark, WATCHLIST, schemas.WATCHLIST)


def teams(spark: SparkSession) -> DataFrame:
    return values_df(spark, TEAMS, "team_id string, team_name string")


def analysts(spark: SparkSession) -> DataFrame:
    return values_df(spark, ANALYSTS, "analyst_id string, analyst_name string")


def write_overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Full rebuild of a table; the schema may differ from the old one."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append-only event log (feedback, notes, actions, filings, audit)."""
    df.write.mode("append").parquet(path)


def replace_slice(target: DataFrame, predicate: Column, new: DataFrame) -> DataFrame:
    """Idempotent slice replacement: drop the slice, add its new rows.

    A row whose predicate is NULL is not part of the slice and stays, as with
    a SQL DELETE.
    """
    kept = target.filter(~F.coalesce(predicate, F.lit(False)))
    return kept.unionByName(new)


def keep_latest_n(
    df: DataFrame, predicate: Column, key: str, order: Sequence[Column], n: int
) -> DataFrame:
    """Keep the newest ``n`` rows matching the predicate and all rows outside it."""
    inside = F.coalesce(predicate, F.lit(False))
    newest = df.filter(inside).orderBy(*order).limit(n).select(key)
    prune = df.filter(inside).select(key).join(newest, key, "left_anti")
    return df.join(prune, key, "left_anti")
