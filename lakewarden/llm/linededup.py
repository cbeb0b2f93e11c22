"""Line dedup over batches, against levelled sorted runs of line hashes.

The store holds runs: bucketed, sorted tables of (k1, k2, owner), one row for each line
key, in levels. A batch aggregates its own keys, is shuffled once into the buckets of the
runs and merge-joins each run where it lies; keys that no run holds become a new run of
level 0. When a level has ``fanout`` runs they are merged into one run of the next level,
so a batch meets a number of runs that grows with the logarithm of the batches.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import arrow_pass, ids_and_bytes, joined_columns, pinned
from lakewarden.session import scratch_path

#: Code points of the shortest key that counts as a line.
MIN_CHARS = 10
_SPACE = b" \t\n\r\x0b\x0c"
_LINES = "id bigint, whole bigint, pos int, k1 bigint, k2 bigint, batch int"


def _line_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, wholes, places, k1, k2, rounds = [], [], [], [], [], []
    for i, body, whole, turn in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        for pos, line in enumerate(body.as_py().split(b"\n")):
            key = line.strip(_SPACE).lower()
            if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS):
                continue
            digest = xxhash.xxh3_128_intdigest(key)
            ids.append(i)
            wholes.append(whole)
            places.append(pos)
            k1.append((digest >> 64) - (1 << 63))
            k2.append((digest & (1 << 64) - 1) - (1 << 63))
            rounds.append(turn)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(wholes, pa.int64()), pa.array(places, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(rounds, pa.int32())],
        names=["id", "whole", "pos", "k1", "k2", "batch"],
    )


def _mark(text_col: str) -> Column:
    """Hash of a text: tells rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch=None) -> DataFrame:
    """One row for each line whose key counts; ``whole`` is a hash of the text it is in."""
    turn = (F.lit(0) if batch is None else batch).cast("int").alias("batch")
    return arrow_pass(ids_and_bytes(docs, id_col, text_col, _mark(text_col).alias("whole"), turn).where("id is not null"), _line_keys, _LINES)


class LineRuns:
    """Levelled runs of line keys with the document that owns each.

    Batches come in any number; a line belongs to the first batch that has it and there to
    the smallest id. Runs are tables of the session's warehouse; ``buckets`` is their number
    of parts, to be chosen for the corpus as a whole. ``levels`` lists the run tables.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self._made = 0

    def _write(self, keys: DataFrame) -> str:
        table = f"{self.name}_{self._made}"
        self._made += 1
        (
            keys.repartition(self.buckets, "k1", "k2").write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2")
            .format("parquet").saveAsTable(table)
        )
        return table

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch of :func:`lines_of`; returns (id, whole, pos) of the lines to drop."""
        own = lines.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        met = own
        for k, table in enumerate(self.runs()):
            run = self.spark.table(table).where("fresh").select("k1", "k2", F.col("owner").alias(f"owner{k}"))
            met = met.join(run.hint("merge"), ["k1", "k2"], "left")
        held = F.coalesce(*[F.col(f"owner{k}") for k in range(len(self.runs()))], F.lit(None).cast("bigint"))
        judged = met.select(
            "k1", "k2", F.coalesce(held, "first").alias("owner"), held.isNull().alias("fresh"),
            (held.isNotNull() | (F.col("first") != F.col("last"))).alias("shared"),
        )
        table = self._write(judged)
        shared = self.spark.table(table).where("shared").select("k1", "k2", "owner")
        drops = pinned(
            lines.join(shared, ["k1", "k2"]).where("id != owner").select("id", "whole", "pos"), "line-drops",
        )
        self._push(0, table)
        return drops

    def _push(self, level: int, table: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = None
            for name in old:
                rows = self.spark.table(name).where("fresh")
                merged = rows if merged is None else merged.union(rows)
            self._push(level + 1, self._write(merged.select("k1", "k2", "owner", "fresh", F.lit(False).alias("shared"))))
            for name in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 3) -> DataFrame:
    """(id, whole, dropped): positions of the lines to drop, for each document that has any.

    Documents go through :class:`LineRuns` in ``batches`` of ascending id, so that the owner
    of a line is the smallest id in the whole table.
    """
    spark = docs.sparkSession
    number = F.col(id_col).cast("bigint")
    cuts = docs.where(number.isNotNull()).select(number.alias("n")).approxQuantile("n", [k / batches for k in range(1, batches)], 0.01)
    turn = sum((F.when(number > F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    path = scratch_path(spark, "llm-lines")
    lines_of(docs, id_col, text_col, turn).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(_LINES).parquet(path)
    runs = LineRuns(spark, fanout=fanout)
    drops = None
    for k in range(batches):
        part = runs.add(lines.where(F.col("batch") == k).drop("batch"))
        drops = part if drops is None else drops.union(part)
    runs.drop()
    return drops.groupBy("id", "whole").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with its text rewritten, and the columns n_lines and n_dropped.

    A text is split at \\n; null and empty are one empty line. A key is the line stripped of
    ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys of ten code points or more that two
    documents have keep their lines only in the smallest id; repeats inside one document
    stay. A null text comes back empty. Rows with a null id own nothing and lose nothing;
    rows that repeat an id are one document. Other columns pass through; if ``docs`` has
    columns named n_lines or n_dropped, the new ones get leading underscores.
    """
    names = list(docs.columns)
    drops = line_drops(docs, id_col, text_col, batches, fanout).select(
        F.col("id").alias(joined_columns(names, "line_id")), F.col("whole").alias(joined_columns(names, "line_whole")),
        F.col("dropped").alias(joined_columns(names, "line_dropped")),
    )
    return _apply(docs, drops, id_col, text_col)


def _apply(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    names = list(docs.columns)
    id_key, whole_key, list_key = drops.columns
    mark, parts, count, lost = (joined_columns(names, c) for c in ("line_mark", "line_parts", "n_lines", "n_dropped"))
    marked = docs.withColumn(mark, _mark(text_col))
    joined = marked.join(drops, (marked[id_col].cast("bigint") == drops[id_key]) & (marked[mark] == drops[whole_key]), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = joined.withColumn(parts, F.when(F.col(list_key).isNotNull(), F.split(text, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(list_key))
    rewritten = F.when(F.col(list_key).isNull(), text).otherwise(
        F.array_join(F.transform(kept, lambda k: F.get(F.col(parts), k)), "\n"),
    )
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return whole.select(
        *[rewritten.alias(c) if c == text_col else F.col(c) for c in names],
        n_lines.cast("bigint").alias(count), F.coalesce(F.size(list_key), F.lit(0)).cast("bigint").alias(lost),
    )

