"""Shared helpers: word and shingle hashes, Arrow passes over texts, scratch tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.session import scratch_path

#: Bytes of a text that are held as Python words at once.
PIECE_BYTES = 1 << 21
#: Words of a shingle.
SHINGLE = 5

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(29)


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_lakewarden_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="lakewarden-")) / "lakewarden_src.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._lakewarden_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the code; small Arrow batches, so that very long texts never meet by the thousand in one."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write below the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ids_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: Column) -> DataFrame:
    """(id, body, ...): body is the UTF-8 of the text, empty for null."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), body.alias("body"), *extra)


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; None yields nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def pieces(body: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Cut a text into parts of about ``limit`` bytes that begin and end at white space."""
    at, size = 0, len(body)
    while size - at > limit:
        end = at + limit
        while end < size and body[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield body[at:end]
        at = end
    yield body[at:]


def word_hashes(body: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in order.

    ``bytes.lower`` and ``bytes.split`` know exactly ASCII letters and white space.
    """
    parts = []
    for part in pieces(body):
        words = part.lower().split()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width, count = min(size, n), max(n - size + 1, 1)
    acc = words[:count].copy()
    for k in range(1, width):
        acc = mix(acc * _M1 + words[k:k + count])
    return acc


def anchored(column: Column) -> Column:
    """The same values, from an expression that filters on the result are not pushed through.

    A filter that is rewritten with a long chain of array expressions repeats them at every level.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def flat_lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def joined_columns(left: list[str], right: str) -> str:
    """A column name that ``left`` does not use."""
    name = right
    while name.lower() in {c.lower() for c in left}:
        name = f"_{name}"
    return name
