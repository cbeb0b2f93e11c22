"""Five stages from raw documents to encoded training text.

Each stage takes the documents that the one before it kept and wrote. All but the last
return the columns of ``documents``, with n_chars counted anew where texts change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import documents, joined_columns, pinned, prepare
from lakewarden.llm.decontam import drop_contaminated
from lakewarden.llm.linededup import dedup_lines
from lakewarden.llm.neardup import keep_one_of_each
from lakewarden.llm.pieces import encode_and_decode, token_digests
from lakewarden.llm.queries import piece_model
from lakewarden.llm.rules import calibrate, quality_rules, with_statistics


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; cutoffs come from the labels of these documents."""
    rules, kept, failed = (joined_columns(docs.columns, c) for c in ("rules", "kept", "failed_rules"))
    stats = pinned(with_statistics(docs, into=rules), "stage-rules")
    cutoffs = calibrate(stats, documents(spark, sf_dir, "labels"), rules=rules)
    return quality_rules(stats, cutoffs, rules, kept, failed).where(kept).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that an earlier document has are gone from their texts."""
    prepare(spark)
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, linked at 0.8 or more."""
    prepare(spark)
    return keep_one_of_each(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token ids, their number, and digests of the ids and of the decoded text."""
    prepare(spark)
    ids, decoded = (joined_columns(docs.columns, c) for c in ("ids", "decoded"))
    return token_digests(encode_and_decode(docs, piece_model(), ids=ids, decoded=decoded), ids, decoded).drop(decoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentence_pieces", encode),
]

#: The stages hash, merge and encode in ways that SQL cannot state; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it wrote."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
