"""Text checks and field extraction over whole texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier shape, minimum narrative length and note wording.
ID_RUN = r"\b\d{10,13}\b"
MIN_NARRATIVE = 120
NOTE_SHORT = "narrative too short (<120 chars)"
NOTE_LEAK = "possible raw PII identifier(s) leaked: "
NOTE_OK = "no raw PII; length ok"

DOCUMENT_LABELS = (
    "client_name", "national_id", "tax_number", "source_of_funds", "pep_status",
    "beneficial_owner", "jurisdictions", "amount", "risk_assessment",
)


def stripped_length(c: Column) -> Column:
    """Length without surrounding white space of any kind."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def id_run_count(c: Column) -> Column:
    """Number of bare 10 to 13 digit runs."""
    return F.coalesce(F.regexp_count(c, F.lit(ID_RUN)), F.lit(0))


def guardrail(df: DataFrame, text_col: str) -> DataFrame:
    """Add ``text_chars``, ``leak_count``, ``guardrail_pass`` and ``guardrail_note``."""
    measured = df.withColumns(
        {"text_chars": stripped_length(F.col(text_col)), "leak_count": id_run_count(F.col(text_col))}
    )
    short, leaks = F.col("text_chars") < MIN_NARRATIVE, F.col("leak_count")
    note = (
        F.when(short, NOTE_SHORT)
        .when(leaks > 0, F.concat(F.lit(NOTE_LEAK), leaks.cast("string")))
        .otherwise(NOTE_OK)
    )
    return measured.withColumns(
        {"guardrail_pass": ~short & (leaks == 0), "guardrail_note": note}
    )


def extract_fields(
    df: DataFrame, text_col: str, labels: Sequence[str] = DOCUMENT_LABELS
) -> DataFrame:
    """Add ``fields``: label -> value for every ``label: value`` line found."""
    entries = []
    for label in labels:
        shape = label.replace("_", " ")
        pattern = "(?im)^[ \\t]*" + re.escape(shape).replace("\\ ", "[ _]") + "[ \\t]*:[ \\t]*(\\S[^\\r\\n]*)$"
        value = F.nullif(F.rtrim(F.regexp_extract(text_col, pattern, 1)), F.lit(""))
        entries.append(F.struct(F.lit(label).alias("key"), value.alias("value")))
    found = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return df.withColumn("fields", F.map_from_entries(found))
