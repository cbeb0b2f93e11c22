"""Substring dedup by sliding spans of sentences.

A sentence ends at [.!?] before white space, or at a line break; its key is its words,
A-Z lower-cased, joined by one space. From every sentence, and back from every sentence, a
span runs over the fewest sentences that are two or more with at least 20 words, or that have
at least 25 words. So a passage is found by the sentences that stand whole in both places, if
these are two with 20 words or have 25 words, and all of them are covered, up to the last; a
common short line is no span. Spans are hashed to 128 bits; all places of a hash but the first, by
(id, sentence), lose their sentences.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import arrow_pass, ids_and_bytes, joined_columns, pinned

#: Sentences and words of a span, and the words at which fewer sentences are enough.
SENTENCES, WORDS, ALONE = 2, 20, 25
_BREAK = re.compile(rb"(?:(?<=[.!?])[ \t\r\x0b\x0c]|\n)[ \t\r\n\x0b\x0c]*")


def sentences(body: bytes) -> list[tuple[int, int, bytes, int]]:
    """(start, end, key, words) of each sentence with a word; ends reach the next sentence."""
    out, at = [], 0
    ends = [m.end() for m in _BREAK.finditer(body)]
    for end in [*ends, len(body)]:
        words = body[at:end].lower().split()
        if words:
            out.append((at, end, b" ".join(words), len(words)))
        at = end
    return out


def _shortest(counts: list[int]) -> list[tuple[int, int]]:
    """(first, number) of the fewest sentences from each one on that make a span."""
    whole = lambda n, total: total >= ALONE or (n >= SENTENCES and total >= WORDS)
    out, last, total = [], 0, 0
    for first in range(len(counts)):
        if last < first:
            last, total = first, 0
        while last < len(counts) and not whole(last - first, total):
            total += counts[last]
            last += 1
        if whole(last - first, total):
            # sentences that only an earlier start needed are given back
            back, rest = last, total
            while back - first > 1 and whole(back - 1 - first, rest - counts[back - 1]):
                back -= 1
                rest -= counts[back]
            out.append((first, back - first))
        total -= counts[first]
    return out


def spans(body: bytes) -> list[tuple[int, int, int]]:
    """(first sentence, sentences, 128-bit hash) of each span of a text, each once."""
    found = sentences(body)
    digests = [xxhash.xxh3_128_digest(key) for _, _, key, _ in found]
    counts = [n for *_, n in found]
    ending = [(len(counts) - k - n, n) for k, n in _shortest(counts[::-1])]
    places = sorted({*_shortest(counts), *ending})
    return [(first, n, xxhash.xxh3_128_intdigest(b"".join(digests[first:first + n]))) for first, n in places]


_SPANS = "id bigint, whole bigint, first int, n int, h1 bigint, h2 bigint"


def _span_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [
        (i, whole, first, n, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63))
        for i, body, whole in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())
        for first, n, h in spans(body.as_py())
    ]
    cols = list(zip(*rows)) or [()] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "whole", "first", "n", "h1", "h2"])


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, whole, later, first, n): places of spans that more than one place has.

    ``later`` is false at the first place; ``whole`` is a hash of the text, to tell rows that
    repeat an id apart. Rows with a null id have no places.
    """
    rows = arrow_pass(ids_and_bytes(docs, id_col, text_col, _mark(text_col).alias("whole")).where("id is not null"), _span_rows, _SPANS)
    place = F.struct("id", "first")
    shared = (
        rows.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
        .where("lo != hi").select("h1", "h2", F.col("lo.id").alias("o_id"), F.col("lo.first").alias("o_first"))
    )
    # written first, so that the join has two plain shuffles and a hot span can be split
    met = rows.join(pinned(shared, "shared-spans"), ["h1", "h2"])
    return met.select("id", "whole", ((F.col("id") != F.col("o_id")) | (F.col("first") != F.col("o_first"))).alias("later"), "first", "n")


def _rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, totals, shared, removed = [], [], [], []
    for body, places in zip(batch.column(0), batch.column(1).to_pylist()):
        body = body.as_py()
        found = sentences(body)
        drop, seen = set(), set()
        for p in places or ():
            covered = range(p["first"], p["first"] + p["n"])
            seen.update(covered)
            if p["later"]:
                drop.update(covered)
        if drop:
            parts, at = [], 0
            for k, (start, end, _, _) in enumerate(found):
                if k in drop:
                    parts.append(body[at:start])
                    at = end
            body = b"".join([*parts, body[at:]])
        texts.append(body.decode("utf-8", "replace"))
        totals.append(len(found))
        shared.append(len(seen))
        removed.append(len(drop))
    return pa.RecordBatch.from_arrays([
        *batch.columns[2:], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(shared, pa.int64()), pa.array(removed, pa.int64()),
    ], names=[*batch.schema.names[2:], "t", "a", "b", "c"])


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text rewritten, and the columns n_sentences, n_shared and n_removed.

    n_shared counts sentences in spans that stand in several places, first places too;
    n_removed those of later places, which leave the text with the white space after them. Null
    and empty texts come back empty. Rows with a null id neither keep others from a span
    nor lose any; rows that repeat an id are one document. Repeats inside a document are removed
    like any. Other columns pass through; new ones get leading underscores if their names are taken.
    """
    names = list(docs.columns)
    key, whole, mark, places = (joined_columns(names, f"span_{c}") for c in ("id", "whole", "mark", "places"))
    drops = repeated_spans(docs, id_col, text_col).groupBy("id", "whole").agg(F.collect_set(F.struct("later", "first", "n")).alias(places))
    drops = pinned(drops.withColumnsRenamed({"id": key, "whole": whole}), "span-places")
    marked = docs.withColumn(mark, _mark(text_col))
    joined = marked.join(drops, (marked[id_col].cast("bigint") == drops[key]) & (marked[mark] == drops[whole]), "left")
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias(joined_columns(names, "span_body"))
    others = [c for c in names if c != text_col]
    counts = [joined_columns(names, c) for c in ("n_sentences", "n_shared", "n_removed")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in others], f"`{text_col}` string", *[f"`{c}` bigint" for c in counts]])
    out = arrow_pass(joined.select(body, places, *others), _named(_rewrite, [*others, text_col, *counts]), schema)
    return out.select(*names, *counts)


def _named(fn, names: list[str]):
    return lambda batch: fn(batch).rename_columns(names)
