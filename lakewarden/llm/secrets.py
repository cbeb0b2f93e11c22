"""Secret scans: fixed patterns and sliding-window entropy, in DataFrame functions only.

Fixed kinds: assign, access, hex. The method adds entropy kinds: runs of 20 or more
characters of ``[A-Za-z0-9+/_-]`` are candidates, their class is hex, alnum or base64, and a
window of 20 characters slides over each. Counts of the characters in the window, and
their sum of c * log2(c), change by the one that enters and the one that leaves; a window
is hot if its entropy log2(20) - sum / 20 reaches the threshold of the class, and hot
windows that touch become one span. The allow-list suppresses candidates that are words,
numbers, UUIDs, counting sequences, placeholders or match the caller's patterns.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import anchored, joined_columns

BASE_KINDS = ["assign", "access", "hex"]
#: Entropy kinds: bits a window must reach, and the pattern of the class, tried in order.
ENTROPY_KINDS = {
    "entropy_hex": (3.0, r"^[0-9A-Fa-f]+$"),
    "entropy_alnum": (3.6, r"^[0-9A-Za-z]+$"),
    "entropy_base64": (3.6, r"^[0-9A-Za-z+/_-]+$"),
}
KINDS = [*BASE_KINDS, *ENTROPY_KINDS]
WINDOW = 20
#: Candidates with such a match are not secrets.
ALLOW = [
    r"^[A-Za-z+/_-]+$",  # no digit: words, paths
    r"^[0-9+/_-]+$",  # no letter: numbers, dates
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|dummy|x{6,}|0123456789|123456789|abcdefghij",
]
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
RUN = r"[A-Za-z0-9+/_-]{%d,}" % WINDOW
_STEP = 256


def _starts(lengths: str) -> Column:
    """Running totals before each item, in pieces so that the cost stays near linear."""
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")), lambda c: F.slice(lengths, c * _STEP + 1, F.lit(_STEP)),
    )
    grow = lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
    zero = F.array(F.lit(0))
    return F.transform(parts, lambda p: F.aggregate(p, zero, grow))


def _found(df: DataFrame, text: str, where: Column, pattern: str, out: str, value_group: bool = False) -> DataFrame:
    """Column ``out``: leftmost non-overlapping matches as structs (s, e, hit, value).

    Each step takes the gap before a match with it, so lengths give places in code points;
    the last takes the rest of the text, which keeps the search linear.
    """
    whole = rf"([\s\S]*?)({pattern}|\z)"
    gaps, hits, values, lengths, inner, offsets, starts = (f"{out}_{k}" for k in ("gaps", "hits", "values", "lengths", "inner", "offsets", "starts"))
    pick = lambda k: F.when(where, F.regexp_extract_all(F.col(text), F.lit(whole), F.lit(k)))
    df = df.withColumn(gaps, F.transform(pick(1), lambda g: F.length(g))).withColumn(hits, pick(2))
    df = df.withColumn(values, pick(3) if value_group else F.col(hits))
    df = df.withColumn(lengths, F.zip_with(gaps, hits, lambda g, h: g + F.length(h)))
    df = df.withColumn(inner, F.when(F.col(lengths).isNotNull(), _starts(lengths)))
    df = df.withColumn(offsets, F.aggregate(
        inner, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(p, -1))),
    ))
    df = df.withColumn(starts, F.flatten(F.transform(
        inner, lambda p, c: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(offsets, c)),
    )))
    spans = F.transform(F.arrays_zip(
        F.col(starts).alias("a"), F.col(gaps).alias("g"), F.col(hits).alias("h"), F.col(values).alias("v"),
    ), lambda z: F.struct((z["a"] + z["g"]).alias("s"), (z["a"] + z["g"] + F.length(z["h"])).alias("e"), z["h"].alias("hit"), z["v"].alias("value")))
    df = df.withColumn(out, F.filter(spans, lambda z: z["hit"] != ""))
    return df.drop(gaps, hits, values, lengths, inner, offsets, starts)


def _weight(count: Column) -> Column:
    """c * log2(c) from a table of the window's counts."""
    return F.get(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)]), count)


def _hot_spans(run: Column, threshold: Column) -> Column:
    """Merged hot windows of one candidate, as structs (s, e) counted from its start."""
    chars = F.filter(F.split(run, "", -1), lambda c: c != "")
    empty = F.array().cast("array<struct<s:int,e:int>>")
    # Characters and their distinct letters are bound once, as one element, so that no
    # lambda below recomputes them for each character.
    bound = F.array(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("letters")))
    return F.aggregate(bound, empty, lambda none, held: F.aggregate(
        F.array(F.struct(
            F.transform(held["chars"], lambda c: F.array_position(held["letters"], c).cast("int") - 1).alias("codes"),
            F.size(held["letters"]).alias("width"),
        )),
        empty,
        lambda none, it: F.aggregate(
            F.sequence(F.lit(0), F.size(it["codes"]) - 1),
            F.struct(
                F.array_repeat(F.lit(0), it["width"]).alias("counts"), F.lit(0.0).alias("total"), empty.alias("spans"),
            ),
            lambda acc, i: _slide(acc, i, F.get(it["codes"], i), F.get(it["codes"], i - WINDOW), threshold),
            lambda acc: acc["spans"],
        ),
    ))


def _slide(acc: Column, i: Column, enters: Column, leaves: Column, threshold: Column) -> Column:
    """One step of the window: two counts change, and the sum of weights with them."""
    gained, lost = F.get(acc["counts"], enters), F.coalesce(F.get(acc["counts"], leaves), F.lit(1))
    total = acc["total"] + F.when(enters == leaves, F.lit(0.0)).otherwise(
        _weight(gained + 1) - _weight(gained) + F.when(leaves.isNull(), F.lit(0.0)).otherwise(_weight(lost - 1) - _weight(lost)),
    )
    total = F.when(leaves.isNull(), acc["total"] + _weight(gained + 1) - _weight(gained)).otherwise(total)
    counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == enters, 1).otherwise(0) - F.when(j == leaves, 1).otherwise(0))
    hot = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= threshold)
    start, end = i - (WINDOW - 1), i + 1
    last = F.get(acc["spans"], F.size(acc["spans"]) - 1)
    joins = F.coalesce(last["e"] >= start, F.lit(False))
    spans = F.when(~hot, acc["spans"]).when(
        joins, F.concat(F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1), F.array(F.struct(last["s"].alias("s"), end.alias("e")))),
    ).otherwise(F.concat(acc["spans"], F.array(F.struct(start.alias("s"), end.alias("e")))))
    return F.struct(counts.alias("counts"), total.alias("total"), spans.alias("spans"))


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets", allow: list[str] | None = None) -> DataFrame:
    """``docs`` with the array ``into`` of structs (start, kind, end, name), by start, then kind.

    Places count code points, ends are exclusive; ``kind`` numbers ``KINDS``, ``name`` names it. A null
    or empty text has no spans. Every row is judged by its own text, so null or repeated ids
    do not matter. A taken name ``into`` gets leading underscores. ``allow`` adds patterns to the allow-list; fixed kinds are never suppressed.
    """
    names = list(docs.columns)
    into = joined_columns(names, into)
    new = lambda c: joined_columns(names, f"{into}_{c}")
    text, long, assign, access, hexes, runs, hot = (new(c) for c in ("text", "long", "assign", "access", "hex", "runs", "hot"))
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    low = F.lower(text)
    words = ["password", "passwd", "secret", "token", "apikey", "api_key"]
    assigns = reduce(or_, (F.contains(low, F.lit(word)) for word in words))
    df = df.withColumn(long, F.col(text).rlike(RUN))
    df = _found(df, text, assigns, ASSIGN, assign, value_group=True)
    df = _found(df, text, F.contains(F.col(text), F.lit("AKIA")), ACCESS, access)
    df = _found(df, text, F.col(long), r"[0-9a-f]{24,}", hexes)
    df = _found(df, text, F.col(long), RUN, runs)

    suppressed = lambda hit: reduce(or_, (hit.rlike(p) for p in ALLOW + (allow or [])))
    kind = lambda hit: F.when(hit.rlike(ENTROPY_KINDS["entropy_hex"][1]), 3).when(hit.rlike(ENTROPY_KINDS["entropy_alnum"][1]), 4).otherwise(5)
    limits = F.array(*[F.lit(0.0)] * len(BASE_KINDS), *[F.lit(t) for t, _ in ENTROPY_KINDS.values()])
    df = df.withColumn(runs, F.transform(F.filter(runs, lambda r: ~suppressed(r["hit"])), lambda r: F.struct(r["s"].alias("s"), r["hit"].alias("hit"), kind(r["hit"]).alias("kind"))))
    df = df.withColumn(hot, F.flatten(F.transform(runs, lambda r: F.transform(
        _hot_spans(r["hit"], F.get(limits, r["kind"])),
        lambda w: F.struct((r["s"] + w["s"]).alias("start"), r["kind"].alias("kind"), (r["s"] + w["e"]).alias("end")),
    ))))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    fixed = lambda c, k: F.coalesce(F.transform(c, lambda m: F.struct(m["s"].alias("start"), F.lit(k).alias("kind"), m["e"].alias("end"))), none)
    spans = F.sort_array(F.concat(
        fixed(F.filter(assign, lambda m: F.length(m["value"]) >= 6), 0), fixed(F.filter(access, lambda m: F.length(m["hit"]) >= 20), 1), fixed(F.col(hexes), 2),
        F.coalesce(F.col(hot), none),
    ))
    label = F.array(*map(F.lit, KINDS))
    spans = F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.get(label, m["kind"]).alias("name")))
    return df.withColumn(into, anchored(spans)).select(*names, into)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["name"], m["start"].cast("string"), m["end"].cast("string"))), ",")
