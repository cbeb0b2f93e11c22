"""Filter interaction audit by min-plus removal ranks.

Five filters judge every document; a filter order removes a document at the first step whose
filter it fails. With a mask matrix M (document x filter: 0 where the filter fails, infinity
where it passes) and a position matrix P (filter x order: the filter's step in the order, the
inverse permutation), the removal step of every document under every order is the min-plus
product R = M (min,+) P. R is computed once per distinct (part, mask) row, after documents
are counted into those rows, so that work after the first aggregate does not grow with the
table: at most 32 masks a part, 120 orders and 5 steps. Removal steps then scatter their
weights (documents, good ones, toxic ones) into counts by (part, order, step).

Failure conditions, on ``text`` (null: empty; words: maximal ``[^\\x20\\x09-\\x0D]+``,
case-sensitive; lengths in code points):

* A: fewer than 200 words;
* B: 100 * distinct words < 50 * words;
* C: 100 * characters ``[A-Z]`` > 3 * code points;
* D: holds any of ``#$%&*|``;
* E: the same text as a row with a smaller doc_id, anywhere in the table, removed or not.

Defined handling: a part is a ``lang`` value, null taken as the empty string. Rows are
documents: repeated rows count each time, and none of two rows with one doc_id and one text
fails E by the other. A null doc_id is never smaller than another, so such rows fail E only
through a non-null smaller one. Labels of one doc_id that disagree count as good (or toxic) if
any row says 1; unlabelled documents are neither. Every part present gets all 600 rows,
zeros included; an empty table gives no rows. Extra input columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The filter letters, in the order of their bits.
FILTERS = "ABCDE"
#: Every order of the five filters, as a string applied left to right.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Step of a document that no filter removes.
NEVER = len(FILTERS) + 1

WORD = r"[^\x20\x09-\x0D]+"


def failure_mask(text: Column, later: Column) -> Column:
    """Bit i set where filter FILTERS[i] fails; E needs the table, so whether a smaller doc_id holds the text is ``later``."""
    body = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD), 0)
    n_words = F.size(words)
    n_chars = F.length(body)
    upper = n_chars - F.length(F.regexp_replace(body, "[A-Z]", ""))
    fails = [
        n_words < 200,
        F.size(F.array_distinct(words)) * 100 < n_words * 50,
        upper * 100 > n_chars * 3,
        body.rlike(r"[#$%&*|]"),
        later,
    ]
    return sum(F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails))


def removal_steps(mask: Column) -> Column:
    """Min-plus product of one mask row with the position matrix: the removal step under each order."""
    orders = F.array(*[F.lit(o) for o in ORDERS])
    bits = F.array(*[F.lit(i) for i in range(len(FILTERS))])
    letters = F.array(*[F.lit(x) for x in FILTERS])
    return F.transform(
        orders,
        lambda order: F.array_min(F.transform(
            bits, lambda i: F.when(mask.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0, F.instr(order, F.element_at(letters, i + 1))).otherwise(F.lit(NEVER)),
        )),
    )


def masked_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents counted by part and failure mask.

    Filters A to D are judged on each row where it is read; E is settled by text digest
    afterwards. Rows are first counted by (digest, part, labels, mask of A to D), keeping the
    smallest doc_id and its number of rows, so that a text with many copies is a few rows
    before the window that finds its smallest doc_id. No text is shuffled.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"),
    )
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.sha2(body, 256).alias("digest"), F.length(body).alias("length"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"), failure_mask(body, F.lit(False)).alias("base"),
    ).join(marks, "doc_id", "left").select(
        "doc_id", "digest", "length", "part", "base",
        F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"),
    )
    keys = ["digest", "length", "part", "good", "toxic", "base"]
    per_id = rows.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"))
    grouped = per_id.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "n")).alias("least"),
    )
    smallest = F.min(F.col("least.doc_id")).over(Window.partitionBy("digest", "length"))
    first = (
        F.when(F.col("smallest").isNull(), F.col("n"))
        .when(F.col("least.doc_id") == F.col("smallest"), F.col("least.n"))
        .otherwise(F.lit(0))
    )
    split = grouped.withColumn("smallest", smallest).select(
        "part", "good", "toxic", "base",
        F.array(F.struct(F.lit(0).alias("e"), first.alias("n")), F.struct(F.lit(1 << 4).alias("e"), (F.col("n") - first).alias("n"))).alias("sides"),
    ).select("part", "good", "toxic", "base", F.explode("sides").alias("side")).where("side.n > 0")
    return split.groupBy("part", (F.col("base") + F.col("side.e")).alias("mask")).agg(
        F.sum("side.n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("side.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("side.n")).otherwise(0)).alias("toxic"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per (part, filter_order, step) with the counts of the module docstring.

    Columns: part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (longs but step).
    """
    counted = masked_counts(docs, labels)
    ranked = counted.select(
        "part", "mask", "n", "good", "toxic", F.posexplode(removal_steps(F.col("mask"))).alias("order_at", "rank"),
    )
    stepped = ranked.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("order_at") + 1)
    letter = F.substring(order, F.col("step"), 1)
    bit = F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    here = F.col("rank") == F.col("step")

    def weigh(condition: Column, weight: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(weight)).otherwise(F.lit(0))).cast("bigint")

    table = stepped.groupBy("part", order.alias("filter_order"), F.col("step").cast("int").alias("step"), letter.alias("filter")).agg(
        weigh(F.col("rank") > F.col("step")).alias("kept"),
        weigh(here).alias("removed"),
        weigh((F.col("mask").bitwiseAND(bit) != 0) & (F.col("rank") < F.col("step"))).alias("redundant"),
        weigh(F.col("mask") == bit).alias("unique_fails"),
        weigh(here, "good").alias("good_lost"),
        weigh(here, "toxic").alias("toxic_lost"),
    )
    shapley = table.groupBy("part", "filter").agg(F.sum("removed").cast("bigint").alias("shapley"))
    return table.join(shapley, ["part", "filter"])
