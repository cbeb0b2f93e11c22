"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A rule is a statistic of the text and a fixed sequence of cutoffs from lax to strict; a
document fails it if the statistic is over the cutoff of its stratum (a class of length).
Labelled documents are dealt by crc32 of the id: two thirds are the holdout, one third
tunes. Going down a sequence, a cutoff is certified while the exact binomial tail
P(Bin(n, ALPHA) <= k) of the k good holdout documents that it rejects, out of n, is at most
DELTA divided by the number of sequences (Bonferroni over rules and strata; inside a
sequence the order is fixed beforehand, so stopping at the first failure needs no more).
With probability 1 - DELTA, then, no rule rejects over ALPHA of the good documents of any
stratum. Of the certified cutoffs the tuning third picks the one that rejects most bad
documents net of good ones, the laxest at ties; one that rejects no bad document is not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import anchored, joined_columns

#: False rejections allowed to each rule in each stratum, and the risk of any exception.
ALPHA, DELTA = 0.01, 0.1
#: Good documents that one bad document outweighs when a cutoff is picked.
GOOD_COST = 5
#: Base rule: fewer words than this, or over 20 percent of them in repeated windows.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Words at which a stratum begins.
STRATA = (0, 120, 600)
#: Cutoffs of each rule, lax to strict.
GRIDS: dict[str, list[float]] = {
    "symbols_per_word": [2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1],
    "upper_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "exclamations_per_word": [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.2],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_share": [0.9, 0.7, 0.5, 0.3, 0.2, 0.1],
    "mean_word_chars": [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0],
}
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_WHITE = " \t\n\x0b\f\r"


def _repeat_words(df: DataFrame, words: str, n: str, out: str) -> DataFrame:
    """Words covered by windows of five that the text has twice or more.

    Distinct hashes of all windows prove that no window repeats; only the other texts
    compare the windows themselves, sorted with their places.
    """
    h, wh, pairs, places = (f"{out}_{k}" for k in ("h", "wh", "pairs", "places"))
    spots = F.sequence(F.lit(0), F.col(n) - WINDOW)
    df = df.withColumn(h, F.when(F.col(n) > WINDOW, F.transform(words, lambda w: F.xxhash64(w))))
    df = df.withColumn(wh, F.when(F.col(h).isNotNull(), F.transform(spots, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))))
    repeats = F.size(F.array_distinct(wh)) < F.size(wh)
    df = df.withColumn(pairs, F.when(repeats, F.sort_array(F.transform(
        spots, lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("s"), i.alias("p")),
    ))))
    same = lambda x, other: F.coalesce(x["s"] == F.get(pairs, other)["s"], F.lit(False))
    df = df.withColumn(places, F.when(F.col(pairs).isNotNull(), F.sort_array(F.filter(
        F.transform(pairs, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["p"])), lambda p: p.isNotNull(),
    ))))
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x,
    )
    return df.withColumn(out, F.when(F.col(places).isNotNull(), covered).otherwise(0).cast("bigint")).drop(h, wh, pairs, places)


def with_statistics(docs: DataFrame, text_col: str = "text", into: str = "rules") -> DataFrame:
    """``docs`` with the struct ``into``: base counts, rule statistics, stratum and base_failed.

    Words are runs without ``[\\x20\\x09-\\x0D]``. A null text counts as empty: no words, all
    counts zero, base_failed. Shares of nothing are zero. Rows with null or repeated ids are
    judged each by its text. If ``docs`` has the name ``into``, it gets leading underscores.
    """
    names = list(docs.columns)
    into = joined_columns(names, into)
    new = lambda c: joined_columns(names, f"{into}_{c}")
    text, bare, words, n, lines, rep = (new(c) for c in ("text", "bare", "words", "n", "lines", "rep"))
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(bare, F.btrim(text, F.lit(_WHITE)))
    df = df.withColumn(words, F.when(F.col(bare) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+")))
    df = df.withColumn(n, F.size(words))
    df = df.withColumn(lines, F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(_WHITE)) != ""))
    df = _repeat_words(df, words, n, rep)
    hits = lambda pattern: (F.size(F.split(text, pattern, -1)) - 1).cast("bigint")
    base = new("base")
    df = df.withColumn(base, anchored(F.struct(
        F.col(n).cast("bigint").alias("n_words"), F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        hits(r"[#*$%&|<>]").alias("n_symbols"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.col(rep).alias("n_repeat_words"), F.size(lines).alias("n_lines"), hits("[A-Z]").alias("n_upper"), hits("!").alias("n_exclamations"),
    )))
    b = lambda c: F.col(f"{base}.{c}")
    share = lambda a, c: F.coalesce(b(a) / F.nullif(b(c), F.lit(0)), F.lit(0.0))
    statistics = F.struct(
        share("n_symbols", "n_words").alias("symbols_per_word"), share("n_upper", "word_chars").alias("upper_share"),
        share("n_exclamations", "n_words").alias("exclamations_per_word"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word_chars"),
    )
    stratum = sum((F.when(b("n_words") >= s, 1).otherwise(0) for s in STRATA[1:]), F.lit(0))
    failed = (b("n_words") < MIN_WORDS) | (100 * b("n_repeat_words") > REPEAT_PERCENT * b("n_words"))
    return df.select(*names, F.struct(
        *[b(c).alias(c) for c in _BASE], statistics.alias("statistics"), stratum.cast("int").alias("stratum"), failed.alias("base_failed"),
    ).alias(into))


def _ln_factorial(n: Column) -> Column:
    """Stirling's series at n + 10, brought back by the ten factors in between."""
    x = n.cast("double") + 10
    series = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return series - sum((F.log(n + k) for k in range(2, 11)), F.log(n + 1))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly: the term at k, then downwards by the ratio of neighbours."""
    last = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    down = F.when(k > 0, F.sequence(k, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<bigint>"))
    step = lambda acc, i: F.struct(
        (acc["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("term"),
        (acc["total"] + acc["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("total"),
    )
    return F.aggregate(down, F.struct(last.alias("term"), last.alias("total")), step, lambda acc: acc["total"])


def calibrate(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rules: str = "rules", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, k, tail): the certified cutoff of each rule and stratum.

    ``stats`` has ``id_col`` and the struct of :func:`with_statistics`. Label rows with a null
    id or label are left out, repeated ones take their smallest label; without labels there
    are no cutoffs. All rows count, those that fail the base rule too, as they are judged alike.
    """
    marked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("bigint").alias("key")).agg(F.min(label_col).alias("good"))
    )
    values = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{rules}.statistics.{r}").alias("value")) for r in GRIDS])
    tune = F.crc32(F.col("key").cast("string").cast("binary")) % 3 == 0
    grids = F.create_map(*[x for r, g in GRIDS.items() for x in (F.lit(r), F.array(*map(F.lit, g)))])
    seen = (
        stats.where(~F.col(f"{rules}.base_failed"))
        .select(F.col(id_col).cast("bigint").alias("key"), F.col(f"{rules}.stratum").alias("stratum"), F.explode(values).alias("v"))
        .join(marked, "key").select("key", "stratum", "good", "v.rule", "v.value", tune.alias("tune"))
        # the first cutoff, lax to strict, that the value is over; all later ones are smaller
        .withColumn("first", F.size(F.filter(grids[F.col("rule")], lambda c: F.col("value") <= c)))
        .groupBy("stratum", "rule", "first").agg(
            F.count_if(~F.col("tune") & (F.col("good") == 1)).alias("good_hold"),
            F.count_if(F.col("tune") & (F.col("good") == 1)).alias("good_tune"),
            F.count_if(F.col("tune") & (F.col("good") != 1)).alias("bad_tune"),
        )
    )
    # at most strata x rules x (cutoffs + 1) rows from here on
    levels = (
        seen.groupBy("stratum", "rule").agg(F.sum("good_hold").alias("n"), F.collect_list(F.struct("first", "good_hold", "good_tune", "bad_tune")).alias("at"))
        .withColumn("grid", grids[F.col("rule")]).select("*", F.posexplode("grid").alias("level", "cutoff"))
    )
    over = lambda c: F.aggregate(
        F.col("at"), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["first"] <= F.col("level"), x[c]).otherwise(F.lit(0).cast("bigint")),
    )
    tests = levels.select("stratum", "rule", "level", "cutoff", "n", over("good_hold").alias("k"), over("good_tune").alias("good"), over("bad_tune").alias("bad"))
    tail = F.when(F.col("k") < F.col("n") * alpha, binomial_tail(F.col("n"), F.col("k"), alpha)).otherwise(1.0)
    tests = tests.withColumn("tail", tail)
    failing = F.col("tail") > delta / (len(GRIDS) * len(STRATA))
    stop = tests.groupBy("stratum", "rule").agg(F.min(F.when(failing, F.col("level"))).alias("stop"))
    certified = tests.join(stop, ["stratum", "rule"]).where("stop is null or level < stop").withColumn("net", F.col("bad") - GOOD_COST * F.col("good")).where("net > 0")
    best = certified.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n", "k", "tail"), F.struct("net", -F.col("level"))).alias("b"))
    return best.select("stratum", "rule", "b.*")


def verdict(cutoffs: list, rules: str = "rules") -> Column:
    """Names of the rules that a row of :func:`with_statistics` fails, for collected cutoffs."""
    checks = [
        F.when((F.col(f"{rules}.stratum") == c["stratum"]) & (F.col(f"{rules}.statistics.{c['rule']}") > c["cutoff"]), F.lit(c["rule"]))
        for c in sorted(cutoffs, key=lambda c: (c["rule"], c["stratum"]))
    ]
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def quality_rules(stats: DataFrame, cutoffs: DataFrame, rules: str = "rules", kept: str = "kept", failed: str = "failed_rules") -> DataFrame:
    """``stats`` with the failed rules and ``kept``: neither the base rule nor a cutoff fails.

    Columns of ``stats`` named as the new ones are replaced. The driver sees one row for each rule and stratum, 18 at most.
    """
    found = verdict(cutoffs.collect(), rules)
    return stats.withColumn(failed, found).withColumn(kept, ~F.col(f"{rules}.base_failed") & (F.size(failed) == 0))
