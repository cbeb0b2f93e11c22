"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: lower case, look-alike letters to Latin, invisible characters away, digits and signs
that stand for letters to those letters. The lexicon holds whole words and word beginnings.
Its entries come from a short list and from labelled training rows: candidates are words
and beginnings that toxic rows have, kept if a log-likelihood ratio shows they are far
commoner there; the weight is the log odds ratio. Each word of a text takes the largest weight
that matches it, unless an exception phrase covers it. The sum, by itself and over the
length, goes through a logistic fitted to the training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import arrow_pass, pinned

#: Labelled training rows that the lexicon is fitted on, at most: those with the smallest hashes.
FIT_ROWS = 40_000
#: Toxic rows, log-likelihood ratio and log odds that an entry needs.
MIN_ROWS, MIN_RATIO, MIN_WEIGHT, MAX_WEIGHT = 4, 30.0, 2.0, 8.0
#: Letters of the word beginnings that are tried.
PREFIXES = (4, 5, 6, 7, 8)
#: Words that count before anything is learned, with the weight of each.
SEED_WEIGHT = 3.0
SEEDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "imbecile", "bastard", "vermin"]
#: Phrases inside which a word is not meant.
EXCEPTIONS = ["trash can", "trash bag", "sore loser", "not stupid", "not an idiot", "not worthless", "stupid question", "class clown", "clown fish"]

#: Look-alikes of Latin letters (Cyrillic, then Greek).
LOOK_ALIKES = dict(zip("авекмнорстухіјѕԁԛԝ", "abekmhopctyxijsdqw")) | dict(zip("αβεικνορτυχ", "abeiknoptux"))
#: Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_INVISIBLE = [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]
_FOLD = {ord(k): v for k, v in LOOK_ALIKES.items()} | {c: None for c in _INVISIBLE} | {0xFF41 + k: chr(97 + k) for k in range(26)} | {0xFF10 + k: chr(48 + k) for k in range(10)}
_NEEDS_FOLD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_SIGNS = re.escape("".join(STAND_INS))
_STAND_IN = re.compile(rf"[{_SIGNS}](?=[{_SIGNS}]*[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii() and _NEEDS_FOLD.search(text):
        text = text.translate(_FOLD)
    return _STAND_IN.sub(lambda m: STAND_INS[m.group()], text)


class Lexicon:
    """Matcher over {term: (weight as a word, weight as a beginning)} and exception phrases."""

    def __init__(self, terms: dict[str, tuple[float, float]], exceptions: list[str] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weights in terms.items():
            self.automaton.add_word(term, (len(term), *weights))
        for phrase in exceptions:
            weights = terms.get(phrase, (0.0, 0.0))
            self.automaton.add_word(phrase, (len(phrase), *weights, True))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of each word that matches, by its start."""
        found: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        if self.empty:
            return found
        size = len(folded)
        for end, (length, word, beginning, *phrase) in self.automaton.iter(folded):
            start = end - length + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end + 1 == size or not folded[end + 1].isalpha()
            if phrase and whole:
                covered.append((start, end))
            weight = max(word, beginning) if whole else beginning
            if weight > found.get(start, 0.0):
                found[start] = weight
        for lo, hi in covered:
            for start in [s for s in found if lo <= s <= hi]:
                del found[start]
        return found

    def measures(self, text: str) -> tuple[float, int]:
        """Sum of weights, and words."""
        return sum(self.hits(fold(text)).values()), len(text.split())


def _features(weights: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Constant, sum, sum by length, and whether anything matched."""
    return np.stack([np.ones(len(weights)), np.log1p(weights), np.log1p(100 * weights / (words + 20)), (weights > 0) * 1.0], axis=1)


#: Used when the training rows have not both labels.
_PRIOR = np.array([-4.0, 2.0, 0.0, 2.0])


def _fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps with a ridge; a handful of coefficients."""
    if len(y) == 0 or y.min() == y.max():
        return _PRIOR
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
    return w


def is_training(id_col: str, divisor: int, held: int) -> Column:
    """Rows whose crc32 of the id as text leaves another remainder than the held-out one."""
    return F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary")) % divisor != held


def fit_sample(docs: DataFrame, labels: DataFrame, training: Column, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, body, label) of at most ``rows`` labelled training rows, the smallest hashes of the id.

    Label rows with a null id or label are left out, repeated ones take their largest label.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & training)
        .groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), body.alias("body"))
    return pinned(texts.join(F.broadcast(chosen), "id"), "fit-sample")


def _row_terms(body: bytes) -> set[str]:
    """The words ("=", 3 to 40 letters) and beginnings ("^") of one text."""
    words = set(_WORD.findall(fold(body.decode("utf-8", "replace"))))
    terms = {"=" + w for w in words if 3 <= len(w) <= 40}
    terms.update("^" + w[:k] for w in words for k in PREFIXES if len(w) > k)
    return terms


def _supports(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(term, toxic, clean): rows of the batch of each label that have the term."""
    counts: Counter = Counter()
    for body, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        side = int(label > 0)
        counts.update((t, side) for t in _row_terms(body))
    terms = sorted({t for t, _ in counts})
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([counts[(t, 1)] for t in terms], pa.int64()), pa.array([counts[(t, 0)] for t in terms], pa.int64())],
        names=["term", "toxic", "clean"],
    )


def _log_ratio(a: int, n: int, b: int, m: int) -> float:
    """Log-likelihood ratio of a out of n against b out of m."""
    def part(k, of, p):
        return (k * math.log(p) if k else 0.0) + ((of - k) * math.log(1 - p) if of > k else 0.0)

    both = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both))


def _spark_log_ratio(a: Column, n: Column, b: Column, m: Column) -> Column:
    """``_log_ratio`` as a Spark expression."""
    def part(k, of, p):
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(of > k, (of - k) * F.log(1 - p)).otherwise(0.0)

    both = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both))


def learn_terms(sample: DataFrame) -> dict[str, tuple[float, float]]:
    """{term: (weight as a word, weight as a beginning)} from (id, body, label) rows.

    Toxic support of every word and beginning of the sample is counted first; clean rows
    are counted only for terms that enough toxic rows have, and for listed words, the only
    ones that can pass. The ratio and weight tests run in Spark, and only the terms that
    pass, and listed words that clean rows use more, reach the driver.
    """
    totals = sample.agg(F.count_if(F.col("label") > 0).alias("a"), F.count_if(F.col("label") <= 0).alias("b")).first()
    weights: dict[str, list[float]] = {s: [SEED_WEIGHT, 0.0] for s in SEEDS}
    toxic, clean = totals["a"], totals["b"]
    if not toxic or not clean:
        return {t: tuple(w) for t, w in weights.items()}
    a, b, n, m = F.col("a"), F.col("b"), F.lit(float(toxic)), F.lit(float(clean))
    weight = F.log((a + 0.5) / (n - a + 0.5)) - F.log((b + 0.5) / (m - b + 0.5))
    kept = (a >= MIN_ROWS) & (a / n > b / m) & (weight >= MIN_WEIGHT) & (_spark_log_ratio(a, n, b, m) >= MIN_RATIO)
    listed = ["=" + s for s in SEEDS]

    def support(rows: DataFrame, side: str) -> DataFrame:
        return arrow_pass(rows.select("body", "label"), _supports, "term string, toxic bigint, clean bigint").select("term", F.col(side).alias("n"))

    in_toxic = support(sample.where("label > 0"), "toxic").groupBy("term").agg(F.sum("n").alias("a"))
    names = sample.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in listed])).alias("term"), F.lit(0).cast("bigint").alias("a"))
    tried = pinned(
        in_toxic.where((a >= MIN_ROWS) | F.col("term").isin(listed)).unionByName(names).groupBy("term").agg(F.sum("a").alias("a")), "toxic-terms",
    )
    in_clean = support(sample.where("label <= 0"), "clean").join(F.broadcast(tried.select("term")), "term").groupBy("term").agg(F.sum("n").alias("b"))
    supports = tried.join(in_clean, "term", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b"))
    found = supports.where(kept | F.col("term").isin(listed)).select(
        "term", "a", "b", kept.alias("kept"), F.least(weight, F.lit(MAX_WEIGHT)).alias("weight"),
    )
    for row in found.collect():
        entry = weights.setdefault(row.term[1:], [0.0, 0.0])
        if row.kept:
            entry[row.term[0] == "^"] = row.weight
        elif row.term[0] == "=" and row.b > row.a and row.b >= MIN_ROWS:
            entry[0] = 0.0  # a listed word that clean rows use more
    return {t: tuple(w) for t, w in weights.items() if max(w) > 0}


def _measured(terms: dict[str, tuple[float, float]]):
    held: list[Lexicon] = []

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Lexicon(terms))
        rows = [held[0].measures(b.as_py().decode("utf-8", "replace")) for b in batch.column(0)]
        weights, words = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(weights, pa.float64()), pa.array(words, pa.int64())], names=[*batch.schema.names[1:], "weight", "words"])

    return measure


def toxicity_scores(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, weight, words, score) for each row of ``docs``; score is the chance of label 1.

    ``training`` says which label rows may be learned from. A null or empty text has weight 0 and
    scores as any text without a match. Rows with null or repeated ids are scored each by
    its text, but null ids are never learned from. Without both labels among the training rows the listed
    words and fixed coefficients serve. Other columns are not read.
    """
    sample = fit_sample(docs, labels, training, id_col, text_col, label_col, fit_rows)
    terms = learn_terms(sample)
    measured = arrow_pass(sample.select("body", "label"), _measured(terms), "label int, weight double, words bigint").toArrow()
    x = _features(measured["weight"].to_numpy(), measured["words"].to_numpy())
    model = _fit_logistic(x, (measured["label"].to_numpy() > 0) * 1.0)
    run = _measured(terms)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = run(batch)
        z = _features(out.column("weight").to_numpy(), out.column("words").to_numpy()) @ model
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*out.schema.names, "score"])

    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body")
    rows = docs.select(body, F.col(id_col).cast("bigint").alias("id"))
    return arrow_pass(rows, score, "id bigint, weight double, words bigint, score double")
