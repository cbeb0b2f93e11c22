"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Classes split the counted vocabulary by
frequency: words of the head table go to classes of equal root mass, all others, unseen words
too, to the last class. The class factor is a softmax over weights of hashed features of the
history: the word before, the two words before, the word before the last (a skip), and a
bias. The word factor is the smoothed share of the word in its class.

Counts and both factors use every training document. Gradient training is distributed: each
task takes Adagrad steps over the documents it reads, from the weights of the round before;
weights are averaged by bucket, weighted by updates, in two levels of groups of bounded
size. Scoring runs in numpy batches; words outside the head table, which is bounded, meet their
counts in a shuffled join of (document, word) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import flat_lists, ids_and_bytes, mix, pinned, word_hashes

CLASSES, BUCKETS, ROUNDS = 32, 1 << 15, 2
#: Words of the head table at most (16 bytes each).
HEAD_WORDS = 1 << 19
#: Added to each count.
SMOOTH = 0.1
RATE, STEP_TOKENS, COUNT_TOKENS = 0.15, 4096, 1 << 22
SLICES, FAN_IN = 64, 64
END = xxhash.xxh3_64_intdigest(b"")
_START = np.uint64(0x5BD1E9955BD1E995)
_TURNS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def tokens(body: bytes) -> np.ndarray:
    """Hashes of the lower-cased words, then of the end."""
    return np.append(word_hashes(body), np.uint64(END))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])

    for batch in batches:
        for body in batch.column(1):
            held.append(tokens(body.as_py()))
            size += len(held[-1])
            if size >= COUNT_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def word_counts(training: DataFrame) -> DataFrame:
    """(h, n) over all training texts; ``training`` has id and body."""
    return training.mapInArrow(_tally, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Totals of the counts, and the head table with classes."""

    def __init__(self, counts: DataFrame, head_words: int = HEAD_WORDS):
        level = F.floor(F.log2("n") * 8).cast("int")
        bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
        self.total, self.distinct = sum(r.tokens for r in bins), sum(r.words for r in bins)
        low, room = 1 << 30, head_words
        for r in sorted(bins, key=lambda r: -r.level):
            if r.words > room:
                break
            low, room = r.level, room - r.words
        head = counts.where(level >= low).toArrow()
        keys, n = head["h"].to_numpy().view(np.uint64), head["n"].to_numpy()
        order = np.lexsort((keys, -n))
        mass = np.cumsum(np.sqrt(n[order]))
        classes = np.empty(len(n), np.int16)
        classes[order] = np.minimum((mass / (mass[-1] if len(mass) else 1) * (CLASSES - 1)).astype(np.int16), CLASSES - 2)
        order = np.argsort(keys)
        self.keys, self.classes, self.n = keys[order], classes[order], n[order].astype(np.float64)
        in_class = np.bincount(self.classes, self.n, CLASSES)
        words = np.bincount(self.classes, minlength=CLASSES).astype(np.float64)
        in_class[-1], words[-1] = self.total - self.n.sum(), self.distinct - len(self.n) + 1
        self.class_total = np.log10(np.maximum(in_class + SMOOTH * words, 1e-300))
        self.base_total = np.log10(self.total + SMOOTH * (self.distinct + 1))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the head table, whether it is there, and class of each word."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool), np.full(len(hashes), CLASSES - 1, np.int16)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        there = self.keys[at] == hashes
        return at, there, np.where(there, self.classes[at], np.int16(CLASSES - 1))


def histories(texts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All tokens of the texts in a row, and the bucket of each feature of each token's history."""
    row = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    one, two = np.empty_like(row), np.empty_like(row)
    one[1:], two[2:] = row[:-1], row[:-2]
    starts = np.cumsum([0, *[len(t) for t in texts]])[:-1]
    starts = starts[starts < len(row)]
    one[starts], two[starts] = _START, _START
    second = starts[starts + 1 < len(row)] + 1
    two[second] = _START
    mask = np.uint64(BUCKETS - 1)
    found = [mix(one * _TURNS[0]), mix(one * _TURNS[1] + two), mix(two * _TURNS[2])]
    return row, [(f & mask).astype(np.int64) for f in found]


class Weights:
    def __init__(self, table: np.ndarray | None = None, bias: np.ndarray | None = None):
        self.table = np.zeros((BUCKETS, CLASSES), np.float32) if table is None else table
        self.bias = np.zeros(CLASSES, np.float32) if bias is None else bias

    def log_softmax(self, buckets: list[np.ndarray]) -> np.ndarray:
        z = self.table[buckets[0]]
        for b in buckets[1:]:
            z += self.table[b]
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z


def _chosen(z: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return z[np.arange(len(z)), classes]


class Trainer:
    """Adagrad over buckets: each has one learning scale."""

    def __init__(self, weights: Weights):
        self.w = Weights(weights.table.copy(), weights.bias.copy())
        self.scale = np.full(BUCKETS, 1e-3, np.float32)
        self.updates = np.zeros(BUCKETS, np.float32)
        self.bias_scale, self.seen = 1e-3, 0

    def learn(self, classes: np.ndarray, buckets: list[np.ndarray]) -> None:
        for at in range(0, len(classes), STEP_TOKENS):
            part = [b[at:at + STEP_TOKENS] for b in buckets]
            right = classes[at:at + STEP_TOKENS]
            grad = np.exp(self.w.log_softmax(part))
            grad[np.arange(len(right)), right] -= 1
            for b in part:
                order = np.argsort(b, kind="stable")
                rows, starts = np.unique(b[order], return_index=True)
                g = np.add.reduceat(grad[order], starts, axis=0)
                self.scale[rows] += (g * g).mean(axis=1)
                self.w.table[rows] -= RATE * g / np.sqrt(self.scale[rows])[:, None]
                self.updates[rows] += np.diff(np.append(starts, len(b)))
            g = grad.sum(axis=0)
            self.bias_scale += float((g * g).mean())
            self.w.bias -= RATE * g / np.sqrt(self.bias_scale)
            self.seen += len(right)


_PART = "slice int, shard int, weights binary, updates binary"


def _trained(vocabulary: Vocabulary, weights: Weights):
    """One task's round: slices of its table; the last slice is the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(weights)
        for batch in batches:
            row, buckets = histories([tokens(b.as_py()) for b in batch.column(1)])
            trainer.learn(vocabulary.look_up(row)[2].astype(np.int64), buckets)
        if trainer.seen:
            tables = [*np.split(trainer.w.table, SLICES), trainer.w.bias[None, :]]
            counts = [*np.split(trainer.updates, SLICES), np.array([trainer.seen], np.float32)]
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([
                pa.array(range(SLICES + 1), pa.int32()), pa.array([shard] * (SLICES + 1), pa.int32()),
                pa.array([t.tobytes() for t in tables], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary()),
            ], names=["slice", "shard", "weights", "updates"])

    return run


def _averaged(parts: pd.DataFrame) -> pd.DataFrame:
    total, mass = None, None
    for weights, updates in zip(parts["weights"], parts["updates"]):
        n = np.frombuffer(updates, np.float32).astype(np.float64)
        w = np.frombuffer(weights, np.float32).reshape(len(n), CLASSES) * n[:, None]
        total, mass = (w, n) if total is None else (total + w, mass + n)
    mean = (total / np.maximum(mass, 1e-9)[:, None]).astype(np.float32)
    return pd.DataFrame({"slice": [parts["slice"].iloc[0]], "shard": [parts["shard"].min() // FAN_IN], "weights": [mean.tobytes()], "updates": [mass.astype(np.float32).tobytes()]})


def train(training: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights after ``rounds`` rounds, each over its own share of all training rows.

    The driver takes 65 slices, 4 MB in all, after each round.
    """
    weights = Weights()
    for k in range(rounds):
        share = training.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
        parts = share.mapInArrow(_trained(vocabulary, weights), _PART)
        groups = parts.groupBy("slice", F.expr(f"shard div {FAN_IN}").alias("g")).applyInPandas(_averaged, _PART)
        for row in groups.groupBy("slice").applyInPandas(_averaged, _PART).collect():
            n = np.frombuffer(row.updates, np.float32)
            found = np.frombuffer(row.weights, np.float32).reshape(len(n), CLASSES)
            if row.slice == SLICES:
                weights.bias = found[0].copy()
            else:
                at = row.slice * (BUCKETS // SLICES)
                weights.table[at:at + len(n)][n > 0] = found[n > 0]
    return weights


def _scorer(vocabulary: Vocabulary, weights: Weights):
    log10e = np.log10(np.e)
    # what a head word adds to either score
    base = np.log10(vocabulary.n + SMOOTH) - vocabulary.base_total
    within = np.log10(vocabulary.n + SMOOTH) - vocabulary.class_total[vocabulary.classes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [tokens(b.as_py()) for b in batch.column(1)]
            row, buckets = histories(texts)
            at, there, classes = vocabulary.look_up(row)
            chosen = np.empty(len(row))
            for k in range(0, len(row), STEP_TOKENS):
                z = weights.log_softmax([b[k:k + STEP_TOKENS] for b in buckets])
                chosen[k:k + STEP_TOKENS] = _chosen(z, classes[k:k + STEP_TOKENS].astype(np.int64))
            model = chosen * log10e
            plain = np.full(len(row), -vocabulary.base_total)
            model[~there] -= vocabulary.class_total[-1]
            if len(vocabulary.keys):
                model[there] += within[at[there]]
                plain[there] = base[at[there]]
            ends = np.cumsum([len(t) for t in texts])
            starts = ends - [len(t) for t in texts]
            rare, times = zip(*[np.unique(t[~there[s:e]], return_counts=True) for t, s, e in zip(texts, starts, ends)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(ends - starts, pa.int64()), pa.array(np.add.reduceat(there.astype(np.int64), starts), pa.int64()),
                pa.array(np.add.reduceat(plain, starts)), pa.array(np.add.reduceat(model, starts)),
                flat_lists([r.view(np.int64) for r in rare], pa.int64()), flat_lists([t.astype(np.int64) for t in times], pa.int64()),
            ], names=["id", "row", "n_tokens", "n_head", "plain", "model", "rare", "times"])

    return run


def language_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end; words are told
    apart by 64-bit hashes. ``training`` says which rows are learned from; a null there is no.
    ``base_score`` sums log10((c + 0.1) / (N + 0.1 * (V + 1))), ``score`` is the model's log10
    probability. A null or empty text is its end token. Rows with null or repeated ids are
    scored each by its text. Without training rows every count is zero and the model is
    uniform over classes. Other columns are not read.
    """
    raw = ids_and_bytes(docs, id_col, text_col, F.coalesce(training, F.lit(False)).alias("learn"))
    learned = raw.where("learn").select("id", "body")
    counts = pinned(word_counts(learned), "word-counts")
    vocabulary = Vocabulary(counts, head_words)
    weights = train(learned, vocabulary)
    texts = raw.select("id", "body", F.monotonically_increasing_id().alias("row"))
    scored = pinned(texts.mapInArrow(
        _scorer(vocabulary, weights),
        "id bigint, row bigint, n_tokens bigint, n_head bigint, plain double, model double, rare array<bigint>, times array<bigint>",
    ), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("row", F.col("z.rare").alias("h"), F.col("z.times").alias("k"))
    # unseen words add log10(SMOOTH) each; the join gives what seen ones add beyond that
    unseen = float(np.log10(SMOOTH))
    met = rare.join(counts, "h").groupBy("row").agg(
        F.sum("k").alias("known"), F.sum(F.col("k") * (F.log10(F.col("n") + SMOOTH) - unseen)).alias("more"),
    )
    rest = (F.col("n_tokens") - F.col("n_head")) * unseen + F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(met, "row", "left").select(
        "id", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("plain") + rest).alias("base_score"), (F.col("model") + rest).alias("score"),
    )
