"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(bias + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): the
bracket gives all pairwise interactions of rank ``RANK`` in time linear in the features.
Words are hashed to buckets, with values of unit length together; structure (shares of
signs, capitals, repeated words and lines, word length) and metadata (length) are
buckets of their own with value 1. Training runs in rounds: each of ``SHARDS`` tasks takes Adagrad
steps over its rows from the shared parameters, and the results are averaged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import arrow_pass, flat_lists, pieces, pinned, word_hashes
from lakewarden.llm.toxicity import fit_sample

#: Word buckets, buckets of structure statistics, and factors of each.
WORD_BUCKETS, STRUCTURE_BUCKETS, RANK = 1 << 16, 256, 8
BUCKETS = WORD_BUCKETS + STRUCTURE_BUCKETS
#: Labelled training rows that are fitted on, at most: those with the smallest hashes of the id.
FIT_ROWS = 30_000
SHARDS, ROUNDS = 8, 4
RATE, PENALTY = 0.1, 1e-4
#: Edges of the buckets of each statistic.
EDGES = {
    "signs": [0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4],
    "pipes": [0.002, 0.01, 0.03, 0.06, 0.1, 0.2],
    "capitals": [0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "exclamations": [0.01, 0.05, 0.1, 0.2, 0.4, 0.8],
    "digits": [0.005, 0.02, 0.05, 0.1, 0.3],
    "repeats": [0.2, 0.4, 0.55, 0.7, 0.8, 0.9, 0.97],
    "dup_lines": [0.01, 0.1, 0.2, 0.4, 0.6, 0.8],
    "word_bytes": [2, 3, 4, 5, 6, 7, 8, 10, 14],
    "words": [1, 3, 10, 30, 100, 300, 1000, 3000, 10000],
    "lines": [2, 4, 8, 16, 64, 256],
}


def _structure(body: bytes, words: np.ndarray, distinct: int) -> np.ndarray:
    """Bucket of each statistic, after the word buckets."""
    chars = np.zeros(256, np.int64)
    for part in pieces(body):
        chars += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
    n, size = max(len(words), 1), max(len(body), 1)
    lines = body.split(b"\n")
    full = [x for x in lines if x.strip()]
    values = {
        "signs": chars[[35, 36, 37, 38, 42, 60, 62, 64, 94, 126]].sum() / size, "pipes": chars[124] / size,
        "capitals": chars[65:91].sum() / size, "exclamations": chars[33] / n, "digits": chars[48:58].sum() / size,
        "repeats": 1 - distinct / n, "dup_lines": 1 - len(set(full)) / max(len(full), 1),
        "word_bytes": (len(body) - chars[[9, 10, 11, 12, 13, 32]].sum()) / n, "words": len(words), "lines": len(lines),
    }
    return np.array([WORD_BUCKETS + 16 * k + int(np.searchsorted(e, values[name], "right")) for k, (name, e) in enumerate(EDGES.items())])


def features(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets of a text with their values."""
    words = word_hashes(body)
    buckets, counts = np.unique((words >> np.uint64(40)).astype(np.int64) & (WORD_BUCKETS - 1), return_counts=True)
    structure = _structure(body, words, len(buckets))
    values = np.sqrt(counts)
    norm = np.sqrt((values**2).sum()) or 1.0
    return np.concatenate([buckets, structure]), np.concatenate([values / norm, np.ones(len(structure))]).astype(np.float32)


def initial() -> np.ndarray:
    """Parameters: one row for each bucket (weight, factors) and a last one for the bias."""
    p = np.random.default_rng(5).normal(0, 0.05, (BUCKETS + 1, RANK + 1)).astype(np.float32)
    p[:, 0] = 0
    p[-1] = 0
    return p


def raw_score(p: np.ndarray, at: np.ndarray, x: np.ndarray) -> float:
    rows = p[at]
    vx = rows[:, 1:] * x[:, None]
    total = vx.sum(axis=0)
    return float(p[-1, 0] + rows[:, 0] @ x + 0.5 * ((total * total).sum() - (vx * vx).sum()))


def train(p: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, float]], seed: int) -> np.ndarray:
    """One pass of Adagrad over rows (buckets, values, label) from ``p``."""
    p, grown = p.copy(), np.full(p.shape, 1e-2, np.float32)
    for k in np.random.default_rng(seed).permutation(len(rows)):
        at, x, y = rows[k]
        part = p[at]
        vx = part[:, 1:] * x[:, None]
        total = vx.sum(axis=0)
        z = p[-1, 0] + part[:, 0] @ x + 0.5 * ((total * total).sum() - (vx * vx).sum())
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.empty_like(part)
        grad[:, 0] = err * x
        grad[:, 1:] = err * x[:, None] * (total[None, :] - vx)
        grad += PENALTY * part
        grown[at] += grad * grad
        p[at] -= RATE * grad / np.sqrt(grown[at])
        grown[-1, 0] += err * err
        p[-1, 0] -= RATE * err / np.sqrt(grown[-1, 0])
    return p


def _to_features(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [features(b.as_py()) for b in batch.column(1)]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), flat_lists([a.astype(np.int32) for a, _ in found], pa.int32()), flat_lists([x for _, x in found], pa.float32()), batch.column(2)],
        names=["id", "at", "x", "label"],
    )


def _round(p: np.ndarray, seed: int):
    def run(batches):
        rows = []
        for batch in batches:
            rows += [(np.array(a), np.array(x, np.float32), float(y > 0)) for a, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if rows:
            out = train(p, rows, seed)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["n", "p"])

    return run


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Parameters fitted to at most ``fit_rows`` labelled rows; the initial ones if there are none.

    A task holds fit_rows / SHARDS feature rows; the driver averages SHARDS parameter tables of 2 MB.
    """
    sample = fit_sample(docs, labels, training, id_col, text_col, label_col, fit_rows)
    rows = pinned(arrow_pass(sample.select("id", "body", "label"), _to_features, "id bigint, at array<int>, x array<float>, label int"), "features")
    shards = pinned(rows.repartition(SHARDS, "id"), "shards")
    p = initial()
    for k in range(ROUNDS):
        found = shards.select("at", "x", "label").mapInArrow(_round(p, k), "n bigint, p binary").toArrow()
        if not found.num_rows:
            return p
        weights = found["n"].to_numpy().astype(np.float64)
        tables = [np.frombuffer(b.as_py(), np.float32).reshape(p.shape) for b in found["p"]]
        p = (sum(w * t.astype(np.float64) for w, t in zip(weights, tables)) / weights.sum()).astype(np.float32)
    return p


def quality_scores(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, n_features, score) for each row of ``docs``; score is the chance of label 1.

    ``training`` says which label rows may be learned from. A null or empty text has structure
    buckets only. Rows with null or repeated ids are scored each by its text; null ids are
    never learned from. Without training rows all scores are near one half. Other
    columns are not read.
    """
    p = fit(docs, labels, training, id_col, text_col, label_col, fit_rows)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, z = [], []
        for body in batch.column(1):
            at, x = features(body.as_py())
            sizes.append(len(at))
            z.append(raw_score(p, at, x))
        chance = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(chance, pa.float64())], names=["id", "n_features", "score"])

    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body")
    return arrow_pass(docs.select(F.col(id_col).cast("bigint").alias("id"), body), score, "id bigint, n_features bigint, score double")
