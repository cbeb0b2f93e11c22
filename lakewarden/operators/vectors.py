"""Exact top-k cosine retrieval of a query table against a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.operators.ranking import top_k

BLOCK_ROWS = 2_048
#: Block pairs in one Arrow batch: each holds two blocks of vectors (a few MB).
PAIRS_PER_BATCH = 4


def _unit(rows) -> np.ndarray:
    matrix = np.stack([np.asarray(r, dtype="float64") for r in rows])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """Top ``k`` per query row of a score matrix; equal scores go to the smaller id."""
    parts = []
    for qid, row in zip(query_ids, scores, strict=True):
        floor = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        keep = np.nonzero(row >= floor)[0]
        keep = keep[np.lexsort((ids[keep], -row[keep]))][:k]
        parts.append(pd.DataFrame({"query_id": qid, "vec_id": ids[keep], "score": row[keep]}))
    return pd.concat(parts, ignore_index=True)


def _pairs_of_blocks(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Top ``k`` corpus rows of each query, for each (query block, corpus block) row."""
    for pdf in batches:
        for q_ids, q_vecs, c_ids, c_vecs in zip(pdf["q_ids"], pdf["q_vecs"], pdf["c_ids"], pdf["c_vecs"], strict=True):
            if len(q_ids) == 0 or len(c_ids) == 0:
                continue
            scores = np.round(_unit(q_vecs) @ _unit(c_vecs).T, 9)
            yield _best(np.asarray(q_ids), np.asarray(c_ids), scores, k)


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int, ident: str = "vec_id",
    vector: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest corpus rows of each query, exactly.

    Both tables are dealt by a hash of the id into blocks of about ``block_rows``
    rows (their number from a count), by a shuffle; every query block is sent to
    every corpus block by an equi-join on the corpus block number, and each pair of
    blocks is scored in one task, which keeps ``k`` rows per query. Nothing passes
    through the driver but the two counts. Equal scores go to the smaller id; null
    vectors are never searched nor found; zero vectors score 0.
    """
    corpus = corpus.filter(F.col(vector).isNotNull()).select(ident, vector)
    queries = queries.filter(F.col(vector).isNotNull()).select(ident, vector)
    kind = corpus.schema[ident].dataType
    out = T.StructType([
        T.StructField("query_id", queries.schema[ident].dataType),
        T.StructField("vec_id", kind),
        T.StructField("score", T.DoubleType()),
    ])
    spark = queries.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > PAIRS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIRS_PER_BATCH))
    q_blocks = max(1, -(-queries.count() // block_rows))
    c_blocks = max(1, -(-corpus.count() // block_rows))

    def dealt(df: DataFrame, n: int, name: str) -> DataFrame:
        slot = F.pmod(F.xxhash64(ident), F.lit(n)).alias(name)
        return df.groupBy(slot).agg(
            F.collect_list(ident).alias("ids"), F.collect_list(vector).alias("vecs")
        )

    q = dealt(queries, q_blocks, "qb").select(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"),
        F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"),
    )
    c = dealt(corpus, c_blocks, "cb").select("cb", F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))
    found = q.join(c, "cb").select("q_ids", "q_vecs", "c_ids", "c_vecs").mapInPandas(lambda b: _pairs_of_blocks(b, k), out)
    best = top_k(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    entry = F.struct((-F.col("score")).alias("o"), "vec_id")
    return (
        best.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("hits"))
        .select("query_id", F.posexplode("hits").alias("p", "h"))
        .select(
            "query_id", F.col("h.vec_id").alias("vec_id"), (-F.col("h.o")).alias("score"),
            (F.col("p") + 1).alias("rank"),
        )
    )



#: Corpus rows the centroids of the inverted file are fitted on, at most (smallest id hashes).
IVF_FIT_ROWS = 20_000
#: Recall at k that the number of probes must reach against the exact search.
IVF_RECALL = 0.95
#: Queries the recall is measured on, at most (smallest id hashes); every query is searched.
IVF_CHECK_QUERIES = 200


def ivf_centres(corpus: DataFrame, ident: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> np.ndarray:
    """Unit centroids of k-means (cosine) on at most IVF_FIT_ROWS corpus rows; ``lists`` defaults to sqrt(rows)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.filter(F.col(vector).isNotNull())
    n = rows.count()
    lists = max(1, min(lists or int(round(n ** 0.5)), IVF_FIT_ROWS))
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform(F.col(vector), lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-300)))
    sample = rows.orderBy(F.xxhash64(ident), ident).limit(IVF_FIT_ROWS).select(array_to_vector(unit).alias("features"))
    centres = np.array(KMeans(k=lists, seed=7, maxIter=20).fit(sample).clusterCenters())
    return _unit(list(centres))


def _lists(df: DataFrame, ident: str, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """(ident, vector, list) for the ``probes`` lists nearest each row (ties to the smaller list)."""
    probes = min(probes, len(centres))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            sims = _unit(pdf[vector]) @ centres.T
            best = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({
                ident: np.repeat(pdf[ident].to_numpy(), probes),
                vector: np.repeat(pdf[vector].to_numpy(), probes),
                "list": best.reshape(-1).astype("int32"),
            })

    schema = T.StructType([df.schema[ident], df.schema[vector], T.StructField("list", T.IntegerType())])
    return df.select(ident, vector).mapInPandas(assign, schema)


def ivf_topk(
    queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, probes: int,
    ident: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, vec_id, score, rank) from the ``probes`` nearest lists of each query.

    Every corpus row is indexed in its nearest list. A list is cut into blocks of about
    ``block_rows`` rows (a list holding a third of the corpus becomes many blocks), and
    the queries probing it likewise; blocks meet by an equi-join on (list, block) and are
    scored as in the exact search. The list counts are a table of one row per list.
    """
    corpus = corpus.filter(F.col(vector).isNotNull())
    queries = queries.filter(F.col(vector).isNotNull())
    kind = corpus.schema[ident].dataType
    out = T.StructType([
        T.StructField("query_id", queries.schema[ident].dataType), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType()),
    ])
    spark = queries.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > PAIRS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIRS_PER_BATCH))
    indexed = _lists(corpus, ident, vector, centres, 1)
    probing = _lists(queries, ident, vector, centres, probes)
    sizes = indexed.groupBy("list").agg(F.count("*").alias("n")).join(
        probing.groupBy("list").agg(F.count("*").alias("nq")), "list",
    ).select("list", F.ceil(F.col("n") / block_rows).cast("int").alias("cb"), F.ceil(F.col("nq") / block_rows).cast("int").alias("qb"))
    c = indexed.join(F.broadcast(sizes), "list").withColumn("c_at", F.pmod(F.xxhash64(ident), F.col("cb")))
    c = c.groupBy("list", "c_at").agg(F.collect_list(ident).alias("c_ids"), F.collect_list(vector).alias("c_vecs"))
    q = probing.join(F.broadcast(sizes), "list").withColumn("q_at", F.pmod(F.xxhash64(ident), F.col("qb")))
    q = q.groupBy("list", "q_at", "cb").agg(F.collect_list(ident).alias("q_ids"), F.collect_list(vector).alias("q_vecs")).select(
        "list", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("c_at"), "q_ids", "q_vecs",
    )
    found = q.join(c, ["list", "c_at"]).select("q_ids", "q_vecs", "c_ids", "c_vecs").mapInPandas(lambda b: _pairs_of_blocks(b, k), out)
    best = top_k(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    entry = F.struct((-F.col("score")).alias("o"), "vec_id")
    return (
        best.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("hits"))
        .select("query_id", F.posexplode("hits").alias("p", "h"))
        .select("query_id", F.col("h.vec_id").alias("vec_id"), (-F.col("h.o")).alias("score"), (F.col("p") + 1).alias("rank"))
    )


def recall_at_k(found: DataFrame, exact: DataFrame) -> float:
    """Share of exact (query_id, vec_id) hits that ``found`` has too."""
    row = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(
        F.count("*").alias("n"), F.count("hit").alias("h"),
    ).first()
    return 1.0 if not row["n"] else row["h"] / row["n"]


def choose_probes(
    queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, ident: str = "vec_id", vector: str = "embedding",
) -> tuple[int, float]:
    """(probes, recall): the fewest probes, doubling from 1, whose recall at k on at most
    IVF_CHECK_QUERIES queries reaches IVF_RECALL against the exact search; all lists at most."""
    check = queries.orderBy(F.xxhash64(ident), ident).limit(IVF_CHECK_QUERIES)
    exact = vector_topk(check, corpus, k, ident, vector)
    probes = 1
    while True:
        recall = recall_at_k(ivf_topk(check, corpus, k, centres, probes, ident, vector), exact)
        if recall >= IVF_RECALL or probes >= len(centres):
            return probes, recall
        probes = min(2 * probes, len(centres))
