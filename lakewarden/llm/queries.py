"""One registered query for each operator, with the digest columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.audit import filter_audit
from lakewarden.llm.common import documents, pinned
from lakewarden.llm.decontam import contaminated
from lakewarden.llm.factors import quality_scores
from lakewarden.llm.jaccard import jaccard_join
from lakewarden.llm.linededup import dedup_lines
from lakewarden.llm.maxent import language_scores
from lakewarden.llm.neardup import near_duplicates
from lakewarden.llm.pieces import encode_and_decode, token_digests
from lakewarden.llm.rules import calibrate, quality_rules, with_statistics
from lakewarden.llm.secrets import BASE_KINDS, find_secrets, span_text
from lakewarden.llm.spans import dedup_spans
from lakewarden.llm.toxicity import is_training, toxicity_scores
from lakewarden.llm.trie import prefix_trie



def piece_model() -> str:
    """Path of the 32k merge-type vocabulary among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


SQL["op1_decontamination"] = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM texts),
sets AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM words),
sizes AS (SELECT id, count(*) AS n_item FROM sets WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM sets d JOIN sets b ON d.shingle = b.shingle AND d.kind = 0 AND b.kind = 1 JOIN sizes s ON s.id = b.id
GROUP BY d.id, b.id HAVING 100 * count(*) >= 80 * any_value(n_item)"""


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda m: m["kind"] == k)).cast("bigint")
    base = F.filter("secrets", lambda m: m["kind"] < len(BASE_KINDS))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"),
    )


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM numbered),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, coalesce(o.owner, k.doc_id) = k.doc_id AS stays FROM keyed k LEFT JOIN owners o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_spans(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_sentences", "n_shared", "n_removed", (F.col("n_removed") > 0).alias("repeats_passage"), F.sha2("text", 256).alias("kept_sha256"),
    )


@query
def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_digests(encode_and_decode(docs, piece_model())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), is_training("doc_id", 3, 1))
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(~is_training("id", 3, 1), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("weight").alias("lexicon_weight"),
    )


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = pinned(with_statistics(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "rules"), "rules")
    judged = quality_rules(stats, calibrate(stats, documents(spark, sf_dir, "labels")))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *[f"rules.{c}" for c in base], "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


@query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_scores(documents(spark, sf_dir), is_training("doc_id", 10, 0))
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(~is_training("id", 10, 0), F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), is_training("doc_id", 5, 0))
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(~is_training("id", 5, 0), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "n_links",
    )


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).select(
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


SQL["op12_filter_audit"] = r"""
WITH lab AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS body,
    coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM documents d LEFT JOIN lab l ON l.doc_id = d.doc_id),
words AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w,
    CASE WHEN doc_id IS NULL THEN min(doc_id) OVER (PARTITION BY body) IS NOT NULL
      ELSE doc_id > min(doc_id) OVER (PARTITION BY body) END AS later
  FROM docs),
masks AS (
  SELECT part, good, toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN later THEN 16 ELSE 0 END AS mask
  FROM words),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
ranked AS (
  SELECT m.*, o.o, least(
    CASE WHEN mask & 1 <> 0 THEN instr(o.o, 'A') ELSE 6 END, CASE WHEN mask & 2 <> 0 THEN instr(o.o, 'B') ELSE 6 END,
    CASE WHEN mask & 4 <> 0 THEN instr(o.o, 'C') ELSE 6 END, CASE WHEN mask & 8 <> 0 THEN instr(o.o, 'D') ELSE 6 END,
    CASE WHEN mask & 16 <> 0 THEN instr(o.o, 'E') ELSE 6 END) AS r
  FROM masks m, orders o),
shapley AS (
  SELECT part, substr(o, r, 1) AS filter, count(*) AS shapley FROM ranked WHERE r <= 5 GROUP BY part, substr(o, r, 1)),
grid AS (
  SELECT p.part, o.o AS filter_order, s.step, substr(o.o, s.step, 1) AS filter,
    1 << (instr('ABCDE', substr(o.o, s.step, 1)) - 1) AS bit
  FROM (SELECT DISTINCT part FROM masks) p, orders o, (SELECT unnest(range(1, 6)) AS step) s)
SELECT g.part, g.filter_order, CAST(g.step AS INTEGER) AS step, g.filter,
  count(r.mask) FILTER (WHERE r.r > g.step) AS kept,
  count(r.mask) FILTER (WHERE r.r = g.step) AS removed,
  count(r.mask) FILTER (WHERE r.mask & g.bit <> 0 AND r.r < g.step) AS redundant,
  count(r.mask) FILTER (WHERE r.mask = g.bit) AS unique_fails,
  count(r.mask) FILTER (WHERE r.r = g.step AND r.good) AS good_lost,
  count(r.mask) FILTER (WHERE r.r = g.step AND r.toxic) AS toxic_lost,
  coalesce(any_value(sh.shapley), 0) AS shapley
FROM grid g LEFT JOIN ranked r ON r.part = g.part AND r.o = g.filter_order
LEFT JOIN shapley sh ON sh.part = g.part AND sh.filter = g.filter
GROUP BY g.part, g.filter_order, g.step, g.filter"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(documents(spark, sf_dir, "conversations"))
